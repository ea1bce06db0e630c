"""Texts fetched by key: one reply per request, source back-fill, content ids, hot texts."""
import re

from pyspark.sql import functions as F

from conftest import SF001
from findings_lake import queries as Q
from findings_lake.operators import mitigations as M, replies as J
from findings_lake.operators.skew import salted_join


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_text_is_sorted_or_aggregated(spark):
    for name in ("mitigation_source", "mitigation_parse", "reply_join"):
        p = plan(Q.registry()[name](spark, SF001))
        assert "SortAggregate" not in p, name
        for line in re.findall(r"(?:Window|Sort) \[[^\n]*", p):
            assert not re.search(r"\b(raw|source|fn_source|error)#", line.split("], [")[-1]), line


def test_one_reply_per_request(spark):
    rows = [("a", "x", None), ("a", "y", None), ("a", "b", "timeout"), ("b", None, "late"), ("b", "same", None), ("b", "same", None), ("c", None, None)]
    df = spark.createDataFrame(rows, "request_id string, raw string, error string")
    got = {r.request_id: r for r in J.one_reply(df).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].raw in "xy" and got["b"].raw == "same" and got["c"].raw is None
    again = {r.request_id: r for r in J.one_reply(df.repartition(7)).collect()}
    assert again == got


def test_source_of_the_first_function_of_a_name(spark):
    fns = spark.createDataFrame([("f.py", 3, "g", "third"), ("f.py", 1, "g", "first"), ("f.py", 2, "h", "only"), ("e.py", 0, "g", "other")],
                                "file string, fn_ord int, name string, source string")
    cands = spark.createDataFrame([("f.py", "g"), ("f.py", "h"), ("e.py", "g"), ("f.py", "none"), ("f.py", "g")], "file string, function string")
    got = sorted((r.file, r.function, r.fn_source, r.name_ambiguous) for r in M.attach_source(cands, fns).collect())
    assert got == [("e.py", "g", "other", False), ("f.py", "g", "first", True), ("f.py", "g", "first", True),
                   ("f.py", "h", "only", False), ("f.py", "none", "", False)]


def test_query_texts_are_never_shuffled_whole(spark):
    for name in ("mitigation_context", "mitigation_prompts"):
        p = plan(Q.registry()[name](spark, SF001))
        assert not re.search(r"hashpartitioning\([^)]*query_text", p), name


def test_one_text_on_a_third_of_the_findings(spark):
    n = 3000
    cands = spark.range(n).select(
        F.lit("f.py").alias("file"), F.col("id").cast("int").alias("fn_ord"), F.lit(0).alias("finding_pos"),
        F.when(F.col("id") % 3 == 0, F.lit("the hot text")).otherwise(F.concat(F.lit("text "), (F.col("id") % 500).cast("string"))).alias("query_text"))
    ctx = cands.select("query_text").distinct().where("query_text <> 'text 7'").select(
        M.content_id("query_text").alias("query_id"), F.concat(F.lit("context of "), F.col("query_text")).alias("context"))
    rows = M.with_contexts(cands, ctx).collect()
    assert len(rows) == n
    for r in rows:
        assert r.context == (None if r.query_text == "text 7" else "context of " + r.query_text)
    p = plan(salted_join(cands.withColumn("query_id", M.content_id("query_text")), ctx, "query_id", ["fn_ord"]))
    assert re.search(r"hashpartitioning\(query_id#\d+, _salt#", p) or "BroadcastHashJoin [query_id" in p


def test_hot_keys_meet_several_copies(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 900, F.lit("hot")).when(F.col("id") < 990, F.lit(None)).otherwise(
        F.col("id").cast("string")).alias("k"))
    words = spark.createDataFrame([("hot", 1), ("995", 2)], "k string, v int")
    got = {r.id: r.v for r in salted_join(rows, words, "k", ["id"]).collect()}
    assert len(got) == 1000 and all(got[i] == (1 if i < 900 else 2 if i == 995 else None) for i in range(1000))
