"""Retrieval (R4-R10): rules, numpy brute force, block merge, native form."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from findings_lake import bindings as B
from findings_lake.operators import retrieve as R


def kb_df(spark, rows):
    """rows: (source, chunk_pos, sev, vec)"""
    data = [(s, p, f"c{p}" if s == "CWE" else None, f"CVE-{p}" if s == "CVE" else None,
             "CWE-1" if s == "CVE" else None, sev, 5.0 if s == "CVE" else None, f"text {p}",
             [float(x) for x in v]) for s, p, sev, v in rows]
    return spark.createDataFrame(data, "source string, chunk_pos long, chunk_id string, cve_id string, "
                                       "cwe_id string, cvss_severity string, cvss_score double, "
                                       "chunk_text string, embedding array<float>")


def q_df(spark, vec):
    return spark.createDataFrame([("q", [float(x) for x in vec])], "query_id string, embedding array<double>")


def small_kb(spark, n_cve_ok=5):
    rows = [("CWE", i, None, [1.0, i / 10]) for i in range(6)]
    rows += [("CVE", 100 + i, "HIGH" if i < n_cve_ok else None, [1.0, -i / 10]) for i in range(5)]
    return kb_df(spark, rows)


@pytest.mark.parametrize("top_k,expect", [(6, ["CWE", "CVE"] * 3), (5, ["CWE", "CVE"] * 2 + ["CWE"]),
                                          (1, ["CWE"]), (0, [])])
def test_top_k_shapes(spark, top_k, expect):
    hits = R.retrieve(q_df(spark, [1, 0]), small_kb(spark), top_k=top_k).orderBy("pos").collect()
    assert [h.source for h in hits] == expect
    assert [h.pos for h in hits] == list(range(len(expect)))


def test_no_cve_gives_nothing(spark):
    assert R.retrieve(q_df(spark, [1, 0]), small_kb(spark, n_cve_ok=0)).count() == 0


def test_two_cve_gives_four(spark):
    assert R.retrieve(q_df(spark, [1, 0]), small_kb(spark, n_cve_ok=2), top_k=6).count() == 4


def test_tie_prefers_higher_position(spark):
    kb = kb_df(spark, [("CWE", 3, None, [1, 0]), ("CWE", 8, None, [1, 0]), ("CWE", 5, None, [0, 1]),
                       ("CVE", 9, "LOW", [1, 0])])
    t = R.top_n_per_source(q_df(spark, [1, 0]), kb, top_k=2).where("source = 'CWE'").orderBy("rn")
    assert [r.chunk_pos for r in t.collect()] == [8, 3]


def test_negative_top_k_rejected(spark):
    with pytest.raises(ValueError):
        R.top_n_per_source(q_df(spark, [1, 0]), small_kb(spark), top_k=-1)


def _bench_inputs(spark):
    kb = B.kb_chunks(spark, SF01)
    qs = R.normalise_vectors(B.kb_query_vectors(spark, SF01))
    return kb, qs


def test_matches_numpy_brute_force(spark):
    kb, qs = _bench_inputs(spark)
    got = {(r.query_id, r.source, r.rn): r.chunk_pos
           for r in R.top_n_per_source(qs, kb, top_k=6).collect()}
    k = kb.select("source", "chunk_pos", "cvss_severity", "embedding").toPandas()
    q = qs.toPandas()
    keep = (k.source == "CWE") | k.cvss_severity.isin(["CRITICAL", "HIGH", "MEDIUM", "LOW"])
    k = k[keep]
    K = np.stack(k.embedding.to_numpy()).astype(np.float64)
    Q = np.stack(q.embedding.to_numpy())
    S = Q @ K.T
    for i, qid in enumerate(q.query_id.astype(str)):
        for src in ("CWE", "CVE"):
            m = (k.source == src).to_numpy()
            pos = k.chunk_pos.to_numpy()[m]
            order = sorted(range(m.sum()), key=lambda j: (-S[i, m][j], -pos[j]))[:4]
            for rn, j in enumerate(order, 1):
                assert got[(qid, src, rn)] == pos[j]


def test_block_merge_equals_single_block(spark):
    kb, qs = _bench_inputs(spark)
    one = R.retrieve(qs, kb, top_k=6).select("query_id", "pos", "chunk_pos")
    many = R.retrieve(qs, kb, top_k=6, block_rows=50, query_rows=70).select("query_id", "pos", "chunk_pos")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_native_higher_order_form_agrees(spark):
    kb, qs = _bench_inputs(spark)
    qs = qs.where(F.col("query_id") < 40)
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a * b.cast("double")),
                      F.lit(0.0), lambda x, y: x + y)
    pairs = (qs.select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").alias("q"))
             .crossJoin(R.eligible_chunks(kb).select("source", "chunk_pos", "embedding"))
             .select("query_id", "source", "chunk_pos", dot.alias("score")))
    from pyspark.sql import Window
    w = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), F.desc("chunk_pos"))
    native = pairs.withColumn("rn", F.row_number().over(w)).where("rn <= 4")
    fast = R.top_n_per_source(qs, kb, top_k=6)
    a = sorted((r.query_id, r.source, r.rn, r.chunk_pos) for r in native.collect())
    b = sorted((r.query_id, r.source, r.rn, r.chunk_pos) for r in fast.collect())
    assert a == b


def test_context_headers(spark):
    hits = R.retrieve(q_df(spark, [1, 0]), small_kb(spark), top_k=2)
    ctx = R.context_text(hits).first().context
    first, second = ctx.split("\n\n")
    assert first.startswith("[Ref 1 | c5 | relevance ")
    assert second.startswith("[Ref 2 | CVE-104 | CVSS 5.0 HIGH | CWE-1 | relevance 1.00]")


def test_sliced_scoring_equals_batch(spark, monkeypatch):
    kb, qs = _bench_inputs(spark)
    def run():
        rows = R.top_n_per_source(qs, kb, top_k=4).collect()
        return sorted((r.query_id, r.source, r.rn, r.chunk_pos, round(r.score, 12)) for r in rows)
    base = run()
    monkeypatch.setattr(R, "MAX_SCORE_BYTES", 1000)  # one query per slice
    assert run() == base


def test_sources_numbered_apart_keep_their_texts(spark):
    """CWE and CVE chunks are both numbered from 0: a hit is told by source and position."""
    kb = kb_df(spark, [("CWE", 0, None, [1, 0]), ("CWE", 1, None, [0.9, 0]),
                       ("CVE", 0, "HIGH", [1, 0]), ("CVE", 1, "LOW", [0.9, 0])])
    got = R.retrieve_context(q_df(spark, [1, 0]), kb, top_k=4).first().context.split("\n\n")
    assert [g.split(" | ")[1] for g in got] == ["c0", "CVE-0", "c1", "CVE-1"]
    kb = kb.withColumn("cvss_score", F.lit(7.1).cast("float"))
    assert " | CVSS 7.1 HIGH | " in R.retrieve_context(q_df(spark, [1, 0]), kb, top_k=2).first().context


def test_one_result_per_query_id(spark):
    q = q_df(spark, [1, 0]).union(q_df(spark, [0.5, 1]))
    assert R.retrieve(q, small_kb(spark), top_k=6).count() == 6


def test_building_a_query_starts_no_job(spark):
    kb, qs = _bench_inputs(spark)
    before = spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()
    R.retrieve_context(qs, kb)
    assert spark.sparkContext._jsc.sc().statusStore().jobsList(None).size() == before


def test_hits_are_dealt_by_query_once_and_parts_stay_few(spark):
    import re

    qs = spark.range(300000).selectExpr("cast(id as string) query_id", "array(1D, cast(id as double)) embedding")
    kb = spark.createDataFrame([("CWE", 0, "a", [1.0, 0.0])], "source string, chunk_pos long, chunk_text string, embedding array<double>")
    p = R.interleave(R.top_n_per_source(qs, kb))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(query_id#\d+(, source#\d+)?, ", p)) == 1
    parts = R.pruning_profile(qs, kb)  # every query meets the one chunk once, in whatever part it is
    assert parts.first().n_cells == 300000


def test_a_query_is_sent_once_for_all_sources(spark):
    rows = [("CWE" if i % 2 else "CVE", i // 2, f"t{i}", "HIGH", [float(i), 1.0]) for i in range(8)]
    kb = spark.createDataFrame(rows, "source string, chunk_pos long, chunk_text string, cvss_severity string, embedding array<double>")
    qs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "query_id string, embedding array<double>")
    assert R._by_source(["CVE", "CWE", "CVE"], [(np.array([0, 1, 2]), np.eye(3))]).__next__()[1].tolist() == [0, 2]
    got = {(r.query_id, r.source): r.chunk_pos for r in R.top_n_per_source(qs, kb).where("rn = 1").collect()}
    assert got == {(q, s): 3 for q in "ab" for s in ("CWE", "CVE")}
