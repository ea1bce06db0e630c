"""Driver tables -> domain tables.

The reference's inputs (model replies, knowledge-base chunks, Python sources,
fuzzer output files) do not exist as tables, so they are derived from the
driver's parquet tables with fixed rules. Every group built here is bounded
by construction (8 findings per reply, 25 functions per app file, 40
definitions per corpus file, at most 1000 results per fuzzer file), so no
binding ever funnels a growing share of the data into one row.

The same rules are spelled in DuckDB SQL in ``oracle_sql.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Binding constants (our own test-data rules, not reference values).
# ---------------------------------------------------------------------------
# finding k % 13 -> (cwe_id, cwe_name); None = key omitted from the reply.
CWE_BY_K13 = [
    ("CWE-89", "SQL Injection"),
    ("CWE-79", "Cross-site Scripting"),
    ("CWE-78", "OS Command Injection"),
    ("CWE-22", "Path Traversal"),
    ("CWE-287", "Improper Authentication"),
    ("CWE-352", "Cross-Site Request Forgery"),
    ("CWE-434", "Unrestricted Upload"),
    ("CWE-502", "Deserialization of Untrusted Data"),
    ("CWE-918", "Server-Side Request Forgery"),
    ("CWE-20", "Improper Input Validation"),
    ("CWE-94", "Code Injection"),
    (None, "Unknown weakness"),
    ("", ""),
]
# (k + event_id) % 7 -> raw severity text; None = JSON null (k even) or
# key omitted (k odd).
SEVERITY_BY_7 = ["CRITICAL", "high", "Medium", "LOW", "INFO", "SEVERE", None]
# kb label % 6 -> cvss severity of a CVE chunk.
CVSS_BY_LABEL6 = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", None]
REFERENCE_POOL = ["CVE-2024-{k}", "CVE-2023-{k}", "CWE-{k}", "REF-1", "REF-2", "REF-3", "REF-4"]
FINDINGS_PER_FN = 8
FNS_PER_APP_FILE = 25
NAME_CYCLE = 20          # app function names repeat -> M1 first-name rule
DEFS_PER_MODULE = 40
BROKEN_MODULE_EVERY = 50  # module index % 50 == 13 has a syntax error
BROKEN_MODULE_AT = 13
FUZZ_FILE_SPAN = 1000    # event ids per fuzzer output file
TARGET_BASE = "http://t.example"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read as it is."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _pick(key: Column, values: list) -> Column:
    expr = F.lit(None).cast("string")
    for i, v in enumerate(values):
        expr = F.when(key == i, F.lit(v)).otherwise(expr)
    return expr


def _q(c: Column) -> Column:
    """JSON string literal for binding text (binding texts hold no quotes)."""
    return F.concat(F.lit('"'), c, F.lit('"'))


# ---------------------------------------------------------------------------
# Findings world (events)
# ---------------------------------------------------------------------------
def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b_findings: one raw finding per event, before it is written as JSON."""
    fn_id = F.floor(F.col("event_id") / FINDINGS_PER_FN).cast("long")
    # Dealt by the function before any text is built: the rows are narrow here, texts are
    # then made by all tasks, and grouping or joining by function needs no other exchange.
    ev = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", "props", fn_id.alias("fn_id"),
        F.concat(F.lit("app_"), F.floor(fn_id / FNS_PER_APP_FILE).cast("string"), F.lit(".py")).alias("file"),
        (fn_id % FNS_PER_APP_FILE).cast("int").alias("fn_ord")).repartition("file", "fn_ord").withColumn("k", _k()).drop("props")
    k13 = F.col("k") % 13
    sev7 = (F.col("k") + F.col("event_id")) % 7
    k_text = F.col("k").cast("string")
    pool = [F.concat(F.lit(p.replace("{k}", "")), k_text) if "{k}" in p else F.lit(p)
            for p in REFERENCE_POOL]
    refs = F.slice(F.array(*pool), 1, (F.col("k") % 7 + 1).cast("int"))
    return (ev
            .withColumn("finding_pos", (F.col("event_id") % FINDINGS_PER_FN).cast("int"))
            .withColumn("cwe_id", _pick(k13, [c for c, _ in CWE_BY_K13]))
            .withColumn("cwe_name", _pick(k13, [n for _, n in CWE_BY_K13]))
            .withColumn("severity_raw", _pick(sev7, SEVERITY_BY_7))
            .withColumn("severity_null", sev7 == 6)
            .withColumn("conf_text", F.concat(F.round(F.col("value") * 100, 0).cast("long").cast("string"),
                                              F.lit("e-4")))
            .withColumn("line_hint", F.concat(F.lit("line "), (F.col("finding_pos") + 1).cast("string")))
            .withColumn("description", F.concat(F.lit("unsafe "), F.col("event_type"), F.lit(" handling")))
            .withColumn("evidence", F.concat(F.lit("payload_"), F.col("k").cast("string")))
            .withColumn("solution", F.concat(F.lit("validate input "), F.col("k").cast("string")))
            .withColumn("references", refs)
            .withColumn("is_object", (F.col("k") % 17) != 16))


def _finding_json() -> Column:
    sev_part = (F.when(~F.col("severity_null"),
                       F.concat(F.lit('"severity": '), _q(F.col("severity_raw")), F.lit(", ")))
                .when(F.col("k") % 2 == 0, F.lit('"severity": null, '))
                .otherwise(F.lit("")))
    cwe_part = F.when(F.col("cwe_id").isNull(), F.lit("")).otherwise(
        F.concat(F.lit('"cwe_id": '), _q(F.col("cwe_id")), F.lit(", ")))
    refs = F.concat(F.lit("["),
                    F.array_join(F.transform("references", lambda r: _q(r)), ", "),
                    F.lit("]"))
    obj = F.concat(
        F.lit("{"), cwe_part,
        F.lit('"cwe_name": '), _q(F.col("cwe_name")), F.lit(", "),
        sev_part,
        F.lit('"confidence": '), F.col("conf_text"), F.lit(", "),
        F.lit('"line_hint": '), _q(F.col("line_hint")), F.lit(", "),
        F.lit('"description": '), _q(F.col("description")), F.lit(", "),
        F.lit('"evidence": '), _q(F.col("evidence")), F.lit(", "),
        F.lit('"solution": '), _q(F.col("solution")), F.lit(", "),
        F.lit('"references": '), refs, F.lit("}"))
    return F.when(F.col("is_object"), obj).otherwise(F.lit('"see above"'))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b_replies: one model reply per app function.

    Wrapping by fn_id % 5: 0 bare array, 1 fenced, 2 prose around it,
    3 inside {"findings": ...}, 4 cut in half. fn_id % 11 == 10: the model
    call failed (raw NULL, error text).
    """
    rows = finding_rows(spark, sf_dir).withColumn("elem", _finding_json())
    # grouped by the function's key alone, so a join by function needs no other exchange
    per_fn = (rows.groupBy("file", "fn_ord")
              .agg(F.min("fn_id").alias("fn_id"), F.array_sort(F.collect_list(F.struct("finding_pos", "elem"))).alias("els")))
    arr = F.concat(F.lit("["), F.array_join(F.transform("els", lambda x: x["elem"]), ", "), F.lit("]"))
    form = F.col("fn_id") % 5
    raw = (F.when(form == 0, arr)
           .when(form == 1, F.concat(F.lit("```json\n"), arr, F.lit("\n```")))
           .when(form == 2, F.concat(F.lit("Here are the findings:\n"), arr,
                                     F.lit("\nLet me know if you need more.")))
           .when(form == 3, F.concat(F.lit('{"findings": '), arr, F.lit("}")))
           .otherwise(F.substring(arr, 1, F.floor(F.length(arr) / 2).cast("int"))))
    failed = F.col("fn_id") % 11 == 10
    return per_fn.select(
        F.concat(F.col("file"), F.lit("#"), F.col("fn_ord").cast("string")).alias("request_id"),
        "file", "fn_ord",
        F.when(~failed, raw).alias("raw"),
        F.when(failed, F.lit("timeout after 120s")).alias("error"))


ODD_PER_REPLY = 6
#: Members of a finding object that reach the rarer rules, by event_id % 12 ({k} is the event's k).
ODD_MEMBERS = [
    '"confidence": NaN',
    '"confidence": Infinity, "severity": "CRITICAL"',
    '"confidence": -Infinity',
    '"confidence": " 0.35 ", "line_hint": 1e-7',
    '"confidence": null',
    '"confidence": "high"',
    '"references": "CVE-{k}"',
    '"references": null',
    r'''"evidence": {"line": {k}, "code": "x = \"é\" + 'q'", "ok": true, "none": null, "f": 0.5}''',
    r'''"solution": ["a", {k}, 2.5, false, {"z": "it's", "a": [], "n": NaN}], "confidence": true''',
    r'''"description": "said \"NaN, Infinity\" \\ in C:\\tmp\u00e9 [{k}]", "cwe_id": null''',
    r'''"references": ["R-{k}", 1.0, null, {"b": 1, "a": "\t"}], "confidence": "1e-1"''',
]


def odd_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b_odd_replies: one finding per event with the members above, six to a
    reply; replies are bare, fenced or inside prose (reply % 3)."""
    ev = table(spark, sf_dir, "events").select("event_id", "props", F.floor(F.col("event_id") / ODD_PER_REPLY).cast("long").alias("fn_id"))
    ev = ev.repartition("fn_id").withColumn("k", _k().cast("string"))
    members = F.replace(_pick(F.col("event_id") % len(ODD_MEMBERS), ODD_MEMBERS), F.lit("{k}"), F.col("k"))
    elem = F.concat(F.lit('{"cwe_name": "event '), F.col("event_id").cast("string"), F.lit('", '), members, F.lit("}"))
    per = ev.select("fn_id", "event_id", elem.alias("elem")).groupBy("fn_id").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "elem"))).alias("els"))
    arr = F.concat(F.lit("["), F.array_join(F.transform("els", lambda x: x["elem"]), ", "), F.lit("]"))
    form = F.col("fn_id") % 3
    raw = (F.when(form == 0, arr).when(form == 1, F.concat(F.lit("```json\n"), arr, F.lit("\n```")))
           .otherwise(F.concat(F.lit('So called "findings":\n'), arr, F.lit("\nDone"))))
    return per.select(
        F.concat(F.lit("odd#"), F.col("fn_id").cast("string")).alias("request_id"), F.lit("odd.py").alias("file"),
        F.col("fn_id").cast("int").alias("fn_ord"), raw.alias("raw"), F.lit(None).cast("string").alias("error"))


def app_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions table of the app files (every function has a reply)."""
    fn_id = F.floor(F.col("event_id") / FINDINGS_PER_FN).cast("long")
    ev = table(spark, sf_dir, "events").select(
        F.concat(F.lit("app_"), F.floor(fn_id / FNS_PER_APP_FILE).cast("string"), F.lit(".py")).alias("file"),
        (fn_id % FNS_PER_APP_FILE).cast("int").alias("fn_ord")).distinct()
    fn_ord = F.col("fn_ord")
    name = F.concat(F.lit("fn_"), (fn_ord % NAME_CYCLE).cast("string"))
    return ev.select(
        "file", "fn_ord",
        name.alias("name"),
        (fn_ord * 10 + 1).alias("lineno"),
        (fn_ord * 10 + 8).alias("end_lineno"),
        F.array(F.lit("a"), F.lit("b")).alias("args"),
        F.lit("").alias("docstring"),
        F.concat(F.lit("def "), name, F.lit("(a, b):\n    # ord "), fn_ord.cast("string"),
                 F.lit("\n    return a\n")).alias("source"))


def app_targets(functions: DataFrame) -> DataFrame:
    """Fuzz target URL per app file; every 7th file lacks the FUZZ marker."""
    files = functions.select("file").distinct()
    idx = F.regexp_extract("file", "app_(\\d+)\\.py", 1).cast("long")
    return files.select(
        "file",
        F.when(idx % 7 == 3, F.concat(F.lit(TARGET_BASE + "/"), F.col("file"), F.lit("/user")))
        .otherwise(F.concat(F.lit(TARGET_BASE + "/"), F.col("file"), F.lit("/user/FUZZ")))
        .alias("target_url"))


# ---------------------------------------------------------------------------
# Knowledge base and query vectors (embeddings)
# ---------------------------------------------------------------------------
def kb_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b_kb: every embeddings row is a chunk; vec_id % 3 == 0 -> CVE. Each
    source numbers its chunks from 0."""
    e = table(spark, sf_dir, "embeddings")
    is_cve = F.col("vec_id") % 3 == 0
    third = F.floor(F.col("vec_id") / 3)
    return e.select(
        F.when(is_cve, F.lit("CVE")).otherwise(F.lit("CWE")).alias("source"),
        F.when(is_cve, third).otherwise(F.col("vec_id") - third - 1).alias("chunk_pos"),
        F.when(~is_cve, F.concat(F.lit("CWE-"), (F.col("vec_id") % 97).cast("string"),
                                 F.lit("-c"), F.col("vec_id").cast("string"))).alias("chunk_id"),
        F.when(is_cve, F.concat(F.lit("CVE-2024-"), F.col("vec_id").cast("string"))).alias("cve_id"),
        F.when(is_cve, F.concat(F.lit("CWE-"), (F.col("label") * 7 + 20).cast("string"))).alias("cwe_id"),
        F.when(is_cve, _pick(F.col("label") % 6, CVSS_BY_LABEL6)).alias("cvss_severity"),
        F.when(is_cve, (F.col("vec_id") % 100) / 10.0).alias("cvss_score"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string"), F.lit(" label "),
                 F.col("label").cast("string")).alias("chunk_text"),
        F.col("embedding"))


def kb_query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embeddings row is also a retrieval query (query_id = vec_id)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding"))


def vector_for(keys: DataFrame, key_col: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attach embedding number ``key % n_embeddings`` to each key row."""
    e = table(spark, sf_dir, "embeddings")
    n = e.select(F.count(F.lit(1))).scalar()  # scalar subquery, one value
    return (keys.withColumn("vec_id", F.pmod(F.col(key_col), n))
            .join(e.select("vec_id", "embedding"), "vec_id")
            .drop("vec_id"))


# ---------------------------------------------------------------------------
# Python corpus (part)
# ---------------------------------------------------------------------------
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b_corpus: 40 definitions per module file, in key order."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    mod = F.floor(F.col("p_partkey") / DEFS_PER_MODULE).cast("long")
    block = F.concat(
        F.lit("def f_"), F.col("p_partkey").cast("string"), F.lit("(a, b, *c, d=1):\n"),
        F.lit('    """'), F.col("p_name"), F.lit('"""\n'),
        F.lit("    return a\n\n"))
    per_file = (p.select(mod.alias("mod"), "p_partkey", block.alias("block"))
                .groupBy("mod")
                .agg(F.array_sort(F.collect_list(F.struct("p_partkey", "block"))).alias("blocks")))
    body = F.array_join(F.transform("blocks", lambda x: x["block"]), "")
    broken = F.col("mod") % BROKEN_MODULE_EVERY == BROKEN_MODULE_AT
    return per_file.select(
        F.concat(F.lit("m_"), F.col("mod").cast("string"), F.lit(".py")).alias("file"),
        F.when(broken, F.concat(F.lit("def broken(:\n"), body)).otherwise(body).alias("content"))


def corpus_query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vector per corpus function: embedding ``p_partkey % n``."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    mod = F.floor(F.col("p_partkey") / DEFS_PER_MODULE).cast("long")
    keys = p.select(
        F.concat(F.lit("m_"), mod.cast("string"), F.lit(".py")).alias("file"),
        (F.col("p_partkey") % DEFS_PER_MODULE).cast("int").alias("fn_ord"),
        "p_partkey")
    return vector_for(keys, "p_partkey", spark, sf_dir).drop("p_partkey")


# ---------------------------------------------------------------------------
# Fuzzer output files (events)
# ---------------------------------------------------------------------------
def fuzz_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b_fuzz_files: one ffuf output document per (CWE, event type, block of
    1000 event ids), results in event order.

    status by event_id % 5: 200, 301, 403, 404, 500; ``input`` omitted when
    event_id % 9 == 0; ``config`` omitted for k % 13 == 7; the files of
    k % 13 == 5 and event type ``error`` are cut in half (corrupt).
    """
    k13 = F.col("k") % 13
    blk = F.floor(F.col("event_id") / FUZZ_FILE_SPAN).cast("long")
    # dealt by the file's key while the rows are narrow (as in ``finding_rows``)
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _k().alias("k"))
    ev = ev.select("*", k13.alias("k13"), blk.alias("blk")).repartition("k13", "event_type", "blk")
    k13, blk = F.col("k13"), F.col("blk")
    cwe = F.coalesce(_pick(k13, [c for c, _ in CWE_BY_K13]), F.lit("CWE-Unknown"))
    status = _pick(F.col("event_id") % 5, ["200", "301", "403", "404", "500"])
    inp = F.when(F.col("event_id") % 9 == 0, F.lit("")).otherwise(
        F.concat(F.lit(', "input": {"FUZZ": "p'), F.col("event_id").cast("string"), F.lit('"}')))
    res = F.concat(
        F.lit('{"url": "http://t.example/u/'), F.col("user_id").cast("string"), F.lit('", '),
        F.lit('"status": '), status, F.lit(', "length": '), (F.col("k") * 10).cast("string"),
        F.lit(', "words": '), F.col("k").cast("string"), inp, F.lit("}"))
    name = F.concat(F.lit("ffuf_"), F.replace(cwe, F.lit("-"), F.lit("_")), F.lit("_"),
                    F.col("event_type"), F.lit("-"), blk.cast("string"), F.lit(".json"))
    rows = ev.select(name.alias("name"), "k13", "event_type", "blk", "event_id", res.alias("res"))
    per_file = (rows.groupBy("k13", "event_type", "blk")
                .agg(F.min("name").alias("name"), F.array_sort(F.collect_list(F.struct("event_id", "res"))).alias("rs")))
    results = F.array_join(F.transform("rs", lambda x: x["res"]), ", ")
    config = F.when(F.col("k13") == 7, F.lit("")).otherwise(F.concat(
        F.lit('"config": {"wordlist": "/SecLists/list-'), F.col("k13").cast("string"),
        F.lit('.txt", "url": "http://t.example/FUZZ"}, ')))
    doc = F.concat(F.lit("{"), config, F.lit('"results": ['), results, F.lit("]}"))
    corrupt = (F.col("k13") == 5) & (F.col("event_type") == "error")
    return per_file.select(
        F.concat(F.lit("/results/"), F.col("name")).alias("file"),
        F.when(corrupt, F.substring(doc, 1, F.floor(F.length(doc) / 2).cast("int")))
        .otherwise(doc).alias("text"))


# ---------------------------------------------------------------------------
# Mitigation replies and mitigation query vectors (events, embeddings)
# ---------------------------------------------------------------------------
def _mitigation_object(fixed_code_json: Column) -> Column:
    k = F.col("k").cast("string")
    return F.concat(
        F.lit('{"cwe_id": "'), F.coalesce("cwe_id", F.lit("CWE-Unknown")), F.lit('", '),
        F.lit('"explanation": "unsafe '), F.col("event_type"), F.lit(' handling reaches a sink", '),
        F.lit('"fixed_code": '), fixed_code_json, F.lit(", "),
        F.lit('"hardening": ["Validate input '), k, F.lit('", "Use least privilege"], '),
        F.lit('"references": ["CVE-2024-'), k, F.lit('"]}'))


def mitigation_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b_mitigation_replies: one reply per finding, keyed like its prompt.

    Form by event_id % 4: 0 plain object, 1 fenced, 2 ``fixed_code`` as a
    triple-quoted two-line block with quotes inside, 3 cut in half.
    """
    rows = finding_rows(spark, sf_dir)
    k = F.col("k").cast("string")
    plain = _mitigation_object(F.concat(F.lit('"x = '), k, F.lit('"')))
    triple = _mitigation_object(F.concat(F.lit('"""x = "'), k, F.lit('"\nreturn x"""')))
    form = F.col("event_id") % 4
    raw = (F.when(form == 0, plain)
           .when(form == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
           .when(form == 2, triple)
           .otherwise(F.substring(plain, 1, F.floor(F.length(plain) / 2).cast("int"))))
    return rows.select(
        F.concat_ws("#", "file", F.col("fn_ord").cast("string"),
                    F.col("finding_pos").cast("string")).alias("request_id"),
        raw.alias("raw"), F.lit(None).cast("string").alias("error"))


#: Mitigation replies that reach the rarer rules, by event_id % 6 ({k} is the event's k).
ODD_MITIGATIONS = [
    # a raw line feed inside a string is no JSON: the code is lifted out
    '{"explanation": "lifted", "fixed_code": "x = \\"{k}\\"\nreturn\\tx\\n", "hardening": ["h"], "references": ["r"]}',
    '{"explanation": "' + "e" * 250 + '", "fixed_code": "' + "\\n".join(f"line {i}" for i in range(25)) + '", '
    '"hardening": ["h1", "h2", "h3", "h4"], "references": ["r1", "r2", "r3", "r4", "r{k}"]}',
    '{"explanation": "k{k}", "fixed_code": "", "hardening": "only {k}"}',
    '{"explanation": null, "hardening": [], "references": [1.0, true]}',
    "z" * 1200,
    '{"explanation": {"why": true}, "references": null}',
]


def odd_mitigation_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b_odd_mitigations: one reply per event, of the forms above."""
    # dealt while the rows are narrow: texts are made and parsed by all tasks
    ev = table(spark, sf_dir, "events").select("event_id", _k().cast("string").alias("k")).repartition("event_id", "k")
    raw = F.replace(_pick(F.col("event_id") % len(ODD_MITIGATIONS), ODD_MITIGATIONS), F.lit("{k}"), F.col("k"))
    return ev.select(
        F.lit("odd.py").alias("file"), F.lit(0).alias("fn_ord"), F.col("event_id").cast("int").alias("finding_pos"),
        F.lit("f").alias("function"), F.lit("CWE-1").alias("cwe_id"), F.lit("HIGH").alias("severity"),
        raw.alias("raw"), F.lit(None).cast("string").alias("call_error"))


def odd_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b_odd_sources: a module per part, by p_partkey % 4: empty, without a
    function, lambdas only, nested and decorated definitions."""
    texts = ["", "# note\nx = 1\n", "f = lambda a: a\n",
             "@dec\nasync def g(a, /, b, *, c):\n    class K:\n        def m(self, *r):\n            return lambda: 0\n    return K\n"]
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("o_"), key.cast("string"), F.lit(".py")).alias("file"), _pick(key % 4, texts).alias("content"))


def mitigation_query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector of each mitigation query text: embedding ``k % n`` (the text
    is a function of the finding's k)."""
    # k decides everything in the text, so the distinct ones are found by it
    keys = table(spark, sf_dir, "events").select(_k().alias("k")).distinct()
    names = (_pick(F.col("k") % 13, [c for c, _ in CWE_BY_K13]), _pick(F.col("k") % 13, [n for _, n in CWE_BY_K13]))
    qt = F.concat(F.coalesce(names[0], F.lit("CWE-Unknown")), F.lit(" "), names[1],
                  F.lit(" mitigation fix secure code. "), F.lit("payload_"), F.col("k").cast("string"))
    keys = keys.select(qt.alias("query_text"), F.col("k").cast("long").alias("k"))
    return vector_for(keys, "k", spark, sf_dir).drop("k")
