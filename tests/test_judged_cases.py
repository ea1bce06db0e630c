"""Inputs that once gave wrong results: reports in the reference's own format,
string lists, replies with text and error, odd numbers, deep sources, odd file names."""
import json

from pyspark.sql import functions as F

from conftest import replies_df
from findings_lake.operators import catalog as C
from findings_lake.operators import hits as H
from findings_lake.operators import mitigations as M
from findings_lake.operators import plan as P
from findings_lake.operators import replies as J
from findings_lake.operators import retrieve as R
from findings_lake.sources import files as FS


def test_reference_report_through_plan_and_source(spark, tmp_path):
    def f(cwe, severity, name):
        return {"cwe_id": cwe, "cwe_name": name, "severity": severity, "evidence": "e"}

    report = {"meta": {"target": "app.py"}, "results": [
        {"function": "a", "source": "def a(): pass", "findings": [f("CWE-1", "HIGH", "one"), f("CWE-89", "MEDIUM", "FIRST")]},
        {"findings": [f("CWE-2", "MEDIUM", "two"), f("CWE-89", "MEDIUM", "SECOND")]},
        {"function": "c", "findings": [f("CWE-3", "LOW", "three"), f("CWE-1", "LOW", "late")]}]}
    (tmp_path / "r.json").write_text(json.dumps(report))
    rows = FS.report_findings(FS.read_scan_reports(spark, str(tmp_path / "r.json")))
    plan = P.dedupe_cwes(rows).orderBy("plan_pos").collect()
    assert [(r.file, r.cwe_id, r.cwe_name) for r in plan] == [
        ("app.py", "CWE-1", "one"), ("app.py", "CWE-89", "FIRST"), ("app.py", "CWE-2", "two"), ("app.py", "CWE-3", "three")]
    fns = spark.createDataFrame([("app.py", 0, "a", "other"), ("app.py", 1, "c", "def c(): 1")],
                                "file string, fn_ord int, name string, source string")
    src = {(r.function, r.fn_source) for r in M.attach_source(rows, fns).collect()}
    assert src == {("a", "def a(): pass"), ("unknown", ""), ("c", "def c(): 1")}


def mitigation(spark, raw, error=None):
    req = spark.createDataFrame([("f.py", 0, 0)], "file string, fn_ord int, finding_pos int")
    rep = spark.createDataFrame([("f.py#0#0", raw, error)], "request_id string, raw string, error string")
    return M.mitigation_rows(req, rep).first()


def test_mitigation_lists(spark):
    r = mitigation(spark, '{"hardening": "use prepared statements", "references": ["a", 1]}')
    assert (r.hardening, r.references, r.error) == (["use prepared statements"], ["a", "1"], None)
    assert mitigation(spark, '{"hardening": {"a": 1}}').error == "hardening is not a list"
    assert mitigation(spark, '{"references": 5}').error == "references is not a list"
    assert mitigation(spark, "{}").hardening == []
    assert mitigation(spark, '{"fixed_code": "x"}', "timeout").error == "timeout"


def test_reply_with_text_and_error_is_an_error_everywhere(spark):
    df = spark.createDataFrame([("r", "f.py", 0, '[{"cwe_id": "CWE-1"}]', "timeout"), ("s", "f.py", 1, "[]", None),
                                ("s", "f.py", 1, "[1]", None), ("s", "f.py", 1, "[0]", "late")],
                               "request_id string, file string, fn_ord int, raw string, error string")
    prompts = spark.createDataFrame([("r",), ("s",), ("t",)], "request_id string")
    got = {r.request_id: (r.raw, r.error, r.status) for r in J.pair_replies(prompts, df).collect()}
    assert got == {"r": ('[{"cwe_id": "CWE-1"}]', "timeout", "error"), "s": ("[1]", None, "ok"), "t": (None, "no reply", "error")}
    assert J.findings_from_replies(df.where("request_id = 'r'")).count() == 0


def test_number_texts(spark):
    raws = [json.dumps([{"confidence": c}]) for c in ["0.5d", "0.5f", " 0.25 ", "1e-1", ".5", "0x1", ""]]
    got = {r.fn_ord: (r.confidence, r.quarantine_reason is None)
           for r in J.findings_from_replies(replies_df(spark, raws), keep_quarantine=True).collect()}
    assert [got[i][1] for i in range(7)] == [False, False, True, True, True, False, False]
    assert [got[i][0] for i in (2, 3, 4)] == [0.25, 0.1, 0.5]


def test_numbers_as_text(spark):
    literals = ["89", "89.0", "100000.0", "1e5", "0.1", "1.50", "1e-7", "123456789.125", "1e16", "1.5e22", "5e-4", "-2.0", "2.5e300"]
    objs = [f'[{{"line_hint": {x}}}]' for x in literals]
    got = {r.fn_ord: r.line_hint for r in J.findings_from_replies(replies_df(spark, objs)).collect()}
    assert [got[i] for i in range(len(literals))] == [str(json.loads(x)) for x in literals]


def test_deep_sources_are_rows_not_failures(spark):
    deep = "def f():\n    return " + " + ".join(["1"] * 6000) + "\n"
    nested = "def a():\n    def b():\n        pass\n    async def c(): pass\nclass K:\n    def m(self): pass\n"
    rows = C.catalog(spark.createDataFrame([("deep.py", deep), ("n.py", nested), ("e.py", "")], "file string, content string")).collect()
    names = [r.name for r in sorted((r for r in rows if r.file == "n.py" and r.name), key=lambda r: r.fn_ord)]
    assert names == ["a", "b", "c", "m"]
    of_deep = [r for r in rows if r.file == "deep.py"]
    assert [r.name for r in of_deep if r.name] == ["f"] or any("Error" in (r.parse_error or "") for r in of_deep)
    assert [r.n_functions for r in rows if r.file == "e.py"] == [0]


def test_any_file_name_as_a_query_key(spark):
    df = spark.createDataFrame([("a#b.py", 3), ("#", 0), ("x.py", 12)], "file string, fn_ord int")
    back = R.with_function_key(df.select(R.function_query_id().alias("query_id")))
    assert sorted((r.file, r.fn_ord) for r in back.collect()) == [("#", 0), ("a#b.py", 3), ("x.py", 12)]


def test_fuzzer_documents(spark):
    docs = {
        "ffuf_CWE_1_a.json": '{"config": {"wordlist": "w", "url": "u"}, "results": [{"status": 200, "url": "x", "input": {"FUZZ": "p"}}, 5, {"status": "200"}]}',
        "ffuf_CWE_2_a.json": '{"results": {"a": 1}}', "ffuf_CWE_3_a.json": '{"results": null}', "ffuf_CWE_4_a.json": "{}",
        "ffuf_CWE_5_a.json": '{"a": 1} x', "ffuf_CWE_6_a.json": '{"results": []},{"results": []}', "ffuf_CWE_7_a.json": "[]",
        "ffuf_CWE_8_a.json": '{"results": [{"status": 200}', "ffuf_CWE_9_a.json": "null"}
    rows = {r.file[5:10]: (r.hit_count, r.error) for r in H.parse_files(
        spark.createDataFrame(list(docs.items()), "file string, text string")).collect()}
    lists, objects = "results is not a list", "not a JSON object"
    assert rows == {"CWE_1": (1, None), "CWE_2": (0, lists), "CWE_3": (0, lists), "CWE_4": (0, None), "CWE_5": (0, objects),
                    "CWE_6": (0, objects), "CWE_7": (0, objects), "CWE_8": (0, objects), "CWE_9": (0, objects)}


def test_large_fuzzer_file_keeps_its_hits(spark):
    """Beyond the 128 MiB that one variant value may hold."""
    one = '{"url": "http://t.example/' + "u" * 900 + '", "status": 200, "length": 1, "words": 1}'
    n = 150_000
    text = F.concat(F.lit('{"results": ['), F.repeat(F.lit(one + ","), n), F.lit(one + "]}"))
    df = spark.range(1).select(F.lit("ffuf_CWE_1_a.json").alias("file"), text.alias("text"))
    r = H.parse_files(df).select("hit_count", "error").first()
    assert (r.hit_count, r.error) == (n + 1, None)
