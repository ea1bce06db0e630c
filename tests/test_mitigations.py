"""Mitigation reply repair and parse (J10-J14), M1 source back-fill."""
import re

from findings_lake.operators import mitigations as M


def parse_rows(spark, raws):
    df = spark.createDataFrame([(f"r{i}", r, None) for i, r in enumerate(raws)],
                               "request_id string, raw string, call_error string")
    return {r.request_id: r for r in M.parse(M.repair(df)).collect()}


def test_forms(spark):
    plain = '{"explanation": "e", "fixed_code": "x = 1", "hardening": ["h"], "references": ["r"]}'
    got = parse_rows(spark, [
        plain, "```json\n" + plain + "\n```",
        '{"explanation": "e", "fixed_code": """a "b"\nc""", "hardening": []}',
        plain[: len(plain) // 2],
        '{"explanation": "e"}',
        '{"fixed_code": "a\\nb", "explanation": "x", "bad": }',
    ])
    assert got["r0"].fixed_code == "x = 1" and got["r0"].hardening == ["h"]
    assert got["r1"].explanation == "e" and got["r1"].error is None
    assert got["r2"].fixed_code == 'a "b"\nc'
    assert got["r3"].error == M.PARSE_ERROR and got["r3"].raw_response == plain[: len(plain) // 2]
    assert got["r4"].fixed_code == "" and got["r4"].references == []
    assert got["r5"].error == M.PARSE_ERROR


def test_lift_fallback(spark):
    raw = '{"explanation": "e", "fixed_code": "line1\\nsay "hi"", "hardening": []}'
    r = parse_rows(spark, [raw])["r0"]
    assert r.error is None and r.fixed_code == 'line1\nsay "hi"' and r.explanation == "e"


def test_source_backfill_first_name(spark):
    fns = spark.createDataFrame([("f.py", 0, "a", "A0"), ("f.py", 1, "b", "B1"), ("f.py", 2, "a", "A2")],
                                "file string, fn_ord int, name string, source string")
    c = spark.createDataFrame([("f.py", 2, "a"), ("f.py", 1, "b"), ("g.py", 0, "a")],
                              "file string, fn_ord int, function string")
    got = {(r.file, r.fn_ord): (r.fn_source, r.name_ambiguous) for r in M.attach_source(c, fns).collect()}
    assert got == {("f.py", 2): ("A0", True), ("f.py", 1): ("B1", False), ("g.py", 0): ("", False)}


def test_source_unavailable_for_broken_target(spark):
    fns = spark.createDataFrame([("f.py", 0, "a", "A0")], "file string, fn_ord int, name string, source string")
    st = spark.createDataFrame([("f.py", True), ("b.py", False)], "file string, parse_ok boolean")
    c = spark.createDataFrame([("f.py", 0, "a"), ("b.py", 0, "x")], "file string, fn_ord int, function string")
    got = {r.file: r.fn_source for r in M.attach_source(c, fns, st).collect()}
    assert got == {"f.py": "A0", "b.py": "# source unavailable for x"}


REPLY = "file string, fn_ord int, finding_pos int, function string, cwe_id string, severity string, raw string, call_error string"


def test_preview_reads_each_reply_once(spark):
    df = spark.createDataFrame([], REPLY)
    plan = M.preview(M.parse(M.repair(df)))._jdf.queryExecution().optimizedPlan().toString()
    # no copies of the parse below, in a filter on ``error``
    n = len(re.findall(r"parseJson\(concat\(\[, repaired#", plan))
    assert n == 1, f"{n} parses of one text"
    filters = sum("Filter" in x and "parseJson" in x for x in plan.splitlines())
    assert filters == 0


def test_preview_of_odd_replies(spark):
    raws = ['{"fixed_code": "a\n\\"b\\"", "hardening": ["h"]}', '{"explanation": "x", "hardening": "only"}', '{"references": 1}', "zz", None,
            '{"fixed_code": null, "references": ["r", 1.0, null]}']
    df = spark.createDataFrame([("f", 0, i, "g", "CWE-1", "HIGH", r, None) for i, r in enumerate(raws)]
                               + [("f", 0, 9, "g", "CWE-1", "HIGH", raws[1], "late")], REPLY)
    got = {r.finding_pos: tuple(r)[6:] for r in M.preview(M.parse(M.repair(df))).collect()}
    assert got == {0: ("", "h", 'a\n"b"', ""), 1: ("x", "only", "", ""), 5: ("", "", "None", "r, 1.0, None")}
    errors = {r.finding_pos: r.error for r in M.parse(M.repair(df)).collect()}
    assert errors == {0: None, 1: None, 2: "references is not a list", 3: M.PARSE_ERROR, 4: "no reply", 5: None, 9: "late"}
