"""Findings kept in the reply row: plans, and equality with the exploded forms."""
import re

from conftest import SF001
from findings_lake import bindings as B, queries as Q
from findings_lake.operators import findings as A, replies as J


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def both(spark):
    replies, fns = B.replies(spark, SF001), Q.app_functions_with_status(spark, SF001)
    return fns, A.report_findings(J.findings_from_replies(replies)), A.report_rows(J.checked_replies(replies))


def test_same_results_as_the_exploded_forms(spark):
    fns, ranked, reports = both(spark)
    files = fns.select("file").distinct()
    bare = fns.drop("error")
    assert rows(A.nest_findings(fns, ranked)) == rows(A.nest_reports(fns, reports)) == rows(A.nest_reports(bare, reports).select(
        *A.nest_findings(fns, ranked).columns))
    assert rows(A.severity_counts_full(files, ranked)) == rows(A.severity_counts_full_of(files, reports))
    assert rows(A.scan_totals(fns, ranked)) == rows(A.scan_totals_of(fns, reports)) == rows(A.scan_totals_of(bare, reports))
    assert rows(A.function_severity_text(fns, ranked)) == rows(A.function_severity_text_of(fns, reports))
    assert rows(A.analyze_result(fns, ranked)) == rows(A.analyze_result_of(fns, reports))


def test_no_finding_is_collected_and_exchanges_are_few(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the plan of tables too large to broadcast
    try:
        plans = [plan(Q.registry()[name](spark, SF001)) for name in ("scan_report", "findings_flatten")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for p in plans:
        # the bindings deal events to replies (1), group each reply's text there, and list the functions (1)
        assert "SortMergeJoin" in p and len(re.findall(r"Exchange ", p)) <= 2, p
        assert len(re.findall(r"functions=\[.*collect_list", p)) <= 2  # partial and final of the binding's reply text
        assert "Window" not in p
    nested = A.nest_reports(spark.createDataFrame([], "file string, fn_ord int, name string, lineno int, end_lineno int"),
                            A.report_rows(J.checked_replies(spark.createDataFrame(
                                [], "request_id string, file string, fn_ord int, raw string, error string"))))
    assert "collect_list" not in plan(nested)


def test_minimum_severity_and_order(spark):
    raw = ('[{"severity": "low", "cwe_id": "a"}, {"severity": "HIGH", "cwe_id": "b"}, {"severity": "info", "cwe_id": "c"},'
           ' {"severity": "high", "cwe_id": "d"}, {"confidence": "x", "severity": "CRITICAL"}, 7]')
    df = spark.createDataFrame([("f#0", "f.py", 0, raw, None), ("f#1", "f.py", 1, None, "timeout")],
                               "request_id string, file string, fn_ord int, raw string, error string")
    checked = J.checked_replies(df)
    got = {r.fn_ord: [(x.cwe_id, x.finding_pos) for x in r.findings] for r in A.report_rows(checked).collect()}
    assert got == {0: [("b", 1), ("d", 3), ("a", 0)], 1: []}
    got = {r.fn_ord: [x.cwe_id for x in r.findings] for r in A.report_rows(checked, "HIGH").collect()}
    assert got[0] == ["b", "d"]
    assert [r.quarantine_reason for r in checked.where("fn_ord = 0").first().checked] == [None] * 4 + ["confidence is not a number"]


def test_flattening_keeps_the_parse_in_one_place(spark):
    fns = spark.createDataFrame([], "file string, fn_ord int, name string, lineno int, end_lineno int")
    checked = J.checked_replies(spark.createDataFrame([], "request_id string, file string, fn_ord int, raw string, error string"))
    p = A.flatten_findings(A.nest_reports(fns, A.report_rows(checked)))._jdf.queryExecution().optimizedPlan().toString()
    filters = sum("Filter" in x and "parseJson" in x for x in p.splitlines())
    assert filters == 0
