"""Row positions of files (S2), requested reports (S6), measured runs."""
import json

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from findings_lake import bindings as B, queries as Q
from findings_lake.operators import findings as A, replies as J
from findings_lake.sources import files as FS, kb as KB, sinks as S


def write_parts(spark, folder, parts, schema):
    """One Parquet file per part, named part-<number>, rows in order."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder.mkdir(parents=True)
    for number, rows in parts.items():
        pq.write_table(pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(schema)}),
                       folder / f"part-{number}.parquet", row_group_size=3)


def test_positions_follow_files_and_rows(spark, tmp_path):
    import pyarrow as pa

    parts = {9: [(f"a{k}",) for k in range(7)], 10: [(f"b{k}",) for k in range(4)], 2: [(f"c{k}",) for k in range(5)], 11: []}
    write_parts(spark, tmp_path / "t", parts, [("v", pa.string())])
    got = {r.v: r.chunk_pos for r in KB.file_positions(spark, str(tmp_path / "t")).collect()}
    order = [f"c{k}" for k in range(5)] + [f"a{k}" for k in range(7)] + [f"b{k}" for k in range(4)]
    assert got == {v: k for k, v in enumerate(order)}


def test_chunks_and_vectors_without_positions_are_paired(spark, tmp_path):
    import pyarrow as pa

    n = 40
    chunk = lambda lo, hi: [(f"id{k}", f"text {k}") for k in range(lo, hi)]
    vec = lambda lo, hi: [([float(k), 1.0],) for k in range(lo, hi)]
    chunk_schema = [("chunk_id", pa.string()), ("chunk_text", pa.string())]
    vec_schema = [("embedding", pa.list_(pa.float32()))]
    write_parts(spark, tmp_path / "cwe", {0: chunk(0, 25), 1: chunk(25, n)}, chunk_schema)
    write_parts(spark, tmp_path / "cve", {0: chunk(0, 3)}, [("cve_id", pa.string()), ("chunk_text", pa.string())])
    write_parts(spark, tmp_path / "wv", {0: vec(0, 1), 1: vec(1, 30), 2: vec(30, n)}, vec_schema)
    write_parts(spark, tmp_path / "vv", {0: vec(0, 2), 1: vec(2, 3)}, vec_schema)
    kb = KB.attach_embeddings(KB.read_chunks(spark, str(tmp_path / "cwe"), str(tmp_path / "cve")),
                              KB.read_vectors(spark, str(tmp_path / "wv"), str(tmp_path / "vv")))
    rows = kb.collect()
    assert len(rows) == n + 3
    assert all(r.chunk_text == f"text {int(r.embedding[0])}" and r.chunk_pos == r.embedding[0] for r in rows)
    p = KB.file_positions(spark, str(tmp_path / "cwe"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in p and "Window" not in p
    write_parts(spark, tmp_path / "short", {0: vec(0, 39)}, vec_schema)
    with pytest.raises(Exception, match="unpaired chunk or vector"):
        KB.attach_embeddings(KB.read_chunks(spark, str(tmp_path / "cwe"), str(tmp_path / "cve")),
                             KB.read_vectors(spark, str(tmp_path / "short"), str(tmp_path / "vv"))).collect()


def test_requested_reports(spark, tmp_path):
    doc = {"meta": {"target": "t.py"}, "results": [{"function": "f", "findings": [{"cwe_id": "CWE-1", "severity": "HIGH"}]}]}
    texts = {"good.json": json.dumps(doc, indent=2), "cut.json": json.dumps(doc)[:-20], "tail.json": json.dumps(doc) + " x",
             "list.json": "[]", "empty.json": "", "bare.json": "{}", "word.json": '{"results": "none"}', "sp ace+é.json": json.dumps(doc),
             "unasked.json": json.dumps(doc)}
    (tmp_path / "r").mkdir()
    for name, t in texts.items():
        (tmp_path / "r" / name).write_text(t)
    asked = [n for n in texts if n != "unasked.json"] + ["absent.json"]
    requested = spark.createDataFrame([(str(tmp_path / "r" / n),) for n in asked + asked[:2]], "path string")
    rows = {r.path.rsplit("/", 1)[1]: r for r in FS.requested_reports(spark, str(tmp_path / "r"), requested).collect()}
    assert set(rows) == set(asked)
    assert {n: (r.error, len(r.results)) for n, r in rows.items() if n not in ("absent.json", "empty.json")} == {
        "good.json": (None, 1), "sp ace+é.json": (None, 1), "bare.json": (None, 0), "word.json": (FS.NO_LIST, 0),
        **{n: (FS.BROKEN, 0) for n in ("cut.json", "tail.json", "list.json")}}
    for absent in (rows["absent.json"], rows["empty.json"]):  # a file without a byte is skipped by Spark's readers
        assert absent.error == FS.NOT_FOUND.format(absent.path) and absent.results == []
    good = FS.report_findings(spark.createDataFrame([rows["good.json"]], FS.requested_reports(spark, str(tmp_path / "r"), requested).schema))
    assert [(r.target, r.function, r.cwe_id) for r in good.collect()] == [("t.py", "f", "CWE-1")]


def test_run_figures_are_measured_on_the_written_rows(spark, tmp_path):
    fns = B.app_functions(spark, SF001)
    reports = A.report_rows(J.checked_replies(B.replies(spark, SF001)))
    nested, out = A.nest_reports(fns, reports), str(tmp_path / "reports")
    run = S.write_scan_reports(nested, None, out)
    doc = spark.read.json(out + "-run").first()
    back = FS.read_scan_reports(spark, out, lines=True)
    assert doc.total_functions == run["total_functions"] == fns.count()
    assert doc.total_findings == FS.report_findings(back).count() == sum(run[s] for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))
    assert doc.duration_s == run["duration_s"] > 0 and doc.report_path == out
    meta = [r.meta for r in back.collect()]
    assert {m.duration_s for m in meta} == {run["duration_s"]} and len({m.target for m in meta}) == len(meta)
    rows = S.tool_results(A.analyze_result_of(fns, reports), run).collect()
    assert {(r.report_path, r.duration_s) for r in rows} == {(out, run["duration_s"])}
    assert sum(r.total_findings for r in rows) == run["total_findings"]
    fixed = S.write_scan_reports(nested, None, out, duration_s=12.345)
    assert fixed["duration_s"] == round(12.345, 2)
    empty = S.write_scan_reports(nested.limit(0), None, str(tmp_path / "none"))
    assert empty["total_functions"] == empty["total_findings"] == empty["HIGH"] == 0


def test_fuzzer_file_with_text_behind_its_object_is_refused(spark):
    from findings_lake.operators import hits as H
    texts = {"ok": '{"results": []}', "behind": '{"results": []}] x', "two": '{"results": []}, {"results": []}', "list": '[{"results": []}]'}
    df = spark.createDataFrame([(f"/r/ffuf_CWE_1_{k}.json", t) for k, t in texts.items()], "file string, text string")
    got = {r.file.rsplit("_", 1)[1][:-5]: r.error for r in H.parse_files(df, "200").collect()}
    assert got["ok"] is None and all(got[k] for k in ("behind", "two", "list"))


def test_reports_parse_their_rows_once(spark):
    from findings_lake.sources import sinks

    rows = spark.createDataFrame([("b.py", 1, "g", 1, 2, []), ("b.py", 0, "f", 1, 2, [("CWE-1", "HIGH")]), ("a.py", 0, "f", 1, 2, [])],
                                 "file string, fn_ord int, function string, line_start int, line_end int, findings array<struct<cwe_id string, severity string>>")
    marked = rows.withColumn("findings", F.filter("findings", lambda x: F.length(x["cwe_id"]) > -5))
    reports = sinks.scan_reports(marked)
    plan = reports._jdf.queryExecution().optimizedPlan().toString()
    scans = plan.count("LogicalRDD") + plan.count("LocalRelation")
    assert scans == 1 and "Join" not in plan
    got = {r.meta.target: (r.summary.total_functions, r.summary.functions_with_findings, r.summary.total_findings, r.summary.by_severity.HIGH,
                           [x.function for x in r.results]) for r in reports.collect()}
    assert got == {"a.py": (1, 0, 0, 0, ["f"]), "b.py": (2, 1, 1, 1, ["f", "g"])}
