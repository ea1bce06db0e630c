"""Sources S1, S3, S5, sinks S10-S12 and the user API end to end."""
import json

from pyspark.sql import functions as F

from conftest import SF001
from findings_lake import bindings as B
from findings_lake.operators import hits as H, mitigations as M
from findings_lake.plans import api
from findings_lake.sources import files as FS, kb as KB, sinks as S, wordlists as WL


def test_manifest_and_profile(spark, tmp_path):
    p = tmp_path / "manifest.json"
    p.write_text(json.dumps({"embed_dim": 64, "cwe_chunks": 3, "cve_chunks": 1,
                             "cwe_ids_covered": ["CWE-89"]}, indent=2))
    kb = B.kb_chunks(spark, SF001)
    prof = {r.source: r for r in KB.profile(kb, KB.read_manifest(spark, str(p))).collect()}
    assert prof["CWE"].embed_model == KB.DEFAULT_EMBED_MODEL
    assert prof["CWE"].declared_chunks == 3 and prof["CVE"].declared_dim == 64
    assert prof["CWE"].n_chunks + prof["CVE"].n_chunks == kb.count()


def test_chunk_tables_and_attach(spark, tmp_path):
    cwe = spark.createDataFrame([(0, "c0", "t0"), (1, "c1", "t1")], KB.CWE_SCHEMA)
    cve = spark.createDataFrame([(0, "CVE-1", "CWE-1", "HIGH", 7.5, "v0")], KB.CVE_SCHEMA)
    cwe.write.parquet(str(tmp_path / "cwe"))
    cve.write.parquet(str(tmp_path / "cve"))
    chunks = KB.read_chunks(spark, str(tmp_path / "cwe"), str(tmp_path / "cve"))
    vec = spark.createDataFrame([("CWE", 0, [1.0, 0.0]), ("CWE", 1, [0.0, 1.0]), ("CVE", 0, [1.0, 1.0])],
                                "source string, chunk_pos long, embedding array<float>")
    kb = KB.attach_embeddings(chunks, vec)
    assert kb.count() == 3
    try:
        KB.attach_embeddings(chunks, vec.limit(2)).collect()
        raise AssertionError("count mismatch not detected")
    except Exception as e:
        assert "unpaired chunk or vector" in str(e)


def test_source_files_newlines(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"def f():\r\n    pass\r\ndef g():\r    pass\r")
    (tmp_path / "notes.txt").write_text("x")
    src = FS.read_source_files(spark, str(tmp_path))
    rows = src.collect()
    assert len(rows) == 1 and "\r" not in rows[0].content
    fns, status = api.scan_queries(src)
    assert [r.lineno for r in fns.orderBy("fn_ord").collect()] == [1, 3]
    assert fns.first().embed_text.startswith("search_query: Python function 'f'")


def test_fuzz_and_combined_sinks(spark, tmp_path):
    jobs = H.parse_files(B.fuzz_files(spark, SF001), "200")
    S.write_fuzz_report(jobs, str(tmp_path / "fuzz"))
    summ = spark.read.json(str(tmp_path / "fuzz/summary")).first()
    assert summ.total_hits == jobs.agg(F.sum("hit_count")).first()[0]
    assert spark.read.json(str(tmp_path / "fuzz/jobs")).count() == jobs.count()
    comb = spark.createDataFrame([("t.py", "ok", 3, 2, None, 1, 0)],
                                 "target string, analysis_status string, functions_scanned long, "
                                 "total_findings long, fuzzing string, mitigations_total long, "
                                 "mitigation_errors long")
    rows = spark.createDataFrame([("t.py", "CWE-1")], "file string, cwe_id string")
    S.write_combined(comb, str(tmp_path / "comb"), findings=rows, mitigations=rows)
    docs = [json.loads(x) for p in (tmp_path / "comb" / "summary").iterdir() if p.suffix == ".json"
            for x in p.read_text().splitlines()]
    assert [(d["target"], d["fuzzing"]) for d in docs] == [("t.py", None)]
    assert spark.read.json(str(tmp_path / "comb" / "findings")).first().target == "t.py"


def test_api_end_to_end(spark, tmp_path):
    fns = B.app_functions(spark, SF001)
    res = api.scan_results(fns, B.replies(spark, SF001))
    assert res.quarantine.count() == 0
    total = res.totals.agg(F.sum("total_findings")).first()[0]
    assert total == res.findings.count() > 0
    named = res.findings.join(fns.select("file", "fn_ord", F.col("name").alias("function")),
                              ["file", "fn_ord"])
    targets = B.app_targets(fns)
    plan = api.plan_jobs(named, targets, WL.map_table(spark))
    S.write_job_plan(plan, str(tmp_path / "plan"))
    assert spark.read.parquet(str(tmp_path / "plan")).count() == plan.count() > 0
    prompts = api.mitigation_prompts(named, fns, B.mitigation_query_vectors(spark, SF001),
                                     B.kb_chunks(spark, SF001), min_severity="HIGH")
    rows, report = api.mitigation_results(prompts, B.mitigation_replies(spark, SF001))
    assert rows.count() == named.where(F.col("severity").isin("HIGH", "CRITICAL")).count()
    assert report.agg(F.sum("total")).first()[0] == rows.count()
    assert rows.where(F.col("error") == M.PARSE_ERROR).count() > 0


def test_api_scan_prompts(spark):
    fns, status = api.scan_queries(B.source_files(spark, SF001))
    qv = B.corpus_query_vectors(spark, SF001)
    prompts = api.scan_prompts(fns, qv, B.kb_chunks(spark, SF001))
    n = fns.count()
    assert prompts.count() == n > 0
    p = prompts.orderBy("file", "fn_ord").first().prompt
    assert "--- FUNCTION: f_" in p and "[Ref 1 | " in p and p.endswith("<|end_header_id|>\n\n")
    assert status.where("NOT parse_ok").count() == 0  # sf0.001 has 5 modules, none at index 13
