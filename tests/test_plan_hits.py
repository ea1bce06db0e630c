"""Fuzz planning (F1-F8) and fuzz results (H1-H8)."""
import json

from findings_lake.operators import hits as H, plan as P
from findings_lake.sources import files as FS, wordlists as WL


def findings_df(spark, rows):
    return spark.createDataFrame(
        [("t.py", i, 0, c, f"name {c}", s) for i, (c, s) in enumerate(rows)],
        "file string, fn_ord int, rank_pos int, cwe_id string, cwe_name string, severity string")


def test_dedupe_example(spark):
    f = findings_df(spark, [("CWE-89", "LOW"), ("CWE-89", "HIGH"), ("CWE-20", "HIGH"), ("", "CRITICAL")])
    got = [(r.cwe_id, r.severity) for r in P.dedupe_cwes(f).orderBy("plan_pos").collect()]
    assert got == [("CWE-89", "HIGH"), ("CWE-20", "HIGH")]


def test_job_rows_and_collision(spark):
    f = findings_df(spark, [("CWE-89", "HIGH"), ("CWE-79", "LOW"), ("CWE-1", "LOW")])
    t = spark.createDataFrame([("t.py", "http://x/FUZZ")], "file string, target_url string")
    jobs = P.plan_jobs(f, t, WL.map_table(spark), max_wordlists=2)
    paths = {(r.cwe_id, r.job_pos): r.out_path for r in jobs.collect()}
    assert paths[("CWE-89", 0)] == "/results/ffuf_CWE_89_MySQL-SQLi-Login-Bypass.fuzzdb.json"
    assert paths[("CWE-1", 0)] == "/results/ffuf_CWE_1_common.json"
    coll = P.output_collisions(jobs).collect()
    assert [(r.out_path, r.n_jobs) for r in coll] == [("/results/ffuf_CWE_79_XSS-Jhaddix.json", 2)]


def test_empty_plan_summary(spark):
    files = spark.createDataFrame([("t.py",)], "file string")
    f = findings_df(spark, [])
    cw = P.dedupe_cwes(f)
    t = spark.createDataFrame([("t.py", "http://x/FUZZ")], "file string, target_url string")
    s = P.plan_summary(files, cw, P.plan_jobs(f, t, WL.map_table(spark))).first()
    assert (s.n_jobs, s.n_cwes, s.cwe_list) == (0, 0, "none")


def test_target_without_marker_gets_no_plan(spark):
    f = findings_df(spark, [("CWE-89", "HIGH")])
    t = spark.createDataFrame([("t.py", "http://x/")], "file string, target_url string")
    assert P.plan_jobs(f, t, WL.map_table(spark)).count() == 0


def test_map_file_skips_comment(spark, tmp_path):
    p = tmp_path / "map.json"
    p.write_text(json.dumps({"_comment": "x", **WL.DEFAULT_WORDLIST_MAP}))
    m = {r.cwe_id: r.wordlists for r in WL.read_map(spark, str(p)).collect()}
    assert m == WL.DEFAULT_WORDLIST_MAP


def test_fuzz_files_from_directory(spark, tmp_path):
    d = tmp_path / "fuzz"
    d.mkdir()
    (d / "ffuf_CWE_89_x.json").write_text(json.dumps({
        "config": {"wordlist": "w", "url": "u"},
        "results": [{"url": "a", "status": 200, "length": 1, "words": 2, "input": {"FUZZ": "p"}},
                    {"url": "b", "status": 404}, {"url": "c", "status": 403}]}))
    (d / "ffuf_CWE_89.json").write_text(json.dumps({"results": [{"url": "n", "status": 200}]}, indent=2))
    (d / "ffuf_x.json").write_text('{"results": [')
    (d / "other.json").write_text("{}")
    jobs = H.parse_files(FS.read_fuzz_outputs(spark, str(d)), "200, 403")
    got = {r.file.rsplit("/", 1)[1]: r for r in jobs.collect()}
    assert set(got) == {"ffuf_CWE_89_x.json", "ffuf_CWE_89.json", "ffuf_x.json"}
    a = got["ffuf_CWE_89_x.json"]
    assert (a.cwe_id, a.wordlist, a.target, a.hit_count) == ("CWE-89", "w", "u", 2)
    assert [h.input for h in a.hits] == ["p", ""]
    b = got["ffuf_CWE_89.json"]
    assert (b.cwe_id, b.wordlist, b.target, b.hit_count) == ("CWE-89", "unknown", "unknown", 1)
    c = got["ffuf_x.json"]
    assert c.error is not None and c.hit_count == 0 and c.cwe_id is None
    tot = H.report_totals(jobs).first()
    assert (tot.n_jobs, tot.n_errors, tot.total_hits) == (3, 1, 3)


def test_empty_directory(spark, tmp_path):
    files = spark.createDataFrame([], "file string, text string")
    tot = H.report_totals(H.parse_files(files)).first()
    assert (tot.status, tot.n_jobs, tot.total_hits) == ("ok", 0, 0)


def test_file_name_rule(spark):
    df = spark.createDataFrame([(n,) for n in ["/r/ffuf_CWE_89_x.json", "ffuf_CWE_89.json", "ffuf_x.json"]],
                               "file string")
    assert [r[0] for r in df.select(H.cwe_from_name(df.file)).collect()] == ["CWE-89", "CWE-89", None]
    assert H.match_code_set("200, 403") == [200, 403]


def test_wordlist_cap_python_slice(spark):
    f = findings_df(spark, [("CWE-79", "HIGH")])
    cw = P.dedupe_cwes(f)
    m = WL.map_table(spark)
    n = {cap: P.lookup_wordlists(cw, m, cap).count() for cap in (0, 1, 2, 10, -1, -5)}
    assert n == {0: 0, 1: 1, 2: 2, 10: 4, -1: 3, -5: 0}
