"""Registered queries beyond the reply/findings slice."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import bindings as B
from .operators import retrieve as R
from .queries import register
from .session import checkpoint_dir, materialize
from .sources import kb as KB


def _folder(spark, name: str) -> str:
    """A fresh folder beside the checkpoints, for queries that write files
    and read them back through the library's own readers."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------------
# Knowledge base and retrieval
# ---------------------------------------------------------------------------
def _kb(spark, sf_dir):
    return B.kb_chunks(spark, sf_dir)


def _kb_queries(spark, sf_dir):
    return R.normalise_vectors(B.kb_query_vectors(spark, sf_dir))


@register("kb_scan")
def kb_scan(spark, sf_dir):
    return _kb(spark, sf_dir).select(
        "source", "chunk_pos", "chunk_id", "cve_id", "cwe_id", "cvss_severity", "cvss_score",
        "chunk_text", F.size("embedding").cast("int").alias("dim"))


@register("kb_from_files")
def kb_from_files(spark, sf_dir):
    """S1 + S2 on files: chunk tables written per source, read back and joined with their vectors."""
    kb, out = _kb(spark, sf_dir), _folder(spark, "kb")
    for source, schema in (("CWE", KB.CWE_SCHEMA), ("CVE", KB.CVE_SCHEMA)):
        kb.where(F.col("source") == source).select(*schema.fieldNames()).write.parquet(f"{out}/{source}")
    chunks = KB.read_chunks(spark, f"{out}/CWE", f"{out}/CVE")
    kb = KB.attach_embeddings(chunks, kb.select("source", "chunk_pos", "embedding"))
    return kb.select("source", "chunk_pos", "chunk_id", "cve_id", "cwe_id", "cvss_severity", "cvss_score",
                     "chunk_text", F.size("embedding").cast("int").alias("dim"))


@register("kb_from_rows")
def kb_from_rows(spark, sf_dir):
    """S2 by row order: chunk and vector tables without a position column,
    written as different numbers of files, paired by their places."""
    kb, out = _kb(spark, sf_dir), _folder(spark, "kb")
    for source in ("CWE", "CVE"):
        rows = kb.where(F.col("source") == source)
        for name, files, columns in (("chunks", 5, ["chunk_id", "cve_id", "chunk_text"]), ("vectors", 12, ["embedding"])):
            (rows.repartitionByRange(files, "chunk_pos").sortWithinPartitions("chunk_pos").select(*columns)
             .write.parquet(f"{out}/{name}/{source}"))
    chunks = KB.read_chunks(spark, f"{out}/chunks/CWE", f"{out}/chunks/CVE")
    pairs = KB.attach_embeddings(chunks, KB.read_vectors(spark, f"{out}/vectors/CWE", f"{out}/vectors/CVE"))
    return pairs.select("source", "chunk_pos", "chunk_id", "cve_id", "chunk_text", F.round(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("component_sum"))


@register("kb_attach_embeddings")
def kb_attach_embeddings(spark, sf_dir):
    kb = _kb(spark, sf_dir)
    chunks = kb.drop("embedding")
    vectors = kb.select("source", "chunk_pos", "embedding")
    out = KB.attach_embeddings(chunks, vectors)
    return out.select("source", "chunk_pos", F.size("embedding").cast("int").alias("dim"),
                      F.round(F.aggregate("embedding", F.lit(0.0),
                                          lambda a, x: a + x.cast("double")), 4)
                      .alias("component_sum"))


@register("kb_profile")
def kb_profile(spark, sf_dir):
    return KB.profile(_kb(spark, sf_dir), manifest=None)


@register("query_normalize")
def query_normalize(spark, sf_dir):
    raw = B.kb_query_vectors(spark, sf_dir)

    def norm(c):
        return F.round(F.sqrt(F.aggregate(c, F.lit(0.0),
                                          lambda a, x: a + x.cast("double") * x.cast("double"))), 6)
    n = R.normalise_vectors(raw.withColumn("norm_in", norm("embedding")))
    return n.select(F.col("query_id").cast("string").alias("query_id"),
                    F.size("embedding").cast("int").alias("dim"), "norm_in",
                    norm("embedding").alias("norm_out"))


@register("kb_similarity")
def kb_similarity(spark, sf_dir):
    p = R.similarity_profile(_kb_queries(spark, sf_dir), _kb(spark, sf_dir))
    return p.withColumn("max_score", F.round("max_score", 4))


@register("kb_similarity_filtered")
def kb_similarity_filtered(spark, sf_dir):
    p = R.similarity_profile(_kb_queries(spark, sf_dir), _kb(spark, sf_dir), min_severity="MEDIUM")
    return p.withColumn("max_score", F.round("max_score", 4))


@register("kb_topn_per_source")
def kb_topn_per_source(spark, sf_dir):
    t = R.top_n_per_source(_kb_queries(spark, sf_dir), _kb(spark, sf_dir), top_k=6)
    return t.withColumn("score", F.round("score", 4))


@register("kb_retrieve")
def kb_retrieve(spark, sf_dir):
    h = R.retrieve(_kb_queries(spark, sf_dir), _kb(spark, sf_dir), top_k=6)
    return h.select("query_id", "pos", "source", "chunk_pos", F.round("score", 4).alias("score"),
                    "chunk_id", "cve_id", "cvss_severity")


@register("rag_context")
def rag_context(spark, sf_dir):
    return R.retrieve_context(_kb_queries(spark, sf_dir), _kb(spark, sf_dir), top_k=6)


# ---------------------------------------------------------------------------
# Fuzz planning
# ---------------------------------------------------------------------------
from .operators import hits as H  # noqa: E402
from .operators import plan as P  # noqa: E402
from .operators import findings as A  # noqa: E402
from .functions import severity as sev  # noqa: E402
from .operators import replies as J  # noqa: E402
from .queries import nested_reports, ranked  # noqa: E402
from .sources import files as FS  # noqa: E402
from .sources import sinks as S  # noqa: E402
from .sources import wordlists as WL  # noqa: E402


def _plan_inputs(spark, sf_dir):
    findings = ranked(spark, sf_dir)
    targets = B.app_targets(B.app_functions(spark, sf_dir))
    return findings, targets, WL.map_table(spark)


@register("plan_cwe_dedupe")
def plan_cwe_dedupe(spark, sf_dir):
    return P.dedupe_cwes(ranked(spark, sf_dir))


@register("report_plan")
def report_plan(spark, sf_dir):
    """S6 -> F1: report documents in the reference's own format (no function
    order but the order of ``results``), read through the report schema."""
    nested = nested_reports(spark, sf_dir)
    result = F.struct("fn_ord", "function", "line_start", "line_end", "findings")
    docs = nested.groupBy("file").agg(F.array_sort(F.collect_list(result)).alias("r"))
    bare = F.transform("r", lambda x: F.struct(x["function"].alias("function"), x["line_start"].alias("line_start"),
                                              x["line_end"].alias("line_end"), x["findings"].alias("findings")))
    text = F.to_json(F.struct(F.struct(F.col("file").alias("target")).alias("meta"), bare.alias("results")))
    reports = docs.select(F.from_json(text, FS.REPORT_SCHEMA).alias("j")).select("j.*")
    return P.dedupe_cwes(FS.report_findings(reports))


@register("report_files")
def report_files(spark, sf_dir):
    """S9 -> S6 -> A1: reports written as JSON lines and read back."""
    out = _folder(spark, "reports")
    S.write_scan_reports(nested_reports(spark, sf_dir), None, out)
    back = FS.report_findings(FS.read_scan_reports(spark, out, lines=True))
    return back.select("file", "fn_ord", "function", "rank_pos", "cwe_id", "severity", "confidence")


@register("report_run")
def report_run(spark, sf_dir):
    """A10: the run document of a written scan, counted on the rows as they
    were written, and the reports' own meta."""
    out = _folder(spark, "reports")
    S.write_scan_reports(nested_reports(spark, sf_dir), None, out, model="llama3")
    metas = FS.read_scan_reports(spark, out, lines=True).select("meta.*").where(
        "duration_s > 0 and scan_date rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]{15}Z$'")
    reports = metas.groupBy("tool", "version", "model", "duration_s").agg(F.count(F.lit(1)).alias("n_reports"))
    run = spark.read.json(f"{out}-run")
    return run.join(reports, ["tool", "version", "model", "duration_s"]).select(
        "tool", "version", "model", "total_functions", "functions_with_findings", "total_findings",
        *sev.SEVERITY_LEVELS, "n_reports")


@register("report_requests")
def report_requests(spark, sf_dir):
    """A report is asked for per target; some documents are cut, some
    followed by other text and some were never written."""
    out = _folder(spark, "documents")
    nested = nested_reports(spark, sf_dir).select("file", "fn_ord", "function", "line_start", "line_end", "findings")
    docs = S.scan_reports(nested).select(F.col("meta.target").alias("target"), F.to_json(F.struct("meta", "summary", "results")).alias("t"))
    idx = F.regexp_extract("target", "app_([0-9]+)", 1).cast("long")
    bad = (F.when(idx % 5 == 1, F.expr("left(t, length(t) div 2)")).when(idx % 5 == 2, F.concat("t", F.lit("] x"))).otherwise(F.col("t")))
    (docs.where(idx % 7 != 3).select(F.col("target").alias("report"), bad.alias("value")).repartition("report")
     # a file per report: tasks move their own into place, the driver doesn't move them one by one
     .write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("report").text(out))
    asked = B.app_functions(spark, sf_dir).select(F.col("file").alias("path")).distinct()
    rows = FS.requested_reports(spark, out, asked, F.regexp_extract("file", "report=([^/]+)/", 1))
    return rows.select(
        "path", F.col("meta.target").alias("target"), F.size("results").cast("long").alias("n_results"),
        F.aggregate("results", F.lit(0), lambda a, r: a + F.size(r["findings"])).cast("long").alias("n_findings"), "error")


@register("plan_wordlists")
def plan_wordlists(spark, sf_dir):
    cwes = P.dedupe_cwes(ranked(spark, sf_dir))
    return P.lookup_wordlists(cwes, WL.map_table(spark), max_wordlists=2).select(
        "file", "cwe_id", "job_pos", "wordlist")


@register("fuzz_plan_jobs")
def fuzz_plan_jobs(spark, sf_dir):
    f, t, m = _plan_inputs(spark, sf_dir)
    return P.plan_jobs(f, t, m).select(
        "file", "plan_pos", "job_pos", "cwe_id", "cwe_name", "wordlist", "out_path",
        "wordlist_path", "target_url", "match_codes", "workers", "timeout_s", "url_encode")


@register("plan_target_check")
def plan_target_check(spark, sf_dir):
    return P.check_targets(B.app_targets(B.app_functions(spark, sf_dir)))


@register("plan_summary")
def plan_summary(spark, sf_dir):
    f, t, m = _plan_inputs(spark, sf_dir)
    valid = P.check_targets(t).where("valid").select("file")
    cwes = P.dedupe_cwes(f).join(valid, "file", "left_semi")
    jobs = P.plan_jobs(f, t, m)
    return P.plan_summary(valid, cwes, jobs)


@register("plan_collisions")
def plan_collisions(spark, sf_dir):
    f, t, m = _plan_inputs(spark, sf_dir)
    return P.output_collisions(P.plan_jobs(f, t, m, max_wordlists=4))


# ---------------------------------------------------------------------------
# Fuzz results
# ---------------------------------------------------------------------------
MATCH_CODES = "200, 403"


def _jobs(spark, sf_dir):
    return H.parse_files(B.fuzz_files(spark, sf_dir), MATCH_CODES)


@register("fuzz_job_parse")
def fuzz_job_parse(spark, sf_dir):
    return _jobs(spark, sf_dir).select("file", "cwe_id", "wordlist", "target", "hit_count", "error")


@register("fuzz_hits")
def fuzz_hits(spark, sf_dir):
    return H.explode_hits(_jobs(spark, sf_dir)).select(
        "file", "hit_pos", "url", "status", "length", "words", "input")


@register("fuzz_job_errors")
def fuzz_job_errors(spark, sf_dir):
    return _jobs(spark, sf_dir).where(F.col("error").isNotNull()).select("file", "error")


@register("fuzz_report")
def fuzz_report(spark, sf_dir):
    return H.report_totals(_jobs(spark, sf_dir))


@register("hits_by_cwe")
def hits_by_cwe(spark, sf_dir):
    return H.hits_by_cwe(_jobs(spark, sf_dir))


# ---------------------------------------------------------------------------
# Python corpus, query texts, scan prompts
# ---------------------------------------------------------------------------
from .operators import catalog as C  # noqa: E402
from .operators import prompts as PR  # noqa: E402


def corpus_catalog(spark, sf_dir):
    return C.catalog(B.source_files(spark, sf_dir))


@register("function_catalog")
def function_catalog(spark, sf_dir):
    return C.functions(corpus_catalog(spark, sf_dir)).select(
        "file", "fn_ord", "name", "lineno", "end_lineno",
        F.array_join("args", ", ").alias("args_text"), "docstring", "source")


@register("function_parse_errors")
def function_parse_errors(spark, sf_dir):
    return C.file_status(corpus_catalog(spark, sf_dir)).select("file", "parse_ok", "n_functions")


@register("rag_query_scan")
def rag_query_scan(spark, sf_dir):
    return C.scan_query_text(C.functions(corpus_catalog(spark, sf_dir))).select(
        "file", "fn_ord", "query_text")


@register("rag_query_tool")
def rag_query_tool(spark, sf_dir):
    return C.tool_query_text(C.functions(corpus_catalog(spark, sf_dir))).select(
        "file", "fn_ord", "query_text")


def corpus_contexts(spark, sf_dir, top_k: int = 6):
    qv = B.corpus_query_vectors(spark, sf_dir).select(
        R.function_query_id().alias("query_id"), "embedding")
    ctx = R.retrieve_context(R.normalise_vectors(qv), _kb(spark, sf_dir), top_k=top_k)
    return R.with_function_key(ctx)


@register("scan_prompts")
def scan_prompts(spark, sf_dir):
    fns = C.functions(corpus_catalog(spark, sf_dir))
    return PR.scan_prompts(fns, corpus_contexts(spark, sf_dir))


# ---------------------------------------------------------------------------
# Mitigations
# ---------------------------------------------------------------------------
from .operators import mitigations as M  # noqa: E402

MITIGATION_MIN_SEVERITY = "LOW"  # floored to MEDIUM (V5)


def _named_candidates(spark, sf_dir, findings=None):
    fns = B.app_functions(spark, sf_dir)
    findings = ranked(spark, sf_dir) if findings is None else findings
    named = findings.join(
        fns.select("file", "fn_ord", F.col("name").alias("function")), ["file", "fn_ord"])
    return M.candidates(named, MITIGATION_MIN_SEVERITY)


def _candidates(spark, sf_dir):
    return M.query_text(M.attach_source(_named_candidates(spark, sf_dir), B.app_functions(spark, sf_dir)))


def _with_context(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    ctx = M.contexts(c, B.mitigation_query_vectors(spark, sf_dir), _kb(spark, sf_dir))
    return M.with_contexts(c, ctx)


def _mitigation_rows(spark, sf_dir, findings=None):
    # replies are read back against the candidates' keys: neither source nor query text is needed
    return M.mitigation_rows(_named_candidates(spark, sf_dir, findings),
                             B.mitigation_replies(spark, sf_dir))


@register("mitigation_candidates")
def mitigation_candidates(spark, sf_dir):
    return _named_candidates(spark, sf_dir).select("file", "fn_ord", "finding_pos", "severity",
                                             "min_severity_filter")


@register("mitigation_source")
def mitigation_source(spark, sf_dir):
    return _candidates(spark, sf_dir).select("file", "fn_ord", "finding_pos", "function",
                                             "fn_source", "name_ambiguous")


@register("rag_query_mitigation")
def rag_query_mitigation(spark, sf_dir):
    return M.query_text(_named_candidates(spark, sf_dir)).select("file", "fn_ord", "finding_pos", "query_text")


@register("mitigation_context")
def mitigation_context(spark, sf_dir):
    vectors = B.mitigation_query_vectors(spark, sf_dir)  # one row per text
    ctx = M.contexts(M.query_text(_named_candidates(spark, sf_dir)), vectors, _kb(spark, sf_dir))
    texts = vectors.select(M.content_id("query_text").alias("query_id"), "query_text")
    return ctx.join(texts, "query_id").select("query_text", "context")


@register("mitigation_prompts")
def mitigation_prompts(spark, sf_dir):
    p = PR.mitigation_prompts(_with_context(spark, sf_dir))
    return p.select("file", "fn_ord", "finding_pos", M.request_id().alias("request_id"), "prompt")


@register("mitigation_repair")
def mitigation_repair(spark, sf_dir):
    c = _named_candidates(spark, sf_dir).withColumn("request_id", M.request_id())
    r = B.mitigation_replies(spark, sf_dir)
    j = c.select("file", "fn_ord", "finding_pos", "request_id").join(r, "request_id")
    rep = M.repair(j).withColumn("parse_ok", text_ok("repaired"))
    return rep.select("file", "fn_ord", "finding_pos", "repaired", "parse_ok")


def text_ok(c):
    from .functions import text as T
    return T.parse_json_object(c).isNotNull()


@register("mitigation_parse")
def mitigation_parse(spark, sf_dir):
    m = _mitigation_rows(spark, sf_dir)
    return m.select("file", "fn_ord", "finding_pos", "function", "cwe_id", "severity",
                    "explanation", "fixed_code",
                    F.array_join("hardening", " | ").alias("hardening_text"),
                    F.array_join("references", ", ").alias("references_text"),
                    "raw_response", "error")


@register("mitigation_odd_parse")
def mitigation_odd_parse(spark, sf_dir):
    """J12-J14 on replies that reach the lift, defaults, lone texts and cuts."""
    m = M.parse(M.repair(B.odd_mitigation_replies(spark, sf_dir)))
    return m.select("finding_pos", "explanation", "fixed_code", F.array_join("hardening", " | ").alias("hardening_text"),
                    F.array_join("references", ", ").alias("references_text"), "raw_response", "error")


@register("mitigation_odd_preview")
def mitigation_odd_preview(spark, sf_dir):
    """M3 on values longer than the preview shows."""
    return M.preview(M.parse(M.repair(B.odd_mitigation_replies(spark, sf_dir))))


@register("function_odd_files")
def function_odd_files(spark, sf_dir):
    """Modules without functions, nested and decorated definitions."""
    cat = C.catalog(B.odd_sources(spark, sf_dir))
    fns = C.functions(cat).select("file", "fn_ord", "name", "lineno", "end_lineno", F.array_join("args", ", ").alias("args_text"))
    return C.file_status(cat).select("file", "parse_ok", "n_functions").join(fns, "file", "left")


@register("mitigation_report")
def mitigation_report(spark, sf_dir):
    return M.report(_mitigation_rows(spark, sf_dir))


@register("mitigation_preview")
def mitigation_preview(spark, sf_dir):
    return M.preview(_mitigation_rows(spark, sf_dir))


@register("combined_report")
def combined_report(spark, sf_dir):
    # both parts read the parsed replies: written once, not parsed twice
    checked = materialize(J.checked_replies(B.replies(spark, sf_dir)))
    analysis = A.analyze_result_of(B.app_functions(spark, sf_dir), A.report_rows(checked))
    findings = A.report_findings(J.findings_of(checked))
    return M.combined(analysis, M.report(_mitigation_rows(spark, sf_dir, findings)))
