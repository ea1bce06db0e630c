"""User-level entry points: the reference's tools as DataFrame functions.

The two outside calls (embedding model, language model) split each tool in
two halves: one builds the table handed to the outside job (queries or
prompts), the other consumes the table that comes back (vectors or
replies). Everything between is a lazy Spark plan.

| reference entry            | here                                              |
|----------------------------|---------------------------------------------------|
| ``scan_file`` / ``analyze_code`` | ``scan_queries`` -> ``scan_prompts`` -> ``scan_results`` |
| ``KnowledgeBase.retrieve``  | ``retrieve`` (operators.retrieve)                |
| ``generate_fuzz_script``    | ``plan_jobs``                                    |
| ``parse_fuzz_results``      | ``parse_results``                                |
| ``suggest_mitigations``     | ``mitigation_prompts`` -> ``mitigation_results`` |
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..operators import catalog as C
from ..operators import findings as A
from ..operators import hits as H
from ..operators import mitigations as M
from ..operators import plan as P
from ..operators import prompts as PR
from ..operators import replies as J
from ..operators import retrieve as R
from ..session import materialize

retrieve = R.retrieve


def scan_queries(source_files: DataFrame, tool_variant: bool = False) -> tuple[DataFrame, DataFrame]:
    """Catalogue the corpus; return ``(functions, file_status)`` where
    ``functions`` carries the retrieval ``query_text`` (R1, or R2 for the
    tool variant) to embed with the ``search_query: `` prefix."""
    cat = C.catalog(source_files)
    fns = C.functions(cat)
    fns = C.tool_query_text(fns) if tool_variant else C.scan_query_text(fns)
    return fns.withColumn("embed_text", R.query_text_prefixed(F.col("query_text"))), C.file_status(cat)


def scan_prompts(functions: DataFrame, query_vectors: DataFrame, kb: DataFrame,
                 top_k: int = R.DEFAULT_TOP_K, min_severity: str = sev.DEFAULT_MIN_SEVERITY
                 ) -> DataFrame:
    """Prompts for every function. ``query_vectors``: ``file, fn_ord,
    embedding`` (the embedded ``embed_text``)."""
    qv = query_vectors.select(
        R.function_query_id().alias("query_id"), "embedding")
    ctx = R.retrieve_context(R.normalise_vectors(qv), kb, top_k, min_severity)
    return PR.scan_prompts(functions, R.with_function_key(ctx))


@dataclass
class ScanResult:
    findings: DataFrame       # validated, filtered, ranked (flat)
    quarantine: DataFrame     # finding objects the reference would crash on
    nested: DataFrame         # one row per function with its findings array
    totals: DataFrame         # per target file (A4, A5, C5)
    counts: DataFrame         # per target file, five levels (A2)
    tool_result: DataFrame    # per target file (A11)


def scan_results(functions: DataFrame, replies: DataFrame,
                 min_severity: str = sev.DEFAULT_MIN_SEVERITY,
                 checkpoint: bool = True) -> ScanResult:
    """Replies -> findings and report tables.

    The validated findings feed six outputs; with ``checkpoint`` the replies
    (one per request) are parsed once and written to the shared checkpoint folder.
    """
    status = J.pair_replies(
        functions.select("file", "fn_ord",
                         F.concat("file", F.lit("#"), F.col("fn_ord").cast("string"))
                         .alias("request_id")), replies)
    fns = functions.join(status.select("file", "fn_ord", "error"), ["file", "fn_ord"], "left")
    checked = J.checked_replies(J.one_reply(replies))
    if checkpoint:
        checked = materialize(checked)
    allv = J.findings_of(checked, keep_quarantine=True)
    ranked = A.report_findings(allv.where(F.col("quarantine_reason").isNull()), min_severity)
    reports = A.report_rows(checked.drop("error"), min_severity)
    files = fns.select("file").distinct()
    return ScanResult(
        findings=ranked,
        quarantine=allv.where(F.col("quarantine_reason").isNotNull()),
        nested=A.nest_reports(fns, reports),
        totals=A.scan_totals_of(fns, reports),
        counts=A.severity_counts_full_of(files, reports),
        tool_result=A.analyze_result_of(fns, reports))


def plan_jobs(findings: DataFrame, targets: DataFrame, wordlist_map: DataFrame,
              max_wordlists: int = P.DEFAULT_MAX_WORDLISTS,
              match_codes: str = P.DEFAULT_MATCH_CODES, url_encode: bool = True) -> DataFrame:
    """The fuzz job table. ``findings`` need ``function`` order keys
    (``fn_ord`` and ``rank_pos`` or ``finding_pos``); ``targets``: ``file, target_url``."""
    return P.plan_jobs(findings, targets, wordlist_map, max_wordlists, match_codes, url_encode)


def parse_results(files: DataFrame, match_codes: str = H.DEFAULT_MATCH_CODES) -> DataFrame:
    """H1-H6: job rows from ``(file, text)`` fuzzer outputs."""
    return H.parse_files(files, match_codes)


def mitigation_prompts(findings: DataFrame, functions: DataFrame, query_vectors: DataFrame,
                       kb: DataFrame, min_severity: str = sev.DEFAULT_MITIGATION_SEVERITY,
                       top_k: int = R.DEFAULT_TOP_K, apply_floor: bool = False,
                       file_status: DataFrame | None = None) -> DataFrame:
    """One prompt per finding at or above the
    threshold. ``findings`` need ``function`` (the name); ``query_vectors``:
    ``query_text, embedding``; ``file_status`` (from ``scan_queries``) marks
    targets that no longer parse."""
    c = M.query_text(M.attach_source(M.candidates(findings, min_severity, apply_floor),
                                     functions, file_status))
    ctx = M.contexts(c, query_vectors, kb, top_k)
    p = PR.mitigation_prompts(M.with_contexts(c, ctx))
    return p.withColumn("request_id", M.request_id())


def mitigation_results(prompts: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, report)``."""
    rows = M.mitigation_rows(prompts, replies)
    return rows, M.report(rows)
