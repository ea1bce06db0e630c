"""Registered queries: one per operator group of the blueprint.

Each takes ``(spark, sf_dir)``, derives its inputs from the driver tables
through ``bindings`` and returns a flat DataFrame whose column names match
the oracle SQL of the same key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings as B
from .functions import severity as sev
from .operators import findings as A
from .operators import replies as J

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn
    return deco


def registry() -> dict[str, Query]:
    # Import the modules that register more queries.
    from . import queries_more  # noqa: F401
    return dict(_REGISTRY)


# ---------------------------------------------------------------------------
# Shared building blocks
# ---------------------------------------------------------------------------
def app_functions_with_status(spark, sf_dir) -> DataFrame:
    fns = B.app_functions(spark, sf_dir)
    rep = B.replies(spark, sf_dir).select("file", "fn_ord", "error")
    return fns.join(rep, A.FN_KEY, "left")


def validated(spark, sf_dir) -> DataFrame:
    return J.findings_from_replies(B.replies(spark, sf_dir))


def ranked(spark, sf_dir, min_severity: str = sev.DEFAULT_MIN_SEVERITY) -> DataFrame:
    """Report findings (filtered, ``sev_rank``), no shuffle."""
    return A.report_findings(validated(spark, sf_dir), min_severity)


def reports(spark, sf_dir, min_severity: str = sev.DEFAULT_MIN_SEVERITY) -> DataFrame:
    """One row per reply with its report list, kept in the row."""
    return A.report_rows(J.checked_replies(B.replies(spark, sf_dir)), min_severity)


# ---------------------------------------------------------------------------
# Replies (J1-J9, P3)
# ---------------------------------------------------------------------------
@register("reply_fence_strip")
def reply_fence_strip(spark, sf_dir):
    return J.strip_reply(B.replies(spark, sf_dir)).select("file", "fn_ord", "text")


@register("reply_array_parse")
def reply_array_parse(spark, sf_dir):
    p = J.parse_reply_arrays(B.replies(spark, sf_dir))
    return p.select("file", "fn_ord", "parse_status",
                    F.size("elements").cast("int").alias("n_elements"))


@register("reply_parse_status")
def reply_parse_status(spark, sf_dir):
    p = J.parse_reply_arrays(B.replies(spark, sf_dir))
    return p.groupBy("parse_status").agg(F.count(F.lit(1)).alias("n_replies"))


@register("reply_findings")
def reply_findings(spark, sf_dir):
    p = J.parse_reply_arrays(B.replies(spark, sf_dir))
    return J.object_elements(p).select("file", "fn_ord", "finding_pos")


@register("finding_validate")
def finding_validate(spark, sf_dir):
    v = J.findings_from_replies(B.replies(spark, sf_dir), keep_quarantine=True)
    return v.select("file", "fn_ord", "finding_pos", "cwe_id", "cwe_name", "severity",
                    "confidence", "line_hint", "description", "evidence", "solution",
                    F.array_join("references", "|").alias("references_text"),
                    "quarantine_reason")


@register("reply_odd_values")
def reply_odd_values(spark, sf_dir):
    """Number words, nested values, texts with quotes and backslashes,
    quarantined findings (J2, J3, J7-J9)."""
    v = J.findings_from_replies(B.odd_replies(spark, sf_dir), keep_quarantine=True)
    return v.select("request_id", "finding_pos", "cwe_id", "cwe_name", "severity", "confidence", "line_hint", "description",
                    "evidence", "solution", F.array_join("references", "|").alias("references_text"), "quarantine_reason")


@register("reply_join")
def reply_join(spark, sf_dir):
    fns = B.app_functions(spark, sf_dir).select(
        F.concat("file", F.lit("#"), F.col("fn_ord").cast("string")).alias("request_id"),
        "file", "fn_ord")
    return J.pair_replies(fns, B.replies(spark, sf_dir)).select(
        "request_id", "file", "fn_ord", "status", "error")


# ---------------------------------------------------------------------------
# Severity algebra and findings analytics (V, A)
# ---------------------------------------------------------------------------
@register("severity_rank")
def severity_rank(spark, sf_dir):
    v = validated(spark, sf_dir)
    return v.select("file", "fn_ord", "finding_pos", "severity_text",
                    sev.rank("severity_text").alias("raw_rank"), "severity",
                    sev.rank("severity").alias("sev_rank"))


@register("findings_min_severity")
def findings_min_severity(spark, sf_dir):
    return A.filter_min_severity(validated(spark, sf_dir), "MEDIUM").select(
        "file", "fn_ord", "finding_pos", "severity")


@register("findings_ranked")
def findings_ranked(spark, sf_dir):
    return A.rank_within_function(validated(spark, sf_dir)).select(
        "file", "fn_ord", "finding_pos", "severity", "rank_pos")


def nested_reports(spark, sf_dir) -> DataFrame:
    """Functions with their findings; one join by function brings error and list."""
    return A.nest_reports(B.app_functions(spark, sf_dir), reports(spark, sf_dir))


@register("findings_flatten")
def findings_flatten(spark, sf_dir):
    nested = nested_reports(spark, sf_dir)
    return A.flatten_findings(nested).select(
        "file", "fn_ord", "function", "rank_pos", "cwe_id", "severity", "confidence")


@register("severity_counts")
def severity_counts(spark, sf_dir):
    return A.severity_counts(ranked(spark, sf_dir))


@register("severity_counts_full")
def severity_counts_full(spark, sf_dir):
    files = B.app_functions(spark, sf_dir).select("file").distinct()
    return A.severity_counts_full_of(files, reports(spark, sf_dir))


@register("scan_summary")
def scan_summary(spark, sf_dir):
    return A.scan_totals_of(B.app_functions(spark, sf_dir), reports(spark, sf_dir))


@register("function_severity_text")
def function_severity_text(spark, sf_dir):
    return A.function_severity_text_of(B.app_functions(spark, sf_dir), reports(spark, sf_dir))


@register("references_preview")
def references_preview(spark, sf_dir):
    return A.references_preview(validated(spark, sf_dir)).select(
        "file", "fn_ord", "finding_pos", "references_preview")


@register("confidence_bands")
def confidence_bands(spark, sf_dir):
    return A.confidence_bands(validated(spark, sf_dir)).select(
        "file", "fn_ord", "finding_pos", "confidence", "band", "confidence_pct")


@register("scan_report")
def scan_report(spark, sf_dir):
    nested = nested_reports(spark, sf_dir)
    return nested.select(
        "file", "fn_ord", "function", "line_start", "line_end",
        F.size("findings").cast("long").alias("n_findings"),
        F.array_join(F.transform("findings", lambda f: F.concat(f["cwe_id"], F.lit(":"),
                                                                   f["severity"])), "|")
        .alias("findings_text"),
        "error", F.lit(A.REPORT_TOOL).alias("tool"), F.lit(A.REPORT_VERSION).alias("version"))


@register("analyze_result")
def analyze_result(spark, sf_dir):
    return A.analyze_result_of(B.app_functions(spark, sf_dir), reports(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model replies -> validated findings -> zero-filled severity counts."""
    return severity_counts_full(spark, sf_dir)
