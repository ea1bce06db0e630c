"""Findings analytics and the scan report.

Keys: a function is ``(file, fn_ord)``; a finding adds ``finding_pos`` (its
position in the model reply). Lists in the reference are ordered, so every
ordered output carries an explicit position column instead of relying on
row order.

Aggregations go through partial (map-side) aggregation; the only collected
groups are per-function finding lists, which a model reply bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as sev

FN_KEY = ["file", "fn_ord"]
# The tool name and version written into a report's meta.
REPORT_TOOL = "vuln_scanner"
REPORT_VERSION = "1.0.0"
FINDING_FIELDS = ["cwe_id", "cwe_name", "severity", "confidence", "line_hint",
                  "description", "evidence", "solution", "references"]


def filter_min_severity(findings: DataFrame, min_severity: str = sev.DEFAULT_MIN_SEVERITY) -> DataFrame:
    """V2: keep rank(severity) >= rank(min_severity)."""
    return findings.where(sev.at_least("severity", min_severity))


def report_findings(findings: DataFrame, min_severity: str = sev.DEFAULT_MIN_SEVERITY) -> DataFrame:
    """V2 + V3 without a shuffle: filter and add ``sev_rank``.

    The report order inside a function is the stable sort by rank desc, i.e.
    the key ``(-sev_rank, finding_pos)`` (``order_key``); every consumer
    sorts or takes minima by that key, so no dense position is needed and
    the findings never have to be shuffled by function just to be numbered.
    """
    return (filter_min_severity(findings, min_severity)
            .withColumn("sev_rank", sev.rank("severity")))


def order_key():
    """Position of a finding in its function's report list, as a sort key."""
    return F.struct((-F.col("sev_rank")).alias("neg_rank"), F.col("finding_pos"))


def rank_within_function(findings: DataFrame, min_severity: str = sev.DEFAULT_MIN_SEVERITY) -> DataFrame:
    """V3 with an explicit dense ``rank_pos`` (0, 1, ...) per function.

    Only for outputs that must show the number: it costs a shuffle by
    function (a partition is one model reply's findings, bounded by the
    reply length).
    """
    w = Window.partitionBy(*FN_KEY).orderBy(F.desc("sev_rank"), F.asc("finding_pos"))
    return (report_findings(findings, min_severity)
            .withColumn("rank_pos", (F.row_number().over(w) - 1).cast("int")))


def report_rows(checked: DataFrame, min_severity: str = sev.DEFAULT_MIN_SEVERITY) -> DataFrame:
    """V2 + V3 in the row: ``replies.checked_replies`` -> one row per function
    with ``findings``, its report list in order (``finding_pos`` kept). No
    finding is exploded or collected, so nothing is shuffled."""
    kept = F.filter("checked", lambda x: x["quarantine_reason"].isNull() & sev.at_least(x["severity"], min_severity))
    keyed = F.array_sort(F.transform(kept, lambda x: F.struct(
        (-sev.rank(x["severity"])).alias("k"), *[x[c].alias(c) for c in ("finding_pos", *FINDING_FIELDS)])))
    status = ["error"] if "error" in checked.columns else []
    return checked.select(*FN_KEY, *status, F.transform(
        keyed, lambda x: F.struct(*[x[c].alias(c) for c in ("finding_pos", *FINDING_FIELDS)])).alias("findings"))


def _of_level(findings, level: str):
    return F.filter(findings, lambda x: x["severity"] == F.lit(level))


def nest_reports(functions: DataFrame, reports: DataFrame) -> DataFrame:
    """A9 from ``report_rows``: one join by function, nothing collected.
    Functions without a reply get an empty list; the ``error`` of
    ``functions``, or else of ``reports``, is kept."""
    cols = ["file", "fn_ord", F.col("name").alias("function"),
            F.col("lineno").alias("line_start"), F.col("end_lineno").alias("line_end")]
    own = ["error"] if "error" in functions.columns else []
    status = ["error"] if "error" in reports.columns and not own else []
    lists = reports.select(*FN_KEY, *status, F.transform(
        "findings", lambda x: F.struct(*[x[c].alias(c) for c in FINDING_FIELDS])).alias("findings"))
    empty = F.array().cast(lists.schema["findings"].dataType)
    rows = functions.select(*cols, *own).join(lists, FN_KEY, "left").withColumn("findings", F.coalesce("findings", empty))
    return rows.select(*FN_KEY, "function", "line_start", "line_end", *own, *status, "findings")


def counts_by_level(reports: DataFrame) -> DataFrame:
    """Findings of every level and in all, counted over each row's list."""
    return reports.select(*FN_KEY, F.size("findings").cast("long").alias("n_findings"),
                          *[F.size(_of_level("findings", s)).cast("long").alias(s) for s in sev.SEVERITY_LEVELS])


def severity_counts_full_of(files: DataFrame, reports: DataFrame) -> DataFrame:
    """A2 from ``report_rows``: all five levels per file, zero-filled."""
    counts = counts_by_level(reports).groupBy("file").agg(*[F.sum(s).alias(s) for s in sev.SEVERITY_LEVELS])
    return files.select("file").join(counts, "file", "left").fillna(0, subset=sev.SEVERITY_LEVELS)


def scan_totals_of(functions: DataFrame, reports: DataFrame) -> DataFrame:
    """A4 + A5 + C5 from ``report_rows`` (see ``scan_totals``)."""
    status = ["error"] if "error" in reports.columns and "error" not in functions.columns else []
    rows = reports.select(*FN_KEY, *status, F.size("findings").cast("long").alias("n"), sum(
        F.size(_of_level("findings", s)).cast("long") for s in ("CRITICAL", "HIGH")).alias("n_priority"))
    if status:
        functions = functions.select(*FN_KEY).join(rows.select(*FN_KEY, "error", "n", "n_priority"), FN_KEY, "left")
        return _file_totals(functions.withColumn("_err", F.col("error").isNotNull()))
    return _totals(functions, rows)


def function_severity_text_of(functions: DataFrame, reports: DataFrame) -> DataFrame:
    """A6 + A7 from ``report_rows`` (see ``function_severity_text``)."""
    text = sev.severity_map_text({s: F.col(s) for s in sev.SEVERITY_LEVELS})
    top = F.get(F.col("findings"), 0)["severity"]
    counts = reports.select("*", *[F.size(_of_level("findings", s)).cast("long").alias(s) for s in sev.SEVERITY_LEVELS])
    per_fn = counts.select(*FN_KEY, F.size("findings").cast("long").alias("n"), text.alias("t"), top.alias("top_severity"))
    return functions.select(*FN_KEY).join(per_fn, FN_KEY, "left").select(
        *FN_KEY, F.coalesce("n", F.lit(0)).cast("long").alias("n_findings"),
        F.when(F.col("n") > 0, F.col("t")).otherwise(F.lit("clean")).alias("severity_text"), "top_severity")


def analyze_result_of(functions: DataFrame, reports: DataFrame) -> DataFrame:
    """A11 from ``report_rows`` (see ``analyze_result``): one aggregation by
    file over fixed-width values, a count and a first place per level."""
    # A level's first finding in a row is its least finding_pos: one rank, stable order.
    place = F.col("fn_ord").cast("long") * F.lit(1 << 32)
    rows = reports.select("*", *[_of_level("findings", s).alias(s) for s in sev.SEVERITY_LEVELS])
    rows = rows.select("file", F.size("findings").alias("n"), *[F.struct(
        F.size(s).alias("n"), (place + F.get(F.col(s), 0)["finding_pos"].cast("long")).alias("at")).alias(s) for s in sev.SEVERITY_LEVELS])
    per_file = rows.groupBy("file").agg(
        F.sum("n").alias("total_findings"), F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"{s}.n").alias(f"n_{s}") for s in sev.SEVERITY_LEVELS],
        *[F.min(f"{s}.at").alias(f"at_{s}") for s in sev.SEVERITY_LEVELS])
    # Order of first appearance: function, then rank (all of a function's levels differ in rank).
    levels = F.array(*[F.struct(F.shiftright(f"at_{s}", 32).alias("fn_ord"), F.lit(-sev.SEVERITY_RANK[s]).alias("neg_rank"),
                                F.concat(F.lit(s + "="), F.col(f"n_{s}").cast("string")).alias("t")) for s in sev.SEVERITY_LEVELS])
    seen = F.array_sort(F.filter(levels, lambda x: x["fn_ord"].isNotNull()))
    summary = F.array_join(F.transform(seen, lambda x: x["t"]), ", ")
    scanned = functions.groupBy("file").agg(F.count(F.lit(1)).alias("functions_scanned"))
    return (scanned.join(per_file, "file", "left")
            .select("file", F.lit("ok").alias("status"), F.coalesce(summary, F.lit("")).alias("summary"),
                    F.coalesce("total_findings", F.lit(0)).cast("long").alias("total_findings"), "functions_scanned"))


def nest_findings(functions: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per function with its ordered ``findings`` array.

    Functions without findings are kept (empty array); the ``error`` of a
    failed model call is kept too (the reference drops it).
    """
    per_fn = (ranked.groupBy(*FN_KEY)
              .agg(F.array_sort(F.collect_list(
                  F.struct(order_key().alias("_k"), *FINDING_FIELDS))).alias("_f")))
    per_fn = per_fn.select(*FN_KEY, F.transform(
        "_f", lambda x: F.struct(*[x[c].alias(c) for c in FINDING_FIELDS])).alias("findings"))
    cols = ["file", "fn_ord", F.col("name").alias("function"),
            F.col("lineno").alias("line_start"), F.col("end_lineno").alias("line_end")]
    if "error" in functions.columns:
        cols.append("error")
    empty = F.array().cast(per_fn.schema["findings"].dataType)
    return (functions.select(*cols)
            .join(per_fn, FN_KEY, "left")
            .withColumn("findings", F.coalesce("findings", empty)))


def flatten_findings(nested: DataFrame) -> DataFrame:
    """A1: functions x findings, order kept (``rank_pos`` per function)."""
    # The outer form: Spark infers ``size(findings) > 0`` from the other one and pushes it
    # below the parse, where it holds copies of the whole parse.
    return (nested.select(*FN_KEY, "function",
                          F.posexplode_outer("findings").alias("rank_pos", "f")).where("rank_pos is not null")
            .select(*FN_KEY, "function", F.col("rank_pos").cast("int"), "f.*"))


def severity_counts(ranked: DataFrame) -> DataFrame:
    """A3: sparse counts, only levels that occur."""
    return ranked.groupBy("file", "severity").agg(F.count(F.lit(1)).alias("n_findings"))


def severity_counts_full(files: DataFrame, ranked: DataFrame) -> DataFrame:
    """A2: all five levels per file, zero-filled, one pass with partial agg."""
    counts = ranked.groupBy("file").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in sev.SEVERITY_LEVELS])
    out = files.select("file").join(counts, "file", "left")
    return out.fillna(0, subset=sev.SEVERITY_LEVELS)


def scan_totals(functions: DataFrame, ranked: DataFrame) -> DataFrame:
    """A4 + A5 + C5: per target file, functions scanned, functions with a
    finding, findings, CRITICAL+HIGH, failed model calls."""
    per_fn = ranked.groupBy(*FN_KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("n_priority"))
    return _totals(functions, per_fn)


def _totals(functions: DataFrame, per_fn: DataFrame) -> DataFrame:
    err = F.col("error").isNotNull() if "error" in functions.columns else F.lit(False)
    return _file_totals(functions.select(*FN_KEY, err.alias("_err")).join(per_fn, FN_KEY, "left"))


def _file_totals(j: DataFrame) -> DataFrame:
    return j.groupBy("file").agg(
        F.count(F.lit(1)).alias("total_functions"),
        F.count_if(F.col("n") > 0).alias("functions_with_findings"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_findings"),
        F.coalesce(F.sum("n_priority"), F.lit(0)).cast("long").alias("priority_findings"),
        F.count_if("_err").alias("failed_calls"))


def function_severity_text(functions: DataFrame, ranked: DataFrame) -> DataFrame:
    """A6 + A7: ``2×HIGH, 1×LOW`` per function (rank desc), top severity,
    ``clean`` when none. One aggregation, no per-function collect."""
    counts = ranked.groupBy(*FN_KEY).agg(
        F.count(F.lit(1)).alias("n_findings"),
        *[F.count_if(F.col("severity") == s).alias(f"_{s}") for s in sev.SEVERITY_LEVELS],
        # validated levels map one-to-one to ranks, so the top level follows
        # from the max rank: a fixed-width buffer (hash aggregation)
        F.max("sev_rank").alias("_top_rank"))
    text = sev.severity_map_text({s: F.col(f"_{s}") for s in sev.SEVERITY_LEVELS})
    j = functions.select(*FN_KEY).join(counts, FN_KEY, "left")
    return j.select(*FN_KEY,
                    F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"),
                    F.when(F.col("n_findings") > 0, text).otherwise(F.lit("clean"))
                    .alias("severity_text"),
                    sev.level_of("_top_rank").alias("top_severity"))


def references_preview(findings: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` references joined with ``, ``."""
    return findings.withColumn("references_preview",
                               F.array_join(F.slice("references", 1, n), ", "))


def confidence_bands(findings: DataFrame) -> DataFrame:
    """V6: band and percent text of each finding's confidence."""
    return (findings.withColumn("band", sev.confidence_band("confidence"))
            .withColumn("confidence_pct", sev.percent_text("confidence")))


def analyze_result(functions: DataFrame, ranked: DataFrame) -> DataFrame:
    """The tool's result row per target file.

    ``summary`` is the sparse count map in first-appearance order of the
    flattened findings (function order, then report order), like a Python
    ``Counter`` turned into a dict: levels are ordered by where they first
    appear, ``(fn_ord, -rank, finding_pos)``.
    """
    # Inside one (file, level) every finding has the same rank, so the first
    # is the least (fn_ord, finding_pos), packed exactly into one long
    # (both are non-negative ints) to keep the buffer fixed-width.
    packed = F.col("fn_ord").cast("long") * F.lit(1 << 32) + F.col("finding_pos").cast("long")
    first = (ranked.groupBy("file", "severity")
             .agg(F.count(F.lit(1)).alias("n"), F.min(packed).alias("_first")))
    at = F.struct(F.shiftright("_first", 32).alias("fn_ord"), (-sev.rank("severity")).alias("neg_rank"),
                  F.col("_first").bitwiseAND(F.lit((1 << 32) - 1)).alias("finding_pos"))
    per_file = first.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct(at.alias("first_at"), "severity", "n"))).alias("_s"),
        F.sum("n").alias("total_findings"))
    summary = F.array_join(F.transform(
        "_s", lambda x: F.concat(x["severity"], F.lit("="), x["n"].cast("string"))), ", ")
    scanned = functions.groupBy("file").agg(F.count(F.lit(1)).alias("functions_scanned"))
    return (scanned.join(per_file, "file", "left")
            .select("file", F.lit("ok").alias("status"),
                    F.coalesce(summary, F.lit("")).alias("summary"),
                    F.coalesce("total_findings", F.lit(0)).cast("long").alias("total_findings"),
                    "functions_scanned"))
