"""Report sinks.

Every writer is a distributed Spark write; nothing is assembled on the
driver. Rows are clustered by target into as many files as there are shuffle
partitions (never a folder or file per target), and every document names its
target. A scan report is one JSON line per target in the shape that
``files.read_scan_reports`` reads; what grows with the corpus (jobs, findings,
mitigations) is written as rows beside the summaries.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import rounding
from ..functions import severity as sev
from ..operators import findings as A


def scan_date() -> F.Column:
    """A10: UTC ISO-8601 text with microseconds and a trailing ``Z``."""
    return F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def _level_sizes(findings) -> list:
    def of(level):
        return F.filter(findings, lambda x: x["severity"] == F.lit(level))
    return [F.size(of(s)).alias(s) for s in sev.SEVERITY_LEVELS]


def _summary_counts(nested: DataFrame, *more) -> DataFrame:
    """Per target file the counts of its summary, over the rows' own lists in
    one aggregation (and what ``more`` aggregates in the same one)."""
    n = F.size("findings")
    return nested.groupBy("file").agg(
        F.count(F.lit(1)).alias("total_functions"), F.count_if(n > 0).alias("functions_with_findings"),
        F.sum(n).cast("long").alias("total_findings"),
        *[F.sum(c).cast("long").alias(s) for c, s in zip(_level_sizes(F.col("findings")), sev.SEVERITY_LEVELS)], *more)


def _header(model: str, duration_s: float) -> list:
    return [
        F.struct(F.lit(A.REPORT_TOOL).alias("tool"), F.lit(A.REPORT_VERSION).alias("version"),
                 F.col("file").alias("target"), F.lit(model).alias("model"),
                 scan_date().alias("scan_date"),
                 rounding.round2(F.lit(float(duration_s))).alias("duration_s")).alias("meta"),
        F.struct("total_functions", "functions_with_findings", "total_findings",
                 F.struct(*[F.col(s) for s in sev.SEVERITY_LEVELS]).alias("by_severity"))
        .alias("summary")]


def scan_summaries(nested: DataFrame, model: str = "llama3", duration_s: float = 0.0) -> DataFrame:
    """S9 header rows: per target file, ``meta`` and ``summary`` (with a
    zero-filled ``by_severity``)."""
    return _summary_counts(nested).select("file", *_header(model, duration_s))


def scan_results(nested: DataFrame) -> DataFrame:
    """S9 result rows: one per function, in report order by ``fn_ord``."""
    cols = ["file", "fn_ord", "function", "line_start", "line_end", "findings"]
    if "error" in nested.columns:
        cols.append("error")
    return nested.select(*cols)


def scan_reports(nested: DataFrame, model: str = "llama3", duration_s: float = 0.0) -> DataFrame:
    """One report per target file: ``meta``, ``summary`` and the
    ``results`` of its functions in order (a target is one source file)."""
    rows = scan_results(nested)
    result = F.struct("fn_ord", *[c for c in rows.columns if c != "fn_ord"])
    # counts and results in one aggregation: ``nested`` (a parse) is computed once
    return (_summary_counts(rows, F.array_sort(F.collect_list(result)).alias("results"))
            .where(F.col("file").isNotNull()).select(*_header(model, duration_s), "results"))


def write_scan_reports(nested: DataFrame, ranked: DataFrame | None, out_dir: str, model: str = "llama3",
                       duration_s: float | None = None, mode: str = "overwrite") -> dict:
    """S9 + A10: reports as JSON lines; read back by ``read_scan_reports(..., lines=True)``.

    The result rows are computed once and written to ``<out_dir>-rows``; what
    is observed on the very rows that pass (functions, findings, findings per
    level) and the seconds the pass took (unless ``duration_s`` is given) go
    into the reports and into the run document ``<out_dir>-run``, which is
    also returned. (``ranked`` is not needed any more: counts come from the rows' own lists.)
    """
    base, spark = out_dir.rstrip("/"), nested.sparkSession
    seen, size = Observation("scan"), F.size("findings")
    levels = _level_sizes(F.col("findings"))
    start = time.monotonic()
    scan_results(nested).observe(
        seen, F.count(F.lit(1)).alias("total_functions"), F.count_if(size > 0).alias("functions_with_findings"),
        F.sum(size).cast("long").alias("total_findings"), *[F.sum(c).cast("long").alias(s) for c, s in zip(levels, sev.SEVERITY_LEVELS)],
    ).write.mode(mode).parquet(f"{base}-rows")
    took = time.monotonic() - start if duration_s is None else duration_s
    counts = {k: v or 0 for k, v in seen.get.items()}
    scan_reports(spark.read.parquet(f"{base}-rows"), model, took).write.mode(mode).json(out_dir)
    run = {"tool": A.REPORT_TOOL, "version": A.REPORT_VERSION, "model": model, "report_path": out_dir,
           "duration_s": round(took, 2), **counts}
    kinds = "tool string, version string, model string, report_path string, duration_s double, " + ", ".join(f"{k} long" for k in counts)
    spark.createDataFrame([tuple(run.values())], kinds).coalesce(1).write.mode(mode).json(f"{base}-run")
    return run


def tool_results(analysis: DataFrame, run: dict) -> DataFrame:
    """A11 in full: the result rows of ``analyze_result`` with the report's
    path and the measured ``duration_s`` of the run that wrote it."""
    return analysis.withColumn("report_path", F.lit(run["report_path"])).withColumn("duration_s", F.lit(run["duration_s"]))


def write_fuzz_report(jobs: DataFrame, out_dir: str, results_dir: str | None = None,
                      mode: str = "overwrite") -> None:
    """``summary`` (status, results folder, jobs, hits) and ``jobs`` (one
    JSON line per output file, hits nested)."""
    from ..operators import hits as H
    summary = H.report_totals(jobs).withColumn("results_dir", F.lit(results_dir).cast("string"))
    summary.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(f"{out_dir}/summary")
    jobs.write.mode(mode).json(f"{out_dir}/jobs")


def write_combined(combined: DataFrame, out_dir: str, findings: DataFrame | None = None,
                   mitigations: DataFrame | None = None, mode: str = "overwrite") -> None:
    """``summary``, one document per target (unused parts stay as JSON
    null), and the full ``findings`` and ``mitigations`` rows, keyed by
    ``target``, where they are given."""
    combined.write.mode(mode).option("ignoreNullFields", False).json(f"{out_dir}/summary")
    for name, rows in (("findings", findings), ("mitigations", mitigations)):
        if rows is not None:
            (rows.withColumnRenamed("file", "target").repartition("target").sortWithinPartitions("target")
             .write.mode(mode).json(f"{out_dir}/{name}"))


def write_job_plan(plan: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """The fuzz job table (not a shell script), clustered by target file."""
    plan.repartition("file").sortWithinPartitions("file").write.mode(mode).parquet(out_dir)
