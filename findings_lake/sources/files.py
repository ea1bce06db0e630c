"""Whole-file text sources.

Each file becomes one row ``(file, text)``; the path comes from the hidden
``_metadata.file_path`` column. A file is the reference's unit of work (a
Python module, a scan report, one fuzzer run), so it must fit one task; many
small files are packed into splits by ``spark.sql.files.openCostInBytes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

FUZZ_GLOB = "ffuf_*.json"
# Fixed value: the message of an absent report.
NOT_FOUND = "Report not found at {}. Run analyze_code first."
BROKEN = "report is not one JSON object"
NO_LIST = "results is not a list"

FINDING_STRUCT = T.StructType([
    T.StructField("cwe_id", T.StringType()),
    T.StructField("cwe_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("line_hint", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("solution", T.StringType()),
    T.StructField("references", T.ArrayType(T.StringType())),
])
RESULT_STRUCT = T.StructType([
    T.StructField("function", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("fn_ord", T.IntegerType()),
    T.StructField("line_start", T.IntegerType()),
    T.StructField("line_end", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("findings", T.ArrayType(FINDING_STRUCT)),
])
REPORT_SCHEMA = T.StructType([
    T.StructField("meta", T.StructType([
        T.StructField("tool", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("scan_date", T.StringType()),
        T.StructField("duration_s", T.DoubleType()),
    ])),
    T.StructField("summary", T.StructType([
        T.StructField("total_functions", T.LongType()),
        T.StructField("functions_with_findings", T.LongType()),
        T.StructField("total_findings", T.LongType()),
        T.StructField("by_severity", T.MapType(T.StringType(), T.LongType())),
    ])),
    T.StructField("results", T.ArrayType(RESULT_STRUCT)),
])


def whole_text(spark: SparkSession, path: str, glob: str | None = None,
               recursive: bool = False) -> DataFrame:
    # text()'s own wholetext argument defaults to False and would override
    # an .option("wholetext", ...), so it is passed here.
    df = spark.read.text(path, wholetext=True, pathGlobFilter=glob,
                         recursiveFileLookup=recursive)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_source_files(spark: SparkSession, path: str, glob: str = "*.py") -> DataFrame:
    """Python files as ``(file, content)``; ``\\r\\n`` and lone ``\\r``
    become ``\\n`` (universal newlines, as Python's text read does)."""
    df = whole_text(spark, path, glob, recursive=True)
    return df.select("file", F.regexp_replace("text", "\\r\\n?", "\n").alias("content"))


def read_fuzz_outputs(spark: SparkSession, results_dir: str) -> DataFrame:
    """``ffuf_*.json`` directly in ``results_dir`` (not recursive)."""
    return whole_text(spark, results_dir, FUZZ_GLOB)


def read_scan_reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Scan reports, one document per file or (``lines``) one per line, as
    ``sinks.write_scan_reports`` writes them; a missing ``results`` reads as empty."""
    df = spark.read.schema(REPORT_SCHEMA).option("multiLine", not lines).json(path)
    return df.withColumn("results", F.coalesce("results", F.array().cast(
        T.ArrayType(RESULT_STRUCT))))


def plain_path(uri: Column) -> Column:
    """A file's path without its scheme and with its real characters."""
    path = F.regexp_replace(uri, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def requested_reports(spark: SparkSession, folder: str, requested: DataFrame, key: Column | None = None) -> DataFrame:
    """S6 with its failures: one row per ``path`` of ``requested`` with
    ``meta, summary, results`` and ``error``.

    The documents under ``folder`` are read as whole texts; one that is cut,
    followed by other text or no object, or whose ``results`` is no list, and
    a requested one that isn't there, gives an error row with empty
    ``results`` instead of ending the run. ``key`` tells the requested path of
    a file from its ``file`` (by default the path itself). Documents nobody
    asked for are left out; if several files have one key the least path counts.
    A file without a byte counts as absent (Spark's readers skip it).
    """
    docs = whole_text(spark, folder, recursive=True)
    docs = docs.select((plain_path(F.col("file")) if key is None else key).alias("path"), "file", "text")
    # every file is read once and dealt by its path once, for the choice and for the join
    first = docs.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("file"))).where("_n = 1")
    typed = text.one_typed_object(F.col("text"), ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in REPORT_SCHEMA))
    read = first.select("path", typed.alias("d"), F.lit(True).alias("there"),
                                                                   F.array_contains(F.json_object_keys("text"), "results").alias("listed"))
    rows = requested.select("path").distinct().join(read, "path", "left")
    error = (F.when(F.col("there").isNull(), F.format_string(NOT_FOUND.replace("{}", "%s"), "path"))
             .when(F.col("d").isNull(), F.lit(BROKEN))
             .when(F.col("d.results").isNull() & F.coalesce("listed", F.lit(False)), F.lit(NO_LIST)))
    empty = F.array().cast(T.ArrayType(RESULT_STRUCT))
    return rows.select("path", "d.meta", "d.summary", F.coalesce("d.results", empty).alias("results"), error.alias("error"))


def report_findings(reports: DataFrame) -> DataFrame:
    """A1 over report documents: results x findings in order.

    A report in the reference's own format names no ``fn_ord``: results then
    count in the order they stand. ``file`` falls back to the report's target,
    ``function`` to ``unknown`` and ``source`` to an empty text.
    """
    r = reports.select(F.col("meta.target").alias("target"),
                       F.posexplode("results").alias("result_pos", "r"))
    return (r.select("target", "result_pos", F.coalesce("r.function", F.lit("unknown")).alias("function"),
                     F.coalesce("r.file", "target").alias("file"),
                     F.coalesce("r.fn_ord", F.col("result_pos").cast("int")).alias("fn_ord"),
                     F.coalesce("r.source", F.lit("")).alias("source"),
                     F.posexplode(F.coalesce("r.findings", F.array().cast(
                         T.ArrayType(FINDING_STRUCT)))).alias("rank_pos", "f"))
            .select("target", "result_pos", "function", "file", "fn_ord", "source",
                    F.col("rank_pos").cast("int"), "f.*"))
