"""Fuzzer output files -> job rows and hits (H1-H8).

Input: ``file, text`` (one row per output file, whole text). Every per-file
step runs inside the row with higher-order functions over the parsed
``results`` array: no explode is needed to count hits, and a corrupt file is
an error row, never a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Defaults of a job row.
UNKNOWN = "unknown"
DEFAULT_MATCH_CODES = "200"
FILE_PREFIX = "ffuf"

HIT_TYPE = "struct<url string, status int, length bigint, words bigint, input string>"
DOC_FIELDS = "config: variant, results: array<variant>"
_NUMERIC = ["BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT"]


def match_code_set(codes: str) -> list[int]:
    """H2: ``"200, 403"`` -> [200, 403] (driver-side parameter)."""
    return sorted({int(c.strip()) for c in codes.split(",")})


def cwe_from_name(path: Column) -> Column:
    """H4: ``ffuf_CWE_89_x.json`` -> ``CWE-89``; fewer than three ``_`` parts
    or another first part -> NULL."""
    parts = F.split(text.path_stem(path), "_", -1)
    return F.when((F.size(parts) >= 3) & (F.get(parts, 0) == FILE_PREFIX),
                  F.concat(F.get(parts, 1), F.lit("-"), F.get(parts, 2)))


def _get(v: Column, key: str) -> Column:
    return F.variant_get(v, f"$.{key}", "variant")


def _opt_str(v: Column, default: str | None) -> Column:
    """``d.get(key, default)`` as text: absent -> default, null -> NULL."""
    return F.when(v.isNull(), F.lit(default)).otherwise(F.try_variant_get(v, "$", "string"))


def parse_files(files: DataFrame, match_codes: str = DEFAULT_MATCH_CODES) -> DataFrame:
    """H1 + H3-H6: one job row per file.

    ``file, cwe_id, wordlist, target, hits array<struct>, hit_count, error``.
    """
    codes = [float(c) for c in match_code_set(match_codes)]
    # Typed read: only single results are variants, so a file has no size cap
    # of its own; a text with anything behind its object is no object.
    df = files.select("file", "text", text.one_typed_object(F.col("text"), DOC_FIELDS).alias("_doc"))
    df = df.withColumn("_res", F.col("_doc.results"))
    # No list under results: absent (an empty list), or something else
    keyed = F.array_contains(F.json_object_keys("text"), "results")
    df = df.withColumn("_bad", F.when(F.col("_doc").isNotNull() & F.col("_res").isNull(), F.coalesce(keyed, F.lit(False)))
                       .otherwise(F.lit(False)))
    df = df.withColumn("_res", F.coalesce("_res", F.when(~F.col("_bad"), F.array().cast("array<variant>"))))

    def is_hit(r):
        st = _get(r, "status")
        kind = text.json_kind(st)
        num = F.try_variant_get(st, "$", "double")
        return kind.isin(*_NUMERIC) & num.isin(*codes)

    def project(r):
        inp = _get(r, "input")
        fuzz = _get(inp, "FUZZ")
        input_text = (F.when(inp.isNull(), F.lit(""))
                      .when(text.json_kind(inp) == "OBJECT", _opt_str(fuzz, "")))
        return F.struct(
            F.try_variant_get(r, "$.url", "string").alias("url"),
            F.try_variant_get(r, "$.status", "int").alias("status"),
            F.try_variant_get(r, "$.length", "bigint").alias("length"),
            F.try_variant_get(r, "$.words", "bigint").alias("words"),
            input_text.alias("input"))

    hits = F.transform(F.filter("_res", is_hit), project)
    cfg = F.col("_doc.config")
    bad_input = F.exists(F.filter("_res", is_hit), lambda r: text.json_kind(_get(r, "input")) == "VOID")
    error = (F.when(F.col("_doc").isNull(), F.lit("not a JSON object"))
             .when(F.col("_res").isNull(), F.lit("results is not a list"))
             .when(bad_input, F.lit("hit input is null")))
    out = df.select(
        "file",
        cwe_from_name(F.col("file")).alias("cwe_id"),
        F.coalesce(_opt_str(_get(cfg, "wordlist"), UNKNOWN), F.when(cfg.isNull(), UNKNOWN))
        .alias("wordlist"),
        F.coalesce(_opt_str(_get(cfg, "url"), UNKNOWN), F.when(cfg.isNull(), UNKNOWN))
        .alias("target"),
        hits.alias("hits"),
        error.alias("error"))
    ok = F.col("error").isNull()
    return out.select(
        "file", F.when(ok, F.col("cwe_id")).alias("cwe_id"),
        F.when(ok, F.col("wordlist")).alias("wordlist"),
        F.when(ok, F.col("target")).alias("target"),
        F.when(ok, F.col("hits")).otherwise(F.array().cast(f"array<{HIT_TYPE}>")).alias("hits"),
        F.when(ok, F.size("hits")).otherwise(F.lit(0)).cast("long").alias("hit_count"),
        "error")


def explode_hits(jobs: DataFrame) -> DataFrame:
    """One row per hit with its position in the file's hit list."""
    return (jobs.select("file", "cwe_id", F.posexplode("hits").alias("hit_pos", "h"))
            .select("file", "cwe_id", F.col("hit_pos").cast("int"), "h.*"))


def report_totals(jobs: DataFrame) -> DataFrame:
    """H7: one row: status, job count, error count, total hits (errors
    count 0). An empty directory gives 0 jobs and 0 hits."""
    return jobs.agg(
        F.lit("ok").alias("status"),
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        F.coalesce(F.sum("hit_count"), F.lit(0)).cast("long").alias("total_hits"))


def hits_by_cwe(jobs: DataFrame) -> DataFrame:
    """H8: jobs and hits per CWE id taken from the file names."""
    return (jobs.where(F.col("error").isNull())
            .groupBy("cwe_id")
            .agg(F.count(F.lit(1)).alias("n_jobs"),
                 F.sum("hit_count").cast("long").alias("total_hits")))
