"""Fuzz-job planning.

Input: report findings per target file (``file, fn_ord, cwe_id, cwe_name,
severity`` and either ``rank_pos`` - the position in a report read back - or
``finding_pos``, the reply position; within one function and one rank both
give the report order). Output: a job table, not a shell script.

Scale notes: the CWE dedupe is an aggregation (``min`` of an order struct)
so a CWE that holds a third of all findings is absorbed by map-side partial
aggregation instead of being sorted in one task; the wordlist map is a small
config table with a fixed size and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions import text
from ..sources import wordlists as WL

# Job parameters and path layout of a fuzz job.
RESULTS_DIR = "/results"
WORDLIST_ROOT = "/SecLists"
FUZZ_MARKER = "FUZZ"
DEFAULT_TARGET_URL = "http://host.docker.internal:5055/user/FUZZ"
DEFAULT_MATCH_CODES = "200"
DEFAULT_WORKERS = 20
DEFAULT_TIMEOUT_S = 10
DEFAULT_MAX_WORDLISTS = 1


def dedupe_cwes(findings: DataFrame) -> DataFrame:
    """highest-severity finding per non-empty ``cwe_id`` and file, in the
    order of a stable sort by rank desc over report order.

    A missing severity counts as LOW, an unknown one as rank 0.
    """
    r = sev.rank(F.coalesce(F.col("severity"), F.lit("LOW")))
    pos = "rank_pos" if "rank_pos" in findings.columns else "finding_pos"
    key = F.struct((-r).alias("neg_rank"), F.col("fn_ord"), F.col(pos).alias("pos"))
    firsts = (findings.where(F.coalesce(F.col("cwe_id"), F.lit("")) != "")
              .groupBy("file", "cwe_id")
              .agg(F.min(F.struct(key.alias("k"), F.col("cwe_name"), F.col("severity")))
                   .alias("m")))
    w = Window.partitionBy("file").orderBy("m.k")
    return firsts.select(
        "file", (F.row_number().over(w) - 1).cast("int").alias("plan_pos"), "cwe_id",
        F.coalesce(F.col("m.cwe_name"), F.lit("")).alias("cwe_name"),
        F.col("m.severity").alias("severity"))


def lookup_wordlists(cwes: DataFrame, wordlist_map: DataFrame,
                     max_wordlists: int = DEFAULT_MAX_WORDLISTS) -> DataFrame:
    """F2 + F3: the CWE's wordlists, else the ``_default`` list; first
    ``max_wordlists`` in map order, one row per job (``job_pos``)."""
    m = wordlist_map.select("cwe_id", F.col("wordlists").alias("_own"))
    d = (wordlist_map.where(F.col("cwe_id") == WL.DEFAULT_KEY)
         .select(F.col("cwe_id").alias("_dk"), F.col("wordlists").alias("_def")))
    # The default list is looked up only for CWEs without their own entry;
    # the key depends on the row, so this stays an equi (hash) join.
    j = (cwes.join(m, "cwe_id", "left")
         .withColumn("_dk", F.when(F.col("_own").isNull(), F.lit(WL.DEFAULT_KEY)))
         .join(d, "_dk", "left"))
    full = F.coalesce("_own", "_def", F.array().cast("array<string>"))
    # ``lists[:n]`` with Python's meaning of a negative n (drop from the end)
    keep = F.lit(max_wordlists) if max_wordlists >= 0 else \
        F.greatest(F.size(full) + max_wordlists, F.lit(0))
    lists = F.slice(full, 1, keep)
    return (j.select(*cwes.columns, F.posexplode(lists).alias("job_pos", "wordlist"))
            .withColumn("job_pos", F.col("job_pos").cast("int")))


def check_targets(targets: DataFrame) -> DataFrame:
    """a target URL must contain the FUZZ marker."""
    return targets.withColumn("valid", F.col("target_url").contains(FUZZ_MARKER))


def job_rows(jobs: DataFrame, match_codes: str = DEFAULT_MATCH_CODES,
             workers: int = DEFAULT_WORKERS, timeout_s: int = DEFAULT_TIMEOUT_S,
             url_encode: bool = True) -> DataFrame:
    """F4 + F5: output path, wordlist path and the job parameters."""
    safe = F.replace(F.col("cwe_id"), F.lit("-"), F.lit("_"))
    return (jobs
            .withColumn("out_path", F.concat(F.lit(f"{RESULTS_DIR}/ffuf_"), safe, F.lit("_"),
                                             text.path_stem("wordlist"), F.lit(".json")))
            .withColumn("wordlist_path", F.concat(F.lit(WORDLIST_ROOT + "/"), F.col("wordlist")))
            .withColumn("match_codes", F.lit(match_codes))
            .withColumn("workers", F.lit(workers))
            .withColumn("timeout_s", F.lit(timeout_s))
            .withColumn("url_encode", F.lit(url_encode)))


def plan_jobs(findings: DataFrame, targets: DataFrame, wordlist_map: DataFrame,
              max_wordlists: int = DEFAULT_MAX_WORDLISTS, match_codes: str = DEFAULT_MATCH_CODES,
              url_encode: bool = True) -> DataFrame:
    """``generate_fuzz_script`` as a table: jobs of every file whose target
    is valid (a file with an invalid target gets no plan, as the reference
    stops)."""
    ok = check_targets(targets).where("valid").select("file", "target_url")
    cwes = dedupe_cwes(findings)
    jobs = lookup_wordlists(cwes, wordlist_map, max_wordlists).join(ok, "file")
    return job_rows(jobs, match_codes, url_encode=url_encode)


def plan_summary(files: DataFrame, cwes: DataFrame, jobs: DataFrame) -> DataFrame:
    """per file, jobs written, unique CWEs and the CWE list in plan
    order (``none`` when empty)."""
    c = cwes.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_cwes"),
        F.array_sort(F.collect_list(F.struct("plan_pos", "cwe_id"))).alias("_c"))
    j = jobs.groupBy("file").agg(F.count(F.lit(1)).alias("n_jobs"))
    out = files.select("file").join(c, "file", "left").join(j, "file", "left")
    lst = F.array_join(F.transform("_c", lambda x: x["cwe_id"]), ", ")
    return out.select("file", F.coalesce("n_jobs", F.lit(0)).cast("long").alias("n_jobs"),
                      F.coalesce("n_cwes", F.lit(0)).cast("long").alias("n_cwes"),
                      F.coalesce(F.nullif(lst, F.lit("")), F.lit("none")).alias("cwe_list"))


def output_collisions(jobs: DataFrame) -> DataFrame:
    """F8: jobs of one file writing the same output path (they would
    overwrite each other's results)."""
    return (jobs.groupBy("file", "out_path").agg(F.count(F.lit(1)).alias("n_jobs"))
            .where(F.col("n_jobs") > 1))
