"""Fuzzer results as they land (S8 + H1-H8 on Structured Streaming).

The fuzzer writes one ``ffuf_*.json`` per job into a directory. The batch
reader parses the directory once; this module does the same work
incrementally: the file source picks up new files, each micro-batch runs the
same row-wise parser, job rows are appended to a table, and running totals
per CWE are kept as streaming aggregation state (a handful of rows).

Checkpoints go under the cluster's shared ``spark.checkpoint.dir`` unless a
location is given, so a restarted driver or lost executors resume from the
last committed batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import hits as H
from ..session import checkpoint_dir
from ..sources.files import FUZZ_GLOB


def job_stream(spark: SparkSession, results_dir: str,
               match_codes: str = H.DEFAULT_MATCH_CODES,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming job rows (same columns as ``hits.parse_files``)."""
    reader = (spark.readStream.format("text").option("wholetext", True)
              .option("pathGlobFilter", FUZZ_GLOB))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = reader.load(results_dir).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return H.parse_files(files, match_codes)


def _ckpt(spark: SparkSession, name: str, location: str | None) -> str:
    return location or os.path.join(checkpoint_dir(spark), "streams", name)


def start_jobs_sink(jobs: DataFrame, out_dir: str, checkpoint: str | None = None,
                    available_now: bool = True) -> StreamingQuery:
    """Append job rows (hits nested) as parquet."""
    w = (jobs.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", _ckpt(jobs.sparkSession, "fuzz_jobs", checkpoint))
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def cwe_totals(jobs: DataFrame) -> DataFrame:
    """H7/H8 per CWE as a streaming aggregation (state: one row per CWE)."""
    return (jobs.groupBy("cwe_id")
            .agg(F.count(F.lit(1)).alias("n_jobs"),
                 F.count_if(F.col("error").isNotNull()).alias("n_errors"),
                 F.sum("hit_count").cast("long").alias("total_hits")))


def start_cwe_totals(jobs: DataFrame, out: str, checkpoint: str | None = None,
                     available_now: bool = True, in_memory: bool = False) -> StreamingQuery:
    """Running totals per CWE. Each batch rewrites the parquet table at
    ``out`` with the complete (small, one row per CWE) result; with
    ``in_memory`` the result goes to a memory table named ``out`` instead,
    for interactive inspection only (it lives on the driver)."""
    ck = _ckpt(jobs.sparkSession, f"cwe_totals_{os.path.basename(out.rstrip('/'))}", checkpoint)
    w = cwe_totals(jobs).writeStream.outputMode("complete").option("checkpointLocation", ck)
    if in_memory:
        w = w.format("memory").queryName(out)
    else:
        w = w.foreachBatch(lambda df, _epoch: df.write.mode("overwrite").parquet(out))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
