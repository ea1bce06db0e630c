"""Spark session settings the library relies on.

Only settings that change *results* are forced (variant duplicate keys, UTC).
Everything sized for the cluster (shuffle partitions, memory) is left to the
caller; ``local_session`` is the test / bench convenience.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings that make results match the reference's Python semantics.
REQUIRED_CONF = {
    # Python's json keeps the last of duplicate keys; Spark's default is NULL.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Only ISO text with "Z" is ever produced; keep clocks in UTC.
    "spark.sql.session.timeZone": "UTC",
}

SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Many small fuzz-output / report files: pack them into fewer splits.
    "spark.sql.files.openCostInBytes": str(1 << 20),
    # Parsing after a shuffle is CPU-bound: do not coalesce small shuffles
    # below one task per core.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 << 10),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the result-affecting settings to an existing session."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (leaving it
    unset there is an error); a private folder is only made in local mode
    when the setting is absent (tests).
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="findings-lake-ckpt-")  # local mode only (tests), removed with the process
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        sc.setCheckpointDir(d)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint
    folder (never a local, executor-held copy): a lost executor then costs
    a re-read, not a recomputation from the sources."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "findings_lake") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("FL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.ansi.enabled", "true")
    )
    for k, v in {**REQUIRED_CONF, **SCALE_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
