"""Helpers shared by the corpus operators: table access, written stage
tables, Arrow batch limits and small Arrow conversions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Rows and bytes of one Arrow batch handed to a Python worker: bounds a
#: worker's memory on tables of very long texts.
ARROW_ROWS = 2048
ARROW_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by rows and by bytes (results do not depend on it)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared checkpoint folder and
    read it back: cuts the lineage, computes an expensive stage once and
    survives lost executors. The folder is the one the session names."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.stash_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete stage tables that nothing will read any more (rounds of a loop
    that a later table has replaced)."""
    for t in tables:
        jvm, sc = t.sparkSession._jvm, t.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(t.stash_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def byte_list(column) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8 bytes; null becomes empty."""
    import pyarrow as pa

    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


#: The six white-space characters between words.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of a very long text that are worked on at once.
PIECE = 4 << 20


def pieces_of(text: bytes, size: int = PIECE):
    """``text`` in pieces of about ``size`` bytes that end before white space
    (a run without any stays whole)."""
    at = 0
    while len(text) - at > size:
        stop = at + size
        while stop < len(text) and text[stop] not in SPACES:
            stop += 1
        yield text[at:stop]
        at = stop
    yield text[at:]


def running_start(df: DataFrame, group: list[str], part: str, block: str, order: list[str],
                  value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same
    ``group`` that come before, ordered by ``part``, ``block``, ``order``.

    Sums of blocks and of parts are combined before they are shuffled and
    only they are summed along a group, so a group with a third of all rows
    is spread over as many tasks as it has blocks.
    """
    def before(rows, keys, along, sums):
        over = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        return F.sum(sums).over(over) - F.col(sums)

    blocks = df.groupBy(*group, part, block).agg(F.sum(value).alias("__block"))
    parts = blocks.groupBy(*group, part).agg(F.sum("__block").alias("__part"))
    parts = parts.select(*group, part, before(parts, group, part, "__part").alias("__p"))
    blocks = blocks.select(*group, part, block, before(blocks, [*group, part], block, "__block").alias("__b"))
    starts = blocks.join(parts, [*group, part]).select(*group, part, block, (F.col("__p") + F.col("__b")).alias("__start"))
    inner = Window.partitionBy(*group, part, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__inner", F.sum(value).over(inner) - F.col(value))
    return (rows.join(starts, [*group, part, block])
            .withColumn(name, F.col("__start") + F.col("__inner")).drop("__start", "__inner"))
