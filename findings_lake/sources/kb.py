"""Knowledge-base sources.

The knowledge base is two chunk tables (CWE definitions, CVE instances) plus
one embedding per chunk, matched by position. Here chunks carry an explicit
``chunk_pos`` and the vectors an ``array<float>`` column, so attaching them
is an equi-join, not a positional zip. Files without a ``chunk_pos`` column are
numbered in file order (``file_positions``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: embedding model named when the manifest does not say.
DEFAULT_EMBED_MODEL = "nomic-ai/nomic-embed-text-v2-moe"

CWE_SCHEMA = T.StructType([
    T.StructField("chunk_pos", T.LongType()),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("chunk_text", T.StringType()),
])
CVE_SCHEMA = T.StructType([
    T.StructField("chunk_pos", T.LongType()),
    T.StructField("cve_id", T.StringType()),
    T.StructField("cwe_id", T.StringType()),
    T.StructField("cvss_severity", T.StringType()),
    T.StructField("cvss_score", T.DoubleType()),
    T.StructField("chunk_text", T.StringType()),
])
VECTOR_SCHEMA = T.StructType([
    T.StructField("chunk_pos", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
MANIFEST_SCHEMA = T.StructType([
    T.StructField("embed_model", T.StringType()),
    T.StructField("embed_dim", T.IntegerType()),
    T.StructField("semantic_threshold", T.DoubleType()),
    T.StructField("cwe_chunks", T.LongType()),
    T.StructField("cve_chunks", T.LongType()),
    T.StructField("cwe_ids_covered", T.ArrayType(T.StringType())),
])


def _natural(path: str) -> list:
    """Sort key of a file name: runs of digits count as numbers."""
    return [(1, int(x), "") if x.isdigit() else (0, 0, x) for x in re.split(r"([0-9]+)", path)]


def file_positions(spark: SparkSession, path: str, name: str = "chunk_pos") -> DataFrame:
    """The Parquet rows under ``path`` with their dense position from 0 in
    file order: files by name (numbers in names count as numbers), rows as
    they stand in their file.

    A row's position is its index in its file (``_metadata.row_index``) plus
    the sizes of the files before it. Sizes are one small aggregation that
    reads no data column; their running sums are taken over the list of files,
    which Spark's file index keeps on the driver in any case. No row is sorted
    or sent to a common task.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = {r._file: r.n for r in rows.groupBy("_file").agg((F.max("_row") + 1).alias("n")).collect()}
    starts, at = [], 0
    for file in sorted(sizes, key=_natural):
        starts.append((file, at))
        at += sizes[file]
    table = spark.createDataFrame(starts, "_file string, _start long")
    return rows.join(table, "_file").withColumn(name, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def _positioned(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if "chunk_pos" in rows.columns else file_positions(spark, path)


def read_chunks(spark: SparkSession, cwe_path: str, cve_path: str) -> DataFrame:
    """Both chunk tables as one frame with a ``source`` column; a table
    without ``chunk_pos`` is numbered in file order.

    Columns a table lacks are NULL (a CVE table without ``cvss_severity``
    is treated as LOW by the retrieval filter only when the column is
    absent from the whole frame).
    """
    cwe = _positioned(spark, cwe_path).withColumn("source", F.lit("CWE"))
    cve = _positioned(spark, cve_path).withColumn("source", F.lit("CVE"))
    return cwe.unionByName(cve, allowMissingColumns=True)


def read_vectors(spark: SparkSession, cwe_path: str, cve_path: str) -> DataFrame:
    """The vectors of both chunk tables as ``source, chunk_pos,
    embedding``; row i of a vector table belongs to row i of its chunk table,
    however either is split into files."""
    cwe = _positioned(spark, cwe_path).withColumn("source", F.lit("CWE"))
    cve = _positioned(spark, cve_path).withColumn("source", F.lit("CVE"))
    keep = ["source", "chunk_pos", "embedding"]
    return cwe.select(*keep).unionByName(cve.select(*keep))


def attach_embeddings(chunks: DataFrame, vectors: DataFrame, check: bool = True) -> DataFrame:
    """Chunk row + its vector by ``(source, chunk_pos)``; each source
    numbers its chunks on its own, so vectors must name theirs.

    With ``check`` a chunk without a vector, or a vector without a chunk,
    fails the query when it runs (the reference silently mis-pairs).
    """
    if "source" not in vectors.columns:
        raise ValueError("vectors need the columns source, chunk_pos and embedding")
    keys = ["source", "chunk_pos"]
    if not check:
        return chunks.join(vectors, keys, "inner")
    left = chunks.withColumn("_c", F.lit(True))
    right = vectors.withColumn("_v", F.lit(True))
    both = left.join(right, keys, "full_outer")
    unpaired = F.raise_error(F.concat_ws(" ", F.lit("unpaired chunk or vector:"), "source", F.col("chunk_pos").cast("string")))
    paired = F.when(F.col("_c") & F.col("_v"), F.lit(True)).otherwise(unpaired.cast("boolean"))
    return both.where(paired).drop("_c", "_v")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """S3: the manifest JSON (one object) as a one-row frame."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)


def profile(kb: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Chunks per source, vector dimension, embedding model.

    ``embed_model`` falls back to the default when there is no manifest or
    it names none; the manifest's declared counts and dimension are shown
    beside the observed ones (the reference never enforces them).
    """
    obs = kb.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"),
                                   F.max(F.size("embedding")).cast("int").alias("embed_dim"))
    if manifest is None:
        return obs.withColumn("embed_model", F.lit(DEFAULT_EMBED_MODEL))
    # The manifest is one small config object: its values are scalar subqueries.
    m = manifest.limit(1)

    def value(expr):
        return m.select(F.first(expr)).scalar()

    declared = F.when(F.col("source") == "CWE", value("cwe_chunks")).otherwise(value("cve_chunks"))
    name = value(F.when(F.col("embed_model") != "", F.col("embed_model")))
    return (obs.withColumn("embed_model", F.coalesce(name, F.lit(DEFAULT_EMBED_MODEL)))
            .withColumn("declared_dim", value("embed_dim").cast("int"))
            .withColumn("declared_chunks", declared.cast("long")))
