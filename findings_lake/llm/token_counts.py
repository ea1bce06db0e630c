"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths of frequent chunks (the text
between two spaces, bounded by ``table_size`` entries of at most 64
characters); tier two is each worker's own bounded cache, which encodes what
the table misses with the tokenizer library. No chunk is ever shuffled: a
text is counted where it is read.

Null texts count as empty (0 bytes, 0 tokens); repeated rows and ties are
kept row by row; an empty table gives an empty result. Extra columns are
ignored. Texts of any length are counted whole, and special strings inside
texts count as the library's default counts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, stash
from .words import LONGEST, ChunkLengths, chunk_lengths

#: Entries of the broadcast table and of a worker's cache.
TABLE_SIZE = 65_536
WORKER_CACHE = 700_000
#: One text in so many (chosen by hash) is looked at to fill the table. The
#: table is a cache: it changes the speed and never a count.
TABLE_SHARE = 64


def frequent_chunks(docs: DataFrame, text_col: str, table_size: int, share: int) -> list[str]:
    """The most frequent chunks, at most ``table_size`` of bounded length
    (those of a count either all or none)."""
    chosen = docs.select(F.col(text_col).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(share)) == 0)
    counts = stash(chosen.select(F.explode(F.split("t", " ")).alias("chunk"))
                   .where(F.length("chunk").between(1, LONGEST)).groupBy("chunk").count(), "chunks")
    least, room = 0, table_size
    for r in counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).toLocalIterator():
        room -= r.n
        if room < 0:
            least = r["count"]
            break
    rows = counts.where(F.col("count") > least).select("chunk").collect()
    discard(counts)
    return [r.chunk for r in rows]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512, table_size: int = TABLE_SIZE, share: int = TABLE_SHARE,
                 cache_size: int = WORKER_CACHE) -> DataFrame:
    """One row per input row: ``id_col``, ``n_bytes``, ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens)."""
    spark = prepare(docs.sparkSession)
    chunks = frequent_chunks(docs, text_col, table_size, share)
    packed = spark.sparkContext.broadcast((" ".join(chunks), chunk_lengths(tokenizer_path, chunks)))

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names, lengths = packed.value
        known = dict(zip(names.split(" "), lengths)) if lengths else {}
        cache = ChunkLengths(tokenizer_path, known, len(known) + cache_size)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            n = pa.array([cache.count(t) for t in texts.to_pylist()], pa.int64())
            size = pc.binary_length(texts.cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)],
                                             ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
            .withColumnRenamed("id", id_col))
