"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points (exact 32-bit arithmetic) are mapped through the sources'
cumulative targets: slot ``i`` goes to the source whose interval holds point
``i``, so every stretch of the schedule holds each source close to its share.
A slot's rank among its source's slots names the block it takes from that
source's stream: the documents in hash order, cut into blocks of equal size
(in words), the stream repeated as often as the target asks. Slots and
blocks meet in an equi-join on (source, rank); each pair is used once. Blocks
whose rank got no slot take closing slots after the schedule, so every source
reaches its target to the word.

Null texts have size 0 and are never taken; a null source is a source of its
own, ordered last; repeated rows and ids are separate documents; an empty
table gives an empty result; extra columns are ignored. The order of a stream
depends on ids and texts alone, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, prepare, running_start, stash

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
#: Words of a block: about this many slots are scheduled, within the bounds.
SLOTS, BLOCK_BOUNDS = 200_000, (16, 4096)
#: Sources are the mix's own settings, one row each on the driver.
MAX_SOURCES = 1_000_000
#: floor(2^32 / golden ratio), odd.
GOLDEN = 2_654_435_769
#: Slots that one row of the schedule's generator makes.
CHUNK = 1 << 16


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, source, h, size`` (words split by ASCII white space) and ``keep`` of every row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), *keep,
                       F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = pa.array([len(t.split()) for t in byte_list(b.column(b.num_columns - 1))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*b.schema.names[:-1], "size"])

    return rows.mapInArrow(run, rows.drop("__text").withColumn("size", F.lit(0).cast("long")).schema)


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE,
            repeats: int = MAX_REPEATS) -> list[float]:
    """Targets of sources in order; weights repeat along them. A target
    stops at ``repeats`` times its source, its excess goes to the others by weight."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rate = left / sum(w[k] for k in open_)
        full = [k for k in open_ if rate * w[k] > repeats * sizes[k]]
        if not full:
            for k in open_:
                out[k] = rate * w[k]
            break
        for k in full:
            out[k] = float(repeats * sizes[k])
            left -= out[k]
            open_.remove(k)
    return out


def schedule(spark, edges: list[float], slots: int) -> DataFrame:
    """``slot, source_no, rank``: where each golden-ratio point falls among
    the cumulative shares ``edges`` and its number there, from 0."""

    def chosen(chunk):
        import numpy as np

        i = np.arange(chunk * CHUNK, min(slots, (chunk + 1) * CHUNK), dtype=np.uint64)
        point = ((i * np.uint64(GOLDEN)) & np.uint64(0xFFFFFFFF)) / 4294967296.0
        return np.minimum(np.searchsorted(np.array(edges), point, side="right"), len(edges) - 1)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for chunk in b.column(0).to_pylist():
                n = np.bincount(chosen(chunk), minlength=len(edges))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), chunk), pa.int64()), pa.array(np.arange(len(n)), pa.int32()),
                     pa.array(n, pa.int64())], ["chunk", "source_no", "n"])

    def number(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for chunk, source, first in zip(*(c.to_pylist() for c in b.columns)):
                at = np.flatnonzero(chosen(chunk) == source)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + chunk * CHUNK, pa.int64()), pa.array(np.full(len(at), source), pa.int32()),
                     pa.array(np.arange(first, first + len(at)), pa.int64())], ["slot", "source_no", "rank"])

    chunks = -(-slots // CHUNK)
    counts = spark.range(chunks).mapInArrow(count, "chunk long, source_no int, n long").where("n > 0")
    counts = counts.withColumn("part", F.shiftright("chunk", 10)).withColumn("one", F.lit(0))
    starts = running_start(counts, ["source_no"], "part", "chunk", ["one"], "n", "first")
    return starts.select("chunk", "source_no", "first").mapInArrow(number, "slot long, source_no int, rank long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, repeats: int = MAX_REPEATS,
        keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(documents, pieces)``.

    ``documents``: per input row ``row, id, source, size, source_size,
    target`` and ``keep``. ``pieces``: what the mix takes, in the order of ``slot``: ``slot,
    row, epoch, start, length`` (words of the document); no document is taken
    more than ``repeats`` times.
    """
    spark = docs.sparkSession
    rows = stash(sized(docs, id_col, text_col, source_col, keep).withColumn("row", F.monotonically_increasing_id()), "sizes")
    found = (rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
             .orderBy(F.asc_nulls_last("source")).limit(MAX_SOURCES + 1).collect())
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = targets([r["size"] for r in found], weights, share, repeats)
    total, n = sum(goal), sum(r.n for r in found)
    plan = spark.createDataFrame(
        [(r.source, k, r["size"], g, min(int(g + 0.5), repeats * r["size"])) for k, (r, g) in enumerate(zip(found, goal))],
        "source string, source_no int, source_size long, target double, take long")
    documents = rows.join(plan, rows.source.eqNullSafe(plan.source)).drop(plan.source)

    block = max(BLOCK_BOUNDS[0], min(BLOCK_BOUNDS[1], int(total // SLOTS)))
    # A few slots more than the total fills: a stream ends at its target, so they only top up sources that lag behind.
    slots = int(total / block * 65 / 64) + 4 * len(found) if total else 0
    edges, run = [], 0.0
    for g in goal:
        run += g
        edges.append(run / total if total else 1.0)
    side = max(1, round(n ** (1 / 3)))
    live = documents.where("size > 0").withColumn("part", F.pmod("h", F.lit(side))).withColumn(
        "block", F.pmod(F.shiftright("h", 24), F.lit(side)))
    placed = running_start(live, ["source_no"], "part", "block", ["h", "id", "row"], "size", "first")
    passes = placed.select("row", "source_no", "size", "first", "source_size", "take",
                           F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("epoch"))
    begin = F.col("epoch") * F.col("source_size") + F.col("first")
    spans = passes.select("row", "source_no", "epoch", begin.alias("a"),
                          F.least(begin + F.col("size"), F.col("take")).alias("b")).where("a < b")
    cut = spans.withColumn("rank", F.explode(F.expr(f"sequence(a div {block}, (b - 1) div {block})")))
    places = schedule(spark, edges, slots)
    given = places.groupBy("source_no").agg(F.count(F.lit(1)).alias("given"))
    closing = plan.select("source_no", F.ceil(F.col("take") / block).alias("blocks")).join(given, "source_no", "left").withColumn(
        "given", F.coalesce("given", F.lit(0))).where("given < blocks")
    # closing slots go round the sources; their numbers may leave gaps
    last = closing.withColumn("rank", F.explode(F.sequence(F.col("given"), F.col("blocks") - 1))).select(
        (F.lit(slots) + (F.col("rank") - F.col("given")) * len(found) + F.col("source_no")).alias("slot"), "source_no", "rank")
    pieces = cut.join(places.unionByName(last), ["source_no", "rank"]).select(
        "slot", "row", "epoch", (F.greatest("a", F.col("rank") * block) - F.col("a")).alias("start"),
        (F.least("b", (F.col("rank") + 1) * block) - F.greatest("a", F.col("rank") * block)).alias("length"))
    return documents, pieces


def taken(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """``documents`` with ``taken``, the words the mix takes of each row."""
    sums = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    return documents.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
