"""Hierarchical multi-length packing.

Every document is tokenised and closed with an end id. It is routed by
length through context-size tiers: as many pieces of the longest window as
fit, then at most one piece of each shorter tier (a power of two, so such a
sequence needs no padding), and a rest shorter than the smallest tier. The
rests are packed largest first into long windows, and the gap that is left
in a window is filled with the longest rest that still fits. Sequences are
dealt to step groups tier by tier, so that groups hold equally many of each
length.

Cuts depend on the document alone, so they are made where it is read; only
lengths and positions are shuffled. Texts of any length are cut whole; a
null or empty text is its end id alone; repeated rows are packed
separately; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, prepare, running_start, stash
from .words import WordIds

TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Rests that one packing round holds at once.
ROUND = 1 << 17
#: Tokens of a step group, before padding.
STEP_TOKENS = 1 << 20
#: Ids of sequences packed from rests start here; the others count from 0.
PACKED = 1 << 62


def cuts(n: int, tiers: tuple[int, ...] = TIERS) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [tiers[0]] * (n // tiers[0])
    rest = n % tiers[0]
    for tier in tiers[1:]:
        if rest >= tier:
            out.append(tier)
            rest -= tier
    return out + [rest] if rest else out


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenised pieces: ``id, start, length, ids_crc32, doc_tokens`` and,
    if asked for, ``ids`` (little-endian unsigned 32-bit)."""
    prepare(docs.sparkSession)
    if any(a != 2 * b for a, b in zip(tiers, tiers[1:])) or tiers[0] & (tiers[0] - 1):
        raise ValueError("tiers are powers of two, each half of the one before")

    def run(batches):
        import zlib

        import pyarrow as pa

        encoder = WordIds(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        for b in batches:
            row, start, length, crc, total, data = [], [], [], [], [], []
            for k, ids in enumerate(encoder.encode(byte_list(b.column(1)))):
                ids += end
                n, at = len(ids) // 4, 0
                for size in cuts(n, tiers):
                    own = ids[4 * at:4 * (at + size)]
                    row.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(own))
                    total.append(n)
                    if with_ids:
                        data.append(own)
                    at += size
            columns = [b.column(0).take(pa.array(row, pa.int64())),
                       *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
            if with_ids:
                columns.append(pa.array(data, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
                           + ", ids binary" * with_ids)


def fill(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` of every rest: a bin takes the longest rest that
    fits its gap until none does."""
    longest = max(lengths)
    waiting: list[list[int]] = [[] for _ in range(longest + 1)]
    for k in range(len(lengths) - 1, -1, -1):
        waiting[lengths[k]].append(k)
    out, left, number = [(0, 0)] * len(lengths), len(lengths), 0
    while left:
        gap, size = window, longest
        while gap and size:
            size = min(size, gap)
            while size and not waiting[size]:
                size -= 1
            if not size:
                break
            out[waiting[size].pop()] = (number, window - gap)
            gap -= size
            left -= 1
        while longest and not waiting[longest]:
            longest -= 1
        number += 1
    return out


def _pack(window: int, most: int):
    """Task body: ``piece, length`` -> ``piece, sequence_id, offset``."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base, bins = PACKED + (TaskContext.get().partitionId() << 33), 0

        def packed(rows):
            nonlocal bins
            rows.sort(key=lambda r: r[0])  # the same bins however the rows arrive
            placed = fill([r[1] for r in rows], window)
            ids = [base + bins + n for n, _ in placed]
            bins += max(n for n, _ in placed) + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array(ids, pa.int64()),
                 pa.array([o for _, o in placed], pa.int64())], ["piece", "sequence_id", "offset"])

        held = []
        for b in batches:
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            while len(held) >= most:
                yield packed(held[:most])
                held = held[most:]
        if held:
            yield packed(held)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier`` (length of the sequence with its padding),
    ``step_group`` and, if asked for, ``ids``."""
    cut = stash(pieces(docs, tokenizer_path, id_col, text_col, tiers, end_id, with_ids)
                .withColumn("piece", F.monotonically_increasing_id()), "pieces")
    window, least = tiers[0], tiers[-1]
    rests = cut.where(F.col("length") < least).select("piece", "length")
    spread = rests.repartition("piece").sortWithinPartitions("piece")
    placed = stash(spread.mapInArrow(_pack(window, ROUND), "piece long, sequence_id long, offset long"), "rests")
    whole = cut.where(F.col("length") >= least).select(
        "piece", F.col("piece").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("tier"))
    seats = whole.unionByName(placed.withColumn("tier", F.lit(window).cast("long")))

    # Step groups: number the sequences of each tier densely and deal them in turn.
    opened = seats.where("offset = 0").select(
        "sequence_id", "tier", F.lit(1).alias("one"), F.shiftright("sequence_id", 33).alias("part"),
        F.shiftright(F.col("sequence_id").bitwiseAND(F.lit((1 << 33) - 1)), 8).alias("block"))
    total = opened.agg(F.sum("tier")).first()[0] or 0
    groups = max(1, -(-total // step_tokens))
    stepped = running_start(opened, ["tier"], "part", "block", ["sequence_id"], "one", "number").select(
        "sequence_id", F.pmod("number", F.lit(groups)).alias("step_group"))
    out = cut.join(seats, "piece").join(stepped, "sequence_id")
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                      "tier", "step_group", *(["ids"] if with_ids else []))
