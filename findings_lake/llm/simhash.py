"""SimHash near-dedup with pigeonhole blocks.

A text's fingerprint is the bitwise majority of the XXH64 values of its
word shingles. Fingerprints within ``max_bits`` differing bits are linked;
a document's group is the set it can reach by links.

Candidate search: the 64 bits are cut into ``max_bits + agree`` blocks. Two
fingerprints that differ in at most ``max_bits`` bits agree on at least
``agree`` whole blocks, so each distinct fingerprint is filed once under
every choice of ``agree`` blocks (for 4 bits and 2 blocks: 15 keys of 21 or
22 bits) and only fingerprints under one key are compared. Every comparison
verifies the Hamming distance; what leaves a task is a spanning forest of the
verified links, never the pairs. Keys that hold more than ``hot_key`` distinct
fingerprints are cut into chunks and every pair of chunks becomes a group of
its own, so no group grows beyond two chunks and none is dropped.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, pieces_of, prepare, stash
from .components import components, forest

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Whole blocks that two linked fingerprints share (more: longer, rarer keys and more of them).
AGREE_BLOCKS = 2
#: Distinct fingerprints of one key that one task compares.
HOT_KEY = 4096
#: Groups up to this size are compared by shifts over the sorted stream.
SMALL = 48


def fingerprint(text: bytes, width: int) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    bits, count, words = np.zeros(64, dtype=np.int64), 0, []
    for piece in pieces_of(text):
        words += piece.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
        if len(words) < width:
            continue
        joined = b" ".join(words)
        space = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(space[: len(words) - width] + 1).tolist()]
        ends = [*space[width - 1:].tolist(), len(joined)]
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends)], dtype="<u8")
        octets = h.view(np.uint8).reshape(-1, 8)
        for at in range(0, len(h), 1 << 16):
            bits += np.unpackbits(octets[at:at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(h)
        words = words[len(words) - width + 1:]  # shingles go on across pieces
    if not count and words:
        value = digest(b" ".join(words), 42)
        return value - (1 << 64) if value >> 63 else value
    return int(np.packbits(2 * bits > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = SHINGLE_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``fp`` for every row; a null or
    wordless text has fingerprint zero, a text of fewer words than ``width``
    the hash of its whole word sequence."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = pa.array([fingerprint(t, width) for t in byte_list(b.column(b.num_columns - 1))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fps], [*b.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, rows.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema)


def block_masks(max_bits: int, agree: int) -> list[int]:
    """A mask (signed 64-bit) for every choice of ``agree`` blocks."""
    n = max_bits + agree
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _far(x, y):
    """Differing bits (numpy counts the bits of a signed number's magnitude, so unsigned it is)."""
    import numpy as np

    return np.bitwise_count((x ^ y).view(np.uint64))


def _groups_of(key, size: int):
    """Bounds of runs of equal keys in a sorted array."""
    import numpy as np

    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return cut, np.r_[cut[1:], size]


def _links(key, fp, max_bits: int):
    """Spanning links of fingerprints under equal keys (arrays sorted by key)."""
    import numpy as np

    if not len(key):
        return fp, fp
    start, stop = _groups_of(key, len(key))
    length = stop - start
    u, v = [], []
    small = np.repeat(length <= SMALL, length)
    for d in range(1, min(SMALL, int(length.max()))):
        i = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        if not len(i):
            break
        near = _far(fp[i], fp[i + d]) <= max_bits
        u.append(fp[i[near]])
        v.append(fp[i[near] + d])
    for a, b in zip(start[length > SMALL].tolist(), stop[length > SMALL].tolist()):
        rest = np.unique(fp[a:b])  # breadth first: each member is compared once with those not yet reached
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = _far(rest, x) <= max_bits
                if near.any():
                    got = rest[near]
                    u.append(np.full(len(got), x))
                    v.append(got)
                    queue.extend(got)
                    rest = rest[~near]
    if not u:
        return fp[:0], fp[:0]
    return forest(np.concatenate(u), np.concatenate(v))


def _compare(max_bits: int, most: int = 1 << 18):
    """Task body: rows ``key, fp`` sorted by key -> spanning links ``u, v``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        keys, fps, held = [], [], 0
        for b in batches:
            keys.append(b.column(0).to_numpy(zero_copy_only=False))
            fps.append(b.column(1).to_numpy(zero_copy_only=False))
            held += b.num_rows
            if held >= most:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                yield out(*_links(key[:cut], fp[:cut], max_bits))
                keys, fps, held = [key[cut:]], [fp[cut:]], len(key) - cut
        if held:
            yield out(*_links(np.concatenate(keys), np.concatenate(fps), max_bits))

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, agree: int = AGREE_BLOCKS,
                      hot_key: int = HOT_KEY) -> DataFrame:
    """Spanning links ``u, v`` of the distinct fingerprints in column ``fp``."""
    masks = block_masks(max_bits, agree)
    keyed = fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m)))
                                                 for k, m in enumerate(masks)])).alias("key"))
    # written, so that its real size decides the join: it is small beside the keys
    hot = stash(keyed.groupBy("key").count().where(F.col("count") > hot_key)
                .select("key", F.ceil(F.col("count") / hot_key).cast("int").alias("chunks")), "hot")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = (keyed.join(hot, "key", "left")
             .withColumn("own", F.coalesce(own, F.lit(0)))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
             .select(F.when(F.col("chunks").isNull(), F.col("key"))
                     .otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"), "fp"))
    return (dealt.repartition("key").sortWithinPartitions("key")
            .mapInArrow(_compare(max_bits), "u long, v long"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, agree: int = AGREE_BLOCKS,
                   hot_key: int = HOT_KEY, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col``, the columns ``keep``, ``fp`` (signed 64-bit),
    ``fingerprint`` (16 lower-case hex digits), ``component_id``, the smallest
    id of the row's group, and ``group``, a fingerprint that names it.

    Null and wordless texts share fingerprint zero and are linked like any
    other; equal fingerprints always form one group. A null id takes part
    but is never a group's id (null if a group has no other). Repeated rows
    stay. An empty table gives an empty result; extra columns are ignored.
    Grouping is by fingerprint, so a group of copies costs one row here.
    """
    prints = stash(fingerprints(docs, id_col, text_col, width, keep), "fingerprints")
    firsts = prints.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    member = components(fingerprint_links(firsts.select("fp"), max_bits, agree, hot_key))
    firsts = firsts.join(member, firsts.fp == member.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    firsts = stash(firsts, "members")
    # written, so that the join deals both sides by root anew and a large group can be split
    least = stash(firsts.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    named = firsts.join(least, "root").select("fp", "component_id", F.col("root").alias("group"))
    return prints.join(named, "fp").select(
        id_col, *keep, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group")
