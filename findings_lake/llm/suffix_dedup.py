"""Suffix-array dedup: remove every byte inside a long string that also
starts anywhere else in the corpus.

1. Anchors. Every ``length``-byte window names one anchor inside itself, the
   least hash of the 8-byte strings in its first ``reach`` bytes (ties: the
   last), so equal windows name anchors at the same offset. Consecutive windows
   of one anchor form a span. Spans are keyed by the bytes that all their
   windows share, from the anchor on.
2. One pass over the spans sorted by key: a key of a single span can't hold a
   repeat (its windows are proven unique); equal spans are repeats throughout;
   what remains are spans that share a key but differ somewhere.
3. Those spans go, family by family, into shards of bounded size. A shard's
   suffixes are sorted once into its Burrows-Wheeler transform; the transforms
   of shards that meet are merged by iterative interleave refinement, whose
   common prefixes give the intervals of suffixes that share ``length`` bytes
   (``bwt.py``). No suffix is sorted again in a merge. A family beyond
   ``hot_family`` spans is cut into chunks and every pair of chunks is merged,
   so no task grows with a family.
4. Repeated windows go back to their document, are united and cut out.

Strings are judged on the input text; matches never cross documents. Null and
empty texts have nothing to remove, and texts shorter than ``length`` keep all;
repeated rows repeat each other's bytes; null ids are told apart by their
texts; an empty table gives an empty result; extra columns are ignored. Keys and span
hashes together have 128 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import bwt
from .common import PIECE, byte_list, prepare, stash

LENGTH = 200
#: Bytes of a window in which its anchor starts.
REACH = 144
GRAM = 8
#: Symbol of the transforms; LENGTH is a multiple of it.
SYMBOL = 40
#: Bytes of spans that meet in one task and of one of its shards; spans of a family's chunk.
UNIT, SHARD, HOT_FAMILY = 512 << 10, 256 << 10, 1024
#: Rows of one key that the sorted pass holds at most.
HELD = 1 << 20
WHOLE, EDGE, TWIN = 0, 1, 2  # a repeated span; a span to be looked at; a repeated span that an edge may share windows with


def anchors(text: bytes, length: int = LENGTH, reach: int = REACH):
    """``(first window, last window, anchor)`` of every span of a text."""
    import numpy as np

    n = len(text)
    windows = n - length + 1
    if windows < 1:
        return None
    raw = np.frombuffer(text + bytes(GRAM), dtype=np.uint8)
    gram = np.lib.stride_tricks.as_strided(raw, shape=(windows + reach - 1, GRAM), strides=(1, 1)).copy().view("<u8").ravel()
    gram *= np.uint64(0x9E3779B97F4A7C15)
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64(0xFFFFFFFF)
    best = (gram & ~low) | (low - np.arange(len(gram), dtype=np.uint64))
    width = 1
    while 2 * width <= reach:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[:windows], best[reach - width:reach - width + windows])
    at = (low - (best & low)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return cut, np.r_[cut[1:], windows] - 1, at[cut]


def anchors_in_pieces(text: bytes, length: int = LENGTH, reach: int = REACH, size: int = PIECE):
    """``anchors`` of a text, a very long one in pieces of ``size`` windows. A
    span may be cut between pieces; its parts are compared like any spans."""
    for base in range(0, max(1, len(text) - length + 1), size):
        found = anchors(text[base:base + size + length - 1], length, reach)
        if found is not None:
            yield tuple(x + base for x in found)


def spans(rows: DataFrame, length: int = LENGTH, reach: int = REACH) -> DataFrame:
    """``kind, key, span, doc, at, n`` of all spans of rows (``doc, tag, text``).
    ``at`` packs the document's tag, the first window and the number of windows. Spans
    that are equal within a batch are repeats already: they come as WHOLE, and one of them as a probe that counts twice."""
    shared = length - reach + 1

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        for b in batches:
            doc, tag = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            key, span, at, owner = [], [], [], []
            for k, text, found in ((k, text, found) for k, text in enumerate(byte_list(b.column(2)))
                                   for found in anchors_in_pieces(text, length, reach)):
                first, last, anchor = found
                key += [digest(text[a:a + shared]) for a in anchor.tolist()]
                span += [digest(text[i:j + length], a - i) for i, j, a in zip(first.tolist(), last.tolist(), anchor.tolist())]
                at.append((int(tag[k]) << 40) | (first << 8) | (last - first))
                owner.append(np.full(len(first), doc[k]))
            if not key:
                continue
            key, span = (np.array(x, dtype=np.uint64).view(np.int64) for x in (key, span))
            at, owner = np.concatenate(at), np.concatenate(owner)
            order = np.lexsort((span, key))
            key, span, at, owner = key[order], span[order], at[order], owner[order]
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (span[1:] != span[:-1])])
            size = np.diff(np.r_[start, len(key)])
            twice = np.repeat(size > 1, size)
            for kind, rows_, n in ((WHOLE, np.flatnonzero(twice), 0), (EDGE, start, np.minimum(size, 2))):
                # WHOLE rows only pass through: their documents spread them
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows_), kind, dtype=np.int8)), pa.array(owner[rows_] if kind == WHOLE else key[rows_]),
                     pa.array(span[rows_]), pa.array(owner[rows_]), pa.array(at[rows_]),
                     pa.array(np.broadcast_to(n, len(rows_)).astype(np.int8))], ["kind", "key", "span", "doc", "at", "n"])

    return rows.mapInArrow(run, "kind byte, key long, span long, doc long, at long, n byte")


def _resolve(batches):
    """Task body over spans sorted by ``kind, key, span``: ``kind, key, doc,
    at`` of repeated spans, of edges and of their twins."""
    import numpy as np
    import pyarrow as pa

    names = ["kind", "key", "span", "doc", "at", "n"]

    def out(kind, rows, c):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(rows), kind, dtype=np.int8)), *(pa.array(c[k][rows]) for k in ("key", "doc", "at"))],
            ["kind", "key", "doc", "at"])

    def judged(c, known):
        """Of complete families, or of a part of one that is known to have several spans."""
        key, span, n = c["key"], c["span"], c["n"].astype(np.int64)
        fresh = np.r_[True, key[1:] != key[:-1]]
        spans_at = np.flatnonzero(fresh | np.r_[True, span[1:] != span[:-1]])
        count = np.add.reduceat(n, spans_at)
        family = np.cumsum(fresh)[spans_at] - 1
        total = np.bincount(family, weights=count)
        edges = np.bincount(family, weights=count == 1)
        if known:
            total, edges = total + 2, edges + 1
        size = np.diff(np.r_[spans_at, len(key)])
        repeated = np.repeat(count > 1, size)
        yield out(WHOLE, np.flatnonzero(repeated & (n == 1)), c)
        yield out(EDGE, spans_at[(count == 1) & (total[family] > 1)], c)
        yield out(TWIN, spans_at[(count > 1) & (edges[family] > 0)], c)

    held, rows, open_key = [], 0, None
    for b in batches:
        c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in names}
        passing = c["kind"] == WHOLE
        if passing.any():
            yield out(WHOLE, np.flatnonzero(passing), c)
            c = {k: v[~passing] for k, v in c.items()}
        held.append(c)
        rows += len(c["key"])
        if rows < HELD // 8:
            continue
        c = {k: np.concatenate([h[k] for h in held]) for k in names}
        last = int(np.searchsorted(c["key"], c["key"][-1]))  # the last family may go on
        head = int(np.searchsorted(c["key"], c["key"][0], side="right")) if open_key == c["key"][0] else 0
        if last and head:
            yield from judged({k: v[:head] for k, v in c.items()}, True)
        if last > head:
            yield from judged({k: v[head:last] for k, v in c.items()}, False)
        if last:
            open_key = None
        c = {k: v[last:] for k, v in c.items()}
        if len(c["key"]) > HELD:  # a family too large to hold goes on span by span
            cut = int(np.searchsorted(c["span"], c["span"][-1]))
            if cut:
                open_key = c["key"][0]
                yield from judged({k: v[:cut] for k, v in c.items()}, True)
                c = {k: v[cut:] for k, v in c.items()}
            else:  # one span over and over: a repeat, of which two counts tell enough
                yield out(WHOLE, np.flatnonzero(c["n"][:-1] == 1), c)
                c = {k: v[-1:] for k, v in c.items()}
                c["n"] = np.full(1, 2, dtype=np.int8) if c["n"][0] > 1 else c["n"]
                c = {k: np.concatenate([v, v]) for k, v in c.items()}
                c["n"][0] = 2
        held, rows = [c], len(c["key"])
    if rows:
        c = {k: np.concatenate([h[k] for h in held]) for k in names}
        head = int(np.searchsorted(c["key"], c["key"][0], side="right")) if open_key == c["key"][0] else 0
        if head:
            yield from judged({k: v[:head] for k, v in c.items()}, True)
        if len(c["key"]) > head:
            yield from judged({k: v[head:] for k, v in c.items()}, False)


def united(starts, ends):
    """Maximal runs of byte intervals that overlap or touch."""
    import numpy as np

    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.r_[True, starts[1:] > ends[:-1]]
    return starts[fresh], ends[np.r_[np.flatnonzero(fresh)[1:] - 1, len(ends) - 1]]


def kept_bytes(text: bytes, starts, ends) -> bytes:
    out, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        out.append(text[at:a])
        at = b
    return b"".join(out) + text[at:]


DONE, PENDING, SPAN = 0, 1, 2


def _schema(rows: DataFrame):
    """Spark's schema of finished, pending and span lines; ``id`` may be any type."""
    long = F.lit(0).cast("long")
    fields = rows.select(
        F.lit(0).cast("byte").alias("what"), "id", *[long.alias(c) for c in ("doc", "tag", "key", "n_bytes", "n_removed", "n_spans")],
        F.lit("").alias("kept_sha256"), F.lit("").cast("binary").alias("data"), F.array(long).alias("ranges"),
        F.lit(0).cast("byte").alias("weight")).schema
    return StructType([StructField(f.name, f.dataType) for f in fields])


def _rows(schema_type, rows: list[dict]):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist(rows, schema=schema_type)


def _finished(row: dict, text: bytes, starts, ends, with_text: bool) -> dict:
    import hashlib

    kept = kept_bytes(text, starts, ends)
    return row | {"what": DONE, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(starts),
                  "kept_sha256": hashlib.sha256(kept).hexdigest(), "data": kept if with_text else None}


def _arrow_schema(id_type):
    import pyarrow as pa

    return pa.schema([("what", pa.int8()), ("id", id_type), ("doc", pa.int64()), ("tag", pa.int64()), ("key", pa.int64()),
                      ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                      ("data", pa.binary()), ("ranges", pa.list_(pa.int64())), ("weight", pa.int8())])


def _place(length: int, with_text: bool):
    """Task body: documents with their spans -> finished documents, pending
    ones (with the ranges known so far), and the texts of edges and twins."""

    def run(batches):
        import numpy as np

        for b in batches:
            schema = _arrow_schema(b.column(0).type)
            found = b.column(4)
            count = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = found.flatten()
            kind, at, key = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("kind", "at", "key"))
            stop = np.cumsum(count)
            rows = []
            for k, (id_, doc, tag, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                                          b.column(2).to_pylist(), byte_list(b.column(3)))):
                own = slice(stop[k] - count[k], stop[k])
                first = (at[own] >> 8) & 0xFFFFFFFF
                last = first + (at[own] & 0xFF)
                whole = kind[own] != EDGE
                starts, ends = united(first[whole], last[whole] + length)
                row = {"id": id_, "doc": doc, "tag": tag}
                sent = set()
                for j in np.flatnonzero(kind[own] != WHOLE).tolist():
                    place = int(first[j])
                    if (place, int(key[own][j])) not in sent:  # equal rows bring equal spans
                        sent.add((place, int(key[own][j])))
                        rows.append({"what": SPAN, "doc": doc, "tag": tag, "key": int(key[own][j]), "n_bytes": place,
                                     "data": text[place:int(last[j]) + length], "weight": 1 if kind[own][j] == EDGE else 2})
                if (kind[own] == EDGE).any():
                    rows.append(row | {"what": PENDING, "data": text, "ranges": np.stack([starts, ends], axis=1).ravel().tolist()})
                else:
                    rows.append(_finished(row, text, starts, ends, with_text))
            yield _rows(schema, rows)

    return run


def _repeats(length: int, shard_bytes: int, symbol: int):
    """Task body: the spans of one unit -> ``doc, tag, a, b``, byte ranges of edges that are repeated."""

    def run(_, group):
        import numpy as np
        import pyarrow as pa

        weight = group["weight"].to_numpy()
        whole, flags = bwt.repeated(group["data"].to_pylist(), weight, length, shard_bytes, symbol)
        flags &= (weight == 1)[whole.owner]
        inner = np.arange(whole.n) > whole.starts[whole.owner] if whole.n else flags
        begin = np.flatnonzero(flags & ~(np.r_[False, flags[:-1]] & inner))
        follows = np.r_[inner[1:], False] & np.r_[flags[1:], False]
        end = np.flatnonzero(flags & ~follows)
        owner = whole.owner[begin]
        base = group["n_bytes"].to_numpy()[owner] - whole.starts[owner]
        return pa.table({"doc": group["doc"].combine_chunks().take(pa.array(owner)), "tag": group["tag"].combine_chunks().take(pa.array(owner)),
                         "a": pa.array(begin + base, pa.int64()), "b": pa.array(end + base + length, pa.int64())})

    return run


def span_repeats(found: DataFrame, length: int, unit: int, shard_bytes: int, symbol: int, hot_family: int) -> DataFrame:
    """Repeated byte ranges of the edges among spans (``key, doc, tag, n_bytes``
    (place), ``data``, ``weight``)."""
    families = found.groupBy("key").count()
    # written, so that its real size decides the join: small beside the spans, it spares hot families a shuffle by key
    hot = stash(families.where(F.col("count") > hot_family)
                .select("key", F.ceil(F.col("count") / hot_family).cast("int").alias("chunks")), "hot")
    total = found.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    units = max(1, -(-total // unit))
    own = F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("doc", "n_bytes"), F.col("chunks")).cast("int")).otherwise(0)
    met = (found.join(hot, "key", "left").withColumn("own", own)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
           # a pair of chunks of a hot family is a unit of its own; other families share units
           .withColumn("unit", F.when(F.col("chunks").isNull(), F.pmod(F.xxhash64("key"), F.lit(units)))
                       .otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))))
    return met.select("unit", "doc", "tag", "n_bytes", "data", "weight").groupBy("unit").applyInArrow(
        _repeats(length, shard_bytes, symbol), "doc long, tag long, a long, b long")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 reach: int = REACH, symbol: int = SYMBOL, unit: int = UNIT, shard_bytes: int = SHARD,
                 hot_family: int = HOT_FAMILY, with_text: bool = False) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_removed, n_spans`` (maximal
    removed runs), ``kept_sha256`` and, if asked for, ``kept`` (the bytes that stay)."""
    if length % symbol or symbol < bwt.WORD or not GRAM <= length - reach + 1 or reach > 256:
        raise ValueError("length is a multiple of symbol (8 or more) and leaves 8 bytes or more behind reach (256 at most)")
    prepare(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("doc"),
                       F.xxhash64(text, F.lit("tag"), F.col(id_col)).bitwiseAND(F.lit(0x7FFFFF)).alias("tag"), text.alias("text"))
    found = stash(spans(rows.select("doc", "tag", "text"), length, reach).repartition("key")
                  .sortWithinPartitions("kind", "key", "span")
                  .mapInArrow(_resolve, "kind byte, key long, doc long, at long"), "spans")
    # sets: equal rows share a name, and each brings the same spans
    of_doc = found.groupBy("doc", F.shiftright("at", 40).alias("tag")).agg(F.collect_set(F.struct("kind", "at", "key")).alias("found"))
    schema = _schema(rows)
    state = stash(rows.join(of_doc, ["doc", "tag"], "left").select("id", "doc", "tag", "text", "found")
                  .mapInArrow(_place(length, with_text), schema), "documents")
    ranges = (span_repeats(state.where(F.col("what") == SPAN), length, unit, shard_bytes, symbol, hot_family)
              .groupBy("doc", "tag").agg(F.collect_set(F.struct("a", "b")).alias("more")))

    def finish(batches):
        import numpy as np

        for b in batches:
            out = []
            for id_, doc, tag, data, known, more in zip(*(b.column(k).to_pylist() for k in range(6))):
                known = np.array(known, dtype=np.int64).reshape(-1, 2)
                new = np.array([[x["a"], x["b"]] for x in more or []], dtype=np.int64).reshape(-1, 2)
                both = np.concatenate([known, new])
                out.append(_finished({"id": id_, "doc": doc, "tag": tag}, data, *united(both[:, 0], both[:, 1]), with_text))
            yield _rows(_arrow_schema(b.column(0).type), out)

    pending = state.where(F.col("what") == PENDING).select("id", "doc", "tag", "data", "ranges")
    late = pending.join(ranges, ["doc", "tag"], "left").select("id", "doc", "tag", "data", "ranges", "more").mapInArrow(finish, schema)
    return state.where(F.col("what") == DONE).unionByName(late).select(
        F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *([F.col("data").alias("kept")] if with_text else []))
