"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors are scaled to integers. A shard's index holds, for every dimension,
postings cut into segments of rows whose component falls into the same
quantised level. For a query each segment has an impact: what its level adds
at least over the dimension's least level. Segments of all dimensions are
processed by descending impact into accumulators. A shard stops only on
proof: when the k-th best lower bound exceeds every upper bound (accumulator
plus all that is still unprocessed plus the quantisation) of all other rows
that could be members; the rows that may be members are then scored exactly.

Every query meets every shard, in bounded blocks; what leaves a task is at
most k rows for each query, and the final choice is a top-k by query over
those. Scores beyond 64 bits count as the largest or smallest number. Vectors that are null or hold null or non-finite components take no
part; shorter vectors count as padded with zeros; repeated rows are rows of
their own and only a query's own row is left out; ties go to the smaller id
(null last); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stash
from .vectors import matrix

SCALE = 1024
#: Rows of an index shard; most and fewest rows of a query block, and (shard,
#: block) cells that are wanted before blocks grow: an index is sent once per
#: block, so large tables take the largest blocks.
SHARD_ROWS, QUERY_ROWS, LEAST_QUERY_ROWS, CELLS = 16_384, 16_384, 256, 64
#: Quantised levels on each side of zero.
LEVELS = 24
#: Share of a shard's postings that is processed between two attempts at a proof.
ROUND = 8
#: Beyond this, floating-point accumulators would not be exact.
EXACT = 1 << 52
#: Rows with a larger component (as an integer) are kept apart and scored one by one.
FAR = 1 << 36
#: Scores end where 64 bits do.
LARGEST = (1 << 63) - 1


def _pack(columns: dict) -> bytes:
    return pickle.dumps(columns, protocol=5)


def scaled(values):
    """``floor(SCALE * x)`` as integers (Python integers beyond 64 bits)."""
    import numpy as np

    with np.errstate(over="ignore"):
        grown = np.floor(values * SCALE)
    if not grown.size or np.abs(grown).max() < 1 << 62:
        return grown.astype(np.int64)
    # by the exact ratio of a number, which may be too large for a float when scaled
    return np.array([[n * SCALE // d for n, d in map(float.as_integer_ratio, r)] for r in values.tolist()], dtype=object)


def build_index(ids, none, rows, values) -> dict:
    """The index of one shard: ``ids`` (``none`` marks null ones), ``rows`` and
    integer ``values``. Rows with components too large for postings lie under
    ``far``, scored exactly as they are."""
    import numpy as np

    far = (np.abs(values) >= FAR).any(axis=1).astype(bool) if values.size else np.zeros(len(ids), dtype=bool)
    if far.any():
        near = build_index(ids[~far], none[~far], rows[~far], values[~far].astype(np.int64))
        return {**near, "far": {"ids": ids[far], "none": none[far], "rows": rows[far], "values": values[far].astype(object)}}
    most = max(1, int(abs(values).max())) if values.size else 1
    step = max(1, -(-most // LEVELS))
    level = (values // step).astype(np.int64)
    post, first, lows, dims = [], [0], [], []
    for j in range(values.shape[1]):
        order = np.argsort(level[:, j], kind="stable").astype(np.int32)
        ordered = level[order, j]
        cut = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        post.append(order)
        first += (np.r_[cut[1:], len(order)] + first[0] + j * len(order)).tolist()
        lows += ordered[cut].tolist()
        dims += [j] * len(cut)
    return {"ids": ids, "none": none, "rows": rows, "values": values, "step": step, "most": most,
            "post": np.concatenate(post) if post else np.zeros(0, np.int32), "first": np.array(first),
            "low": np.array(lows, dtype=np.int64) * step, "dim": np.array(dims, dtype=np.int64)}


def _best(index, rows, scores, k: int, own):
    """The k best of candidate rows: score descending, smaller id first."""
    import numpy as np

    keep = index["rows"][rows] != own
    rows, scores = rows[keep], scores[keep]
    ids = index["ids"][rows]
    order = np.lexsort((index["rows"][rows], index["none"][rows], ids, ~scores))[:k]  # ~: descending, safe at the ends of 64 bits
    return rows[order], scores[order]


def search(index, query, k: int, own):
    """``(rows, scores)`` of the exact k best of a shard for one query."""
    import numpy as np

    values = index["values"]
    n, d = values.shape
    w = np.zeros(d, dtype=query.dtype)
    shared = min(d, len(query))
    w[:shared] = query[:shared]
    if n <= 2 * k or values.dtype == object or w.dtype == object or int(abs(w).max(initial=0)) * index["most"] * max(d, 1) >= EXACT:
        exact = [max(-LARGEST - 1, min(LARGEST, sum(x * y for x, y in zip(r, w.tolist())))) for r in values.tolist()]
        return _best(index, np.arange(n), np.array(exact, dtype=np.int64), k, own)
    weight, step = w[index["dim"]], index["step"]
    gain = np.where(weight >= 0, weight * index["low"], weight * (index["low"] + step - 1))  # least contribution
    least = np.full(d, np.iinfo(np.int64).max)
    np.minimum.at(least, index["dim"], gain)
    gain = gain - least[index["dim"]]
    slack = int(np.abs(w).sum()) * (step - 1)
    order = np.argsort(-gain, kind="stable")
    order = order[: int(np.count_nonzero(gain))]  # the rest adds nothing
    first, post, size = index["first"], index["post"], np.diff(index["first"])
    run = np.cumsum(size[order])
    acc = np.zeros(n)
    left_of = np.arange(len(order))
    at = 0
    while True:
        stop = int(np.searchsorted(run, (run[at - 1] if at else 0) + n * d // ROUND)) + 1
        chunk = order[at:stop]
        if len(chunk):
            rows = np.concatenate([post[a:b] for a, b in zip(first[chunk].tolist(), first[chunk + 1].tolist())])
            acc += np.bincount(rows, weights=np.repeat(gain[chunk].astype(float), size[chunk]), minlength=n)
        at = min(stop, len(order))
        rest = np.zeros(d)
        if at < len(order):  # the largest gain that is left in each dimension
            np.maximum.at(rest, index["dim"][order[at:]], gain[order[at:]])
        bar = np.partition(acc, n - k - 1)[n - k - 1]  # one place for the query's own row
        may = np.flatnonzero(acc + rest.sum() + slack >= bar)
        if at >= len(order) or len(may) <= max(4 * k, n // 64):
            return _best(index, may, values[may] @ w, k, own)


def top_k(vectors: DataFrame, query_filter, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, query_rows: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that meets
    ``query_filter`` (a column) the k best of all other rows."""
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(query_filter, F.lit(False)).alias("asks"),
                          F.col(vec_col).cast("array<double>").alias("v"))

    def parse(batches):
        import pyarrow as pa

        for b in batches:
            _, ok = matrix(b.column(2))
            yield pa.RecordBatch.from_arrays(b.columns, b.schema.names).filter(pa.array(ok))

    whole = stash(rows.mapInArrow(parse, rows.schema).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, asking = whole.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards = max(1, -(-n // shard_rows))
    if query_rows is None:
        query_rows = max(LEAST_QUERY_ROWS, min(QUERY_ROWS, asking * shards // CELLS))
    blocks = max(1, -(-asking // query_rows))

    def pack(build):
        def run(key, group):
            import numpy as np
            import pyarrow as pa

            ids = np.array([x if x is not None else LARGEST for x in group["id"].to_pylist()], dtype=np.int64)
            none = np.array([x is None for x in group["id"].to_pylist()], dtype=bool)
            own = group["row"].to_numpy()
            order = np.argsort(own)  # the same shard however its rows arrive
            values = scaled(matrix(group["v"])[0][order])
            data = build(ids[order], none[order], own[order], values)
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([_pack(data)], pa.binary())})
        return run

    def dealt(df, parts, build):
        return df.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(
            pack(build), "part int, data binary")

    index = stash(dealt(whole, shards, build_index), "index")
    asked = dealt(whole.where("asks"), blocks, lambda ids, none, own, values: {"ids": ids, "none": none, "rows": own, "values": values})
    index = index.select(F.col("part").alias("shard"), F.col("data").alias("index"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = asked.select(F.col("part").alias("block"), F.col("data").alias("queries"),
                         F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for packed, block in zip(batch.column(0), batch.column(1)):
                one, queries = pickle.loads(packed.as_py()), pickle.loads(block.as_py())
                out = [[] for _ in range(5)]
                parts = [one] + ([one["far"]] if "far" in one else [])
                for qid, none, own, q in zip(*(queries[c].tolist() for c in ("ids", "none", "rows")), queries["values"]):
                    for part in parts:
                        at, score = search(part, q, k, own)
                        found_ids = [None if x else i for i, x in zip(part["ids"][at].tolist(), part["none"][at].tolist())]
                        for column, x in zip(out, ([None if none else qid] * len(at), [own] * len(at), found_ids,
                                                   part["rows"][at].tolist(), score.tolist())):
                            column += x
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                                 ["query_id", "query_row", "vec_id", "row", "score"])

    found = (index.join(asked, ["shard", "block"]).select("index", "queries")
             .mapInArrow(run, "query_id long, query_row long, vec_id long, row long, score long"))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
