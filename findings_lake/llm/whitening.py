"""Embedding whitening with MLlib block matrices.

Entries become integers ``x = floor(scale * c) + offset``. Every distinct
integer vector is one row of the fit matrix: rows are numbered densely, cut
into blocks of bounded size, centred and handed to a ``BlockMatrix`` F. The
scatter matrix is ``F.transpose() * F`` (the long side is cut into as many
partial products as there are groups of blocks, so no task holds more than
a few blocks), its eigenvectors are found on the driver (one small matrix, a
row and a column per dimension), and a second block product projects all rows
on the scaled eigenvectors. Equal input rows take the values of their fit row.

What passes the driver: sums of each dimension, the block numbers, the small
square matrices. Sums and deviations are exact integers.

Rows are left out when the vector is null or empty, holds null or non-finite
entries, gives an ``x`` beyond 64 bits, or has another length than most
vectors (of equally frequent lengths the longest). Components without
variance (eigenvalues at the rounding error of the largest) don't exist, so
equal vectors alone, one vector or an empty table give no rows. A deviation
beyond 64 bits is null. Null ids and repeated rows are kept row by row; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, stash

#: Rows and bytes (as doubles) of a block; blocks of one partial product.
BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
GROUP_BLOCKS = 8
#: Columns of a block: wider vectors are cut.
BLOCK_COLUMNS = 1024


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int, offset: int) -> DataFrame:
    """``id, x`` of the rows that take part (all of one length)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    low, high = -float(2 ** 62), float(2 ** 62)
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & ((c * scale).between(low, high)))
    rows = rows.where(whole & (F.size("v") > 0))
    rows = rows.select("id", F.transform("v", lambda c: F.floor(c * scale).cast("long") + offset).alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual.d if usual else 0))


def _long_matrix(column):
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _column_sums(batches):
    import numpy as np
    import pyarrow as pa

    total = None
    for b in batches:
        if b.num_rows:
            x = _long_matrix(b.column(0))
            part = [(int(h) << 32) + int(l) for h, l in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
            total = part if total is None else [a + p for a, p in zip(total, part)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([str(t) for t in total])], ["k", "s"])


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table) with a dense ``number`` from 0, by two sums:
    the place inside a part and the sizes of the parts before it."""
    rows = rows.withColumn("part", F.shiftright("node", 33)).withColumn("place", F.col("node").bitwiseAND((1 << 33) - 1))
    sizes = rows.groupBy("part").agg((F.max("place") + 1).alias("size"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = sizes.select("part", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("start"))
    return rows.join(starts, "part").withColumn("number", F.col("start") + F.col("place")).drop("part", "place", "start")


def _pack(n: int, sums: list[int]):
    """Rows of a block -> one row with its integers and exact deviations."""

    def run(key, group):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(group["number"].to_numpy())
        node = group["node"].to_numpy()[order]
        x = _long_matrix(group["x"])[order]
        reach = max(max(abs(n * int(v) - s) for v in (lo, hi)) for lo, hi, s in zip(x.min(axis=0), x.max(axis=0), sums))
        if reach < 1 << 62 and reach * reach * len(sums) < 1 << 63 and n * max(abs(int(x.min())), abs(int(x.max()))) < 1 << 62:
            y = x * np.int64(n) - np.array(sums, dtype=np.int64)
            deviation = [int(v) for v in (y * y).sum(axis=1)]
        else:
            deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
        deviation = [d if d < 1 << 63 else None for d in deviation]
        return pa.table({"block": group["block"].slice(0, 1), "nodes": pa.array([node.tolist()], pa.list_(pa.int64())),
                         "deviations": pa.array([deviation], pa.list_(pa.int64())),
                         "data": pa.array([x.astype("<i8").tobytes()], pa.binary())})

    return run


def block_matrix(table: DataFrame, rows_of, columns: int, rows_per_block: int):
    """A ``BlockMatrix`` of the rows of ``table``: ``rows_of(batch)`` gives the
    (block number, numpy array) pairs of an Arrow batch, cut here into blocks
    of ``BLOCK_COLUMNS`` columns. Values go over as Arrow lists of doubles."""
    from pyspark.mllib.common import callMLlibFunc
    from pyspark.mllib.linalg import MatrixUDT
    from pyspark.mllib.linalg.distributed import BlockMatrix

    width = min(columns, BLOCK_COLUMNS)

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        def one(value, kind):
            return pa.array([value], kind)

        for b in batches:
            for number, y in rows_of(b):
                for k, lo in enumerate(range(0, columns, width)):
                    part = y[:, lo:lo + width]
                    flat = np.ascontiguousarray(part.ravel(order="F"))
                    none = pa.nulls(1, pa.list_(pa.int32()))
                    values = pa.ListArray.from_arrays(np.array([0, len(flat)], dtype=np.int32), flat)
                    at = pa.StructArray.from_arrays([one(number, pa.int64()), one(k, pa.int64())], ["_1", "_2"])
                    matrix = pa.StructArray.from_arrays(  # the layout of a dense matrix
                        [one(1, pa.int8()), one(part.shape[0], pa.int32()), one(part.shape[1], pa.int32()), none, none, values, one(False, pa.bool_())],
                        ["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"])
                    yield pa.RecordBatch.from_arrays([at, matrix], ["at", "matrix"])

    schema = T.StructType([T.StructField("at", T.StructType([T.StructField("_1", T.LongType()), T.StructField("_2", T.LongType())])),
                           T.StructField("matrix", MatrixUDT())])
    java = callMLlibFunc("createBlockMatrix", table.mapInArrow(cut, schema), rows_per_block, width, 0, 0)
    return BlockMatrix(java, rows_per_block, width)


def matrix_rows(matrix) -> DataFrame:
    """``block, y`` of a matrix with one column of blocks: every block's rows as
    doubles, row after row."""
    from pyspark.mllib.common import callMLlibFunc

    def flat(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            at, matrices = b.column(0), b.column(1)
            for k in range(b.num_rows):
                m = matrices[k]
                shape = (m["numRows"].as_py(), m["numCols"].as_py())
                y = m["values"].values.to_numpy(zero_copy_only=False).reshape(shape, order="C" if m["isTransposed"].as_py() else "F")
                yield pa.RecordBatch.from_arrays([pa.array([at[k]["_1"].as_py()], pa.int32()),
                                                  pa.array([np.ascontiguousarray(y, dtype="<f8").tobytes()], pa.binary())], ["block", "y"])

    return callMLlibFunc("getMatrixBlocks", matrix._java_matrix_wrapper._java_model).mapInArrow(flat, "block int, y binary")


def scatter(matrix, groups: int):
    """``matrix.transpose() * matrix`` as a numpy array. MLlib's multiply is
    told to cut the long middle side into ``groups`` partial products."""
    from pyspark.mllib.linalg.distributed import BlockMatrix

    turned = matrix.transpose()
    java = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, groups)
    product = BlockMatrix(java, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()
    return (product + product.T) / 2


def eigen(covariance, most: int):
    """Up to ``most`` unit eigenvectors (columns) by falling eigenvalue, those
    without variance left out; signs are set by the largest entry."""
    import numpy as np

    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:most]
    values, vectors = values[order], vectors[:, order]
    real = values > max(float(np.trace(covariance)), 0.0) * len(covariance) * np.finfo(float).eps
    values, vectors = values[real], vectors[:, real]
    if len(values):
        top = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
        vectors = vectors * np.where(top < 0, -1.0, 1.0)
    return values, vectors


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16,
           scale: int = 64, offset: int = 1_000_000, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per kept input row and component: ``id_col, component, n,
    deviation, whitened, explained, identity_error``."""
    import numpy as np
    from pyspark.mllib.linalg import DenseMatrix
    from pyspark.mllib.linalg.distributed import BlockMatrix

    spark = prepare(vectors.sparkSession)
    # two hashes, 128 bits, stand for a vector where rows meet their fit row
    rows = stash(integers(vectors, id_col, vec_col, scale, offset).withColumns(
        {"h0": F.xxhash64("x"), "h1": F.xxhash64(F.lit("whiten"), "x")}), "integers")
    kind = rows.schema["id"].dataType.simpleString()
    none = spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    fit = stash(rows.select("x", "h0", "h1").distinct().withColumn("node", F.monotonically_increasing_id()), "fit")
    sums = fit.select("x").mapInArrow(_column_sums, "k int, s string")
    sums = sums.groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    if not sums:
        return none
    sums, n = [int(r.s) for r in sums], fit.count()
    d = len(sums)
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * d)))
    count = -(-n // block_rows)
    groups = -(-count // GROUP_BLOCKS)
    dealt = numbered(fit.select("x", "node")).withColumn("block", F.floor(F.col("number") / block_rows).cast("int"))
    blocks = stash(dealt.repartition(groups, "block").groupBy("block").applyInArrow(
        _pack(n, sums), "block int, nodes array<long>, deviations array<long>, data binary"), "blocks")

    whole, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([(s % n) / n for s in sums])

    def centred(batch):
        for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(data.as_buffer(), "<i8").reshape(-1, d)
            yield number, (x - whole).astype(np.float64) - rest

    matrix = block_matrix(blocks.select("block", "data"), centred, d, block_rows)
    covariance = scatter(matrix, groups) / n
    values, axes = eigen(covariance, components)
    k = len(values)
    if not k:
        return none
    turn = axes / np.sqrt(values)
    width = matrix.colsPerBlock
    cut = [((b, 0), DenseMatrix(len(part), k, part.ravel(order="F"))) for b, part in
           ((b, turn[lo:lo + width]) for b, lo in enumerate(range(0, d, width)))]
    projected = matrix.multiply(BlockMatrix(spark.sparkContext.parallelize(cut, 1), width, k))
    found = stash(matrix_rows(projected), "projected")

    def centres(batches):
        import pyarrow as pa

        for b in batches:
            parts = [np.frombuffer(y, "<f8").reshape(-1, k).sum(axis=0) for y in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p.tolist() for p in parts], pa.list_(pa.float64()))], ["s"])

    totals = found.select("y").mapInArrow(centres, "s array<double>").agg(*[F.sum(F.col("s")[j]) for j in range(k)]).first()
    mean = np.array(totals, dtype=np.float64) / n

    def settled(batch):
        for number, y in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield number, np.frombuffer(y.as_buffer(), "<f8").reshape(-1, k) - mean

    white = block_matrix(found, settled, k, block_rows)
    error = float(np.abs(scatter(white, groups) / n - np.eye(k)).max())

    def opened(batches):
        import pyarrow as pa

        for b in batches:
            nodes, deviations, ys = (b.column(i) for i in range(3))
            y = np.concatenate([np.frombuffer(v, "<f8") for v in ys.to_pylist()] or [np.zeros(0)])
            stops = np.arange(len(y) // k + 1, dtype=np.int32) * k
            yield pa.RecordBatch.from_arrays([nodes.flatten(), deviations.flatten(), pa.ListArray.from_arrays(stops, y)],
                                             ["node", "deviation", "y"])

    values_of = blocks.select("block", "nodes", "deviations").join(found, "block").select("nodes", "deviations", "y").mapInArrow(
        opened, "node long, deviation long, y array<double>")
    # written, so that the join with the rows deals both sides anew and a very common vector can be split
    known = stash(fit.select("h0", "h1", "node").join(values_of, "node").select("h0", "h1", "deviation", "y"), "whitened")
    trace = float(np.trace(covariance))
    share = F.array(*[F.lit(float(v / trace)) for v in values])
    return (rows.select("id", "h0", "h1").join(known, ["h0", "h1"]).select("id", "deviation", F.posexplode("y").alias("at", "whitened"))
            .select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
                    "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
