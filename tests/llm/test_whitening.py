import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from findings_lake.llm import whitening as W

from .conftest import CLASHES

ROWS = "vec_id long, embedding array<float>, label int"


def brute_force(rows, scale=64, offset=1_000_000, most=16):
    """``vec_id, component -> (n, deviation, |whitened|, explained)`` by numpy on whole matrices."""
    fit = [(i, v) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    usual = max({len(v) for _, v in fit}, key=lambda d: (sum(len(v) == d for _, v in fit), d))
    fit = [(i, [math.floor(scale * float(np.float32(c))) + offset for c in v]) for i, v in fit if len(v) == usual]
    distinct = sorted({tuple(x) for _, x in fit})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in distinct])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    out = []
    for i, x in fit:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        y = np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ axes[:, order] / np.sqrt(values[order])
        out += [(i, k + 1, n, deviation, abs(y[k]), values[order][k] / values.sum()) for k in range(len(order))]
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[1], r[3], round(r[4], 6))
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=key)
    want = sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-6, atol=1e-8)


def clouds(n, d, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(1.0, 0.2, d)).astype(np.float32).tolist()


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_equals_whole_matrices(spark, block_rows):
    vectors = clouds(120, 20, 1)
    rows = [(k, v, k % 3) for k, v in enumerate(vectors)]
    rows += [(500 + k, vectors[3], None) for k in range(60)] + [(3, vectors[3], 0), (None, vectors[4], 1)]
    rows += [(600, None, 0), (601, [], 0), (602, [None] + vectors[0][1:], 0), (603, [float("nan")] + vectors[0][1:], 0),
             (604, [float("inf")] + vectors[0][1:], 0), (605, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows, ROWS)
    for name in (*CLASHES, "x", "v", "number", "block", "deviation", "component"):
        table = table.withColumn(name, F.lit("clash"))
    got = W.whiten(table, block_rows=block_rows).collect()
    same(got, brute_force(rows))
    assert all(r.identity_error < 1e-9 for r in got) and len({r.identity_error for r in got}) == 1


def test_few_dimensions_and_wide_vectors(spark, monkeypatch):
    rows = [(k, v, 0) for k, v in enumerate(clouds(50, 3, 2))]
    same(W.whiten(spark.createDataFrame(rows, ROWS)).collect(), brute_force(rows))
    monkeypatch.setattr(W, "BLOCK_COLUMNS", 4)
    rows = [(k, v, 0) for k, v in enumerate(clouds(90, 10, 3))]
    same(W.whiten(spark.createDataFrame(rows, ROWS), block_rows=16).collect(), brute_force(rows))


def test_components_without_variance_and_exact_deviations(spark):
    rng = np.random.default_rng(5)
    flat = [(k, [float(a), float(a), float(b)], 0) for k, (a, b) in enumerate(rng.normal(size=(40, 2)).astype(np.float32))]
    got = W.whiten(spark.createDataFrame(flat, ROWS)).collect()
    assert {r.component for r in got} == {1, 2}
    # n * x is beyond 64 bits here, the deviations are not
    far = [(k, [float(2 ** 52 + k), float(-k * 3 % 7)], 0) for k in range(40)]
    got = W.whiten(spark.createDataFrame(far, ROWS.replace("float", "double"))).collect()
    x = [[64 * (2 ** 52 + k) + 10 ** 6, 64 * (-k * 3 % 7) + 10 ** 6] for k in range(40)]
    sums = [sum(c) for c in zip(*x)]
    assert {r.vec_id: r.deviation for r in got} == {k: sum((40 * c - s) ** 2 for c, s in zip(v, sums)) for k, v in enumerate(x)}
    beyond = W.whiten(spark.createDataFrame([(k, [1e17 * k, float(k % 2)], 0) for k in range(4)], ROWS)).collect()
    assert all(r.deviation is None for r in beyond)
    assert W.whiten(spark.createDataFrame([(1, [1e30, 1.0], 0), (2, [1.0, 2.0], 0)], ROWS)).collect() == []


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(k, [0.5, 0.5], 0) for k in range(9)]])
def test_nothing_to_whiten(spark, rows):
    got = W.whiten(spark.createDataFrame(rows, ROWS))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.collect() == []
