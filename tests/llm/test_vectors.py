import numpy as np
import pytest

from findings_lake.llm import hnsw
from findings_lake.llm.topk import top_k
from findings_lake.llm.vector_dedup import vector_groups

VECTORS = "vec_id long, embedding array<float>, label int, n_links string, node string"


def clouds(seed=1):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=16) for _ in range(300)]
    for k in range(0, 60, 3):
        rows += [rows[k] + rng.normal(size=16) * 0.08 for _ in range(3)]
    rows += [rows[7] + rng.normal(size=16) * 0.05 for _ in range(150)]
    return [r.astype(np.float32).tolist() for r in rows]


ODD = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 2.0], [1e30] * 16, [2e30] * 16]


@pytest.mark.parametrize("shard_rows", [64, 6144])
def test_groups_equal_all_pairs(spark, shard_rows):
    vectors = clouds()
    rows = [(k, v, k % 2, "x", "y") for k, v in enumerate(vectors)]
    rows += [(1000 + k, v, 1, "x", "y") for k, v in enumerate(ODD)]
    rows += [(2000, vectors[0], 0, "x", "y"), (2001, vectors[0], 0, "x", "y"), (2000, vectors[0], 0, "x", "y"),
             (2002, vectors[0], None, "x", "y"), (None, vectors[0], 0, "x", "y")]
    got = vector_groups(spark.createDataFrame(rows, VECTORS), shard_rows=shard_rows).collect()
    fit = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None
           for _, v, label, _, _ in rows]
    unit = [np.array(v, dtype=np.float64) / np.abs(v).max() if f else None for (_, v, _, _, _), f in zip(rows, fit)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    n = len(rows)
    links = [[j for j in range(n) if j != i and fit[i] and fit[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j])
              and unit[i] @ unit[j] >= 0.93] for i in range(n)]
    root = list(range(n))
    for i in range(n):  # spread the least number until nothing changes
        stack = [i] if root[i] == i else []
        while stack:
            for j in links[stack.pop()]:
                if root[j] > root[i]:
                    root[j] = root[i]
                    stack.append(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root[i]] = min(rows[i][0], least.get(root[i], rows[i][0]))
    want = sorted((str(rows[i][0]), len(links[i]), str(least.get(root[i])), rows[i][0] == least.get(root[i])) for i in range(n))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == want


def test_graph_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.build(x)
    q = x + rng.normal(size=x.shape).astype(np.float32) * 0.03
    ids, sims = hnsw.beam(x, graph[-1], q, hnsw._nearest(graph[:-1], x, q), 48)
    found = ids[np.arange(len(q)), sims.argmax(axis=1)]
    assert (found == np.arange(len(q))).mean() > 0.95


@pytest.mark.parametrize("shard_rows,query_rows", [(40, 3), (16_384, 256)])
def test_top_k_equals_brute_force(spark, shard_rows, query_rows):
    rng = np.random.default_rng(9)
    base = [rng.normal(size=8).astype(np.float32).tolist() for _ in range(150)]
    vectors = base + base[:30] + [[1.0] * 8] * 15 + [[1.0, 2.0]]
    rows = [(k, v, 0, "x", "y") for k, v in enumerate(vectors)] + [(900 + k, v, 0, "x", "y") for k, v in enumerate(ODD[:6])]
    rows += [(5, vectors[3], 0, "x", "y"), (None, vectors[3], 0, "x", "y")]
    from pyspark.sql import functions as F
    got = {}
    for r in top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0, shard_rows=shard_rows, query_rows=query_rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    live = [(i, np.pad(np.floor(1024 * np.array(v, dtype=np.float64)).astype(int), (0, 8 - len(v)))) for i, v, _, _, _ in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v) <= 8]
    wide = [(i, np.zeros(8, dtype=int)) for i, v, _, _, _ in rows if v == ODD[2]]
    for at, (i, q) in enumerate(live):
        if i is None or i % 5 or i == 5:
            continue
        others = [(-int(q @ v), j if j is not None else 1 << 62) for k, (j, v) in enumerate(live + wide) if k != at]
        want = [(k + 1, j if j < 1 << 62 else None, -s) for k, (s, j) in enumerate(sorted(others)[:10])]
        assert sorted(got[i]) == want
    assert len(got[5]) == 20  # two rows of one id ask on their own


def test_top_k_of_huge_and_few_vectors(spark):
    from pyspark.sql import functions as F
    rows = [(0, [3e15, 1.0], 0, "", ""), (1, [2e3, -5.0], 0, "", ""), (2, [1e30, 0.0], 0, "", "")]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") < 2).collect())
    v = [[int(np.floor(1024 * np.float64(np.float32(x)))) for x in r[1]] for r in rows]
    dot = lambda a, b: max(-1 << 63, min((1 << 63) - 1, sum(x * y for x, y in zip(v[a], v[b]))))
    # all beyond 64 bits: equal scores, the smaller id first
    assert got == [(0, 1, 1, dot(0, 1)), (0, 2, 2, dot(0, 2)), (1, 1, 0, dot(1, 0)), (1, 2, 2, dot(1, 2))]
    assert top_k(spark.createDataFrame(rows, VECTORS).limit(0), F.col("vec_id") < 2).collect() == []


@pytest.mark.parametrize("planted,between", [(15, False), (15, True)])
def test_sparse_pairs_survive_weak_links(planted, between):
    rng = np.random.default_rng(6)
    unit = lambda v: (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    x = unit(rng.normal(size=(4500, 48)))
    near = unit(x[:planted] + rng.normal(size=(planted, 48)) * 0.02)
    lost = rng.permutation(planted)  # rows that no link leads to
    if not between:
        x, lost = np.concatenate([x, near]), lost + len(x)
    graph = [np.where(np.isin(links, lost), -1, links) for links in hnsw.build(x)]
    q = near if between else x
    if between:
        q = unit(np.concatenate([rng.normal(size=(4000, 48)), near]))
    r, c = hnsw.near_pairs(x, graph, q, 0.93, **({} if between else {"same": True}))
    got = {(i, j) for i, j in zip(r.tolist(), c.tolist()) if between or i != j}
    want = {(4000 + k, k) for k in range(planted)} if between else {p for k in range(planted) for p in ((k, 4500 + k), (4500 + k, k))}
    assert len(got & want) >= 0.99 * len(want) and got <= want


def test_top_k_of_components_at_the_ends_of_floats_and_ids(spark):
    from fractions import Fraction

    from pyspark.sql import functions as F
    rng = np.random.default_rng(8)
    largest = (1 << 63) - 1
    rows = [(k, rng.normal(size=3).tolist(), 0, "", "") for k in range(60)]
    rows += [(100, [1e308, 1.0, -1e308], 0, "", ""), (101, [-1.7e308, 5e-324, 2.0], 0, "", ""), (102, [1e12, -1e12, 0.5], 0, "", ""),
             (largest, rows[3][1], 0, "", ""), (None, rows[3][1], 0, "", "")]
    table = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    asked = [0, 7, 100, 102, largest]
    got = {}
    for r in top_k(table, F.col("vec_id").isin(asked), k=64).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    v = [[int(Fraction(x) * 1024 // 1) for x in r[1]] for r in rows]
    for q in asked:
        own = next(k for k, r in enumerate(rows) if r[0] == q)
        scores = [(max(-1 << 63, min(largest, sum(a * b for a, b in zip(v[own], v[k])))), rows[k][0]) for k in range(len(rows)) if k != own]
        want = sorted(scores, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        assert got[q] == [(i, s) for s, i in want], q


@pytest.mark.parametrize("between", [False, True])
def test_links_of_a_large_label_come_through_the_graph(monkeypatch, between):
    """5,000 vectors, 2 % of them with a near copy: the beams give the links."""
    rng = np.random.default_rng(12)
    unit = lambda v: (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    x = unit(rng.normal(size=(5000, 64)))
    copies = unit(x[:100] + rng.normal(size=(100, 64)) * 0.035)
    if between:
        q = unit(np.concatenate([rng.normal(size=(4900, 64)), copies]))
    else:
        x = q = np.concatenate([x[:4900], copies])
    graph = hnsw.build(x)
    searched, compared, plain = [], [], hnsw.beam
    monkeypatch.setattr(hnsw, "beam", lambda x, links, q, *a: searched.append(len(q)) or plain(x, links, q, *a))
    monkeypatch.setattr(hnsw, "weak_rows", lambda *a, f=hnsw.weak_rows: compared.append(len(f(*a))) or f(*a))
    r, c = hnsw.near_pairs(x, graph, q, 0.93, same=not between)
    got = {p for p in zip(r.tolist(), c.tolist()) if between or p[0] != p[1]}
    full = q @ x.T >= 0.93
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(full))) if between or i != j}
    assert len(want) >= 100 and got <= want and len(got) >= 0.99 * len(want)
    assert sum(searched) >= 5000 and sum(compared) < 500  # every query went through the graph; few rows are scanned
