"""Bound-and-prune scoring: exact results, skipped cells, odd vectors."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from findings_lake.operators import retrieve as R

KB = "source string, chunk_pos long, cvss_severity string, embedding array<float>"


def clustered(spark, n=3000, d=24, centres=30, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, d))
    vec = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, d)) * 0.05
    vec = (vec / np.linalg.norm(vec, axis=1)[:, None]).astype(np.float32)
    vec[100:110] = vec[50]  # ties
    rows = [("CVE" if k % 3 == 0 else "CWE", k // 3 if k % 3 == 0 else k - k // 3 - 1, "HIGH", v.tolist()) for k, v in enumerate(vec)]
    return spark.createDataFrame(rows, KB), rows, vec


def brute_force(rows, queries, n):
    out = set()
    for source in ("CWE", "CVE"):
        mine = [r for r in rows if r[0] == source]
        pos = np.array([r[1] for r in mine])
        mat = np.array([r[3] for r in mine], dtype=np.float64)
        for qid, q in queries:
            score = mat @ np.asarray(q, dtype=np.float64)
            best = sorted(range(len(pos)), key=lambda j: (-round(score[j], 12), -pos[j]))[:n]
            out |= {(qid, source, rn, int(pos[j])) for rn, j in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block_rows,cluster_rows", [(4096, 64), (300, 32), (300, 100_000)])
def test_pruned_lists_equal_brute_force(spark, block_rows, cluster_rows):
    kb, rows, vec = clustered(spark)
    queries = [(str(k), vec[k * 7].tolist()) for k in range(60)] + [("far", [-1.0] * 24), ("zero", [0.0] * 24)]
    q = spark.createDataFrame(queries, "query_id string, embedding array<double>")
    got = R.top_n_per_source(q, kb, top_k=6, block_rows=block_rows, query_rows=20, cluster_rows=cluster_rows)
    assert {(r.query_id, r.source, r.rn, r.chunk_pos) for r in got.collect()} == brute_force(rows, queries, 4)


def test_most_cells_of_many_blocks_are_skipped(spark):
    kb, _, vec = clustered(spark)
    q = spark.createDataFrame([(str(k), vec[k * 7].tolist()) for k in range(60)], "query_id string, embedding array<double>")
    prof = {r.source: r for r in R.pruning_profile(q, kb, block_rows=500, cluster_rows=25, query_rows=20).collect()}
    for source in ("CWE", "CVE"):
        assert prof[source].n_cells >= 60 * 20
        assert prof[source].n_skipped > 0.5 * prof[source].n_cells
    everything = R.pruning_profile(q, kb, block_rows=500, cluster_rows=10 ** 6, query_rows=20).collect()
    assert all(r.n_skipped == 0 for r in everything)  # one cluster a block: nothing to skip


def test_bounds_hold_for_every_cluster():
    rng = np.random.default_rng(3)
    mat, vec = rng.normal(size=(700, 9)), rng.normal(size=(40, 9))
    parts = R.clusters(np.arange(700), mat, 50)
    assert sorted(np.concatenate([p for _, _, p, _ in parts]).tolist()) == list(range(700))
    for centre, radius, pos, own in parts:
        assert (np.diff(pos) < 0).all() and (own == mat[pos]).all()
        assert (vec @ own.T <= (vec @ centre + np.linalg.norm(vec, axis=1) * radius + 1e-9)[:, None]).all()
    pos, scores, skipped = R.pruned_top(vec, parts, 5)
    full = vec @ mat.T
    assert (pos == np.argsort(-full, axis=1)[:, :5]).all() and np.allclose(scores, -np.sort(-full, axis=1)[:, :5])


def test_odd_vectors_take_no_part(spark):
    good = [("CWE", k, None, [1.0, float(k)]) for k in range(5)] + [("CVE", k, "LOW", [0.5, float(k)]) for k in range(5)]
    odd = [("CWE", 10, None, None), ("CWE", 11, None, []), ("CWE", 12, None, [None, 1.0]), ("CVE", 13, "LOW", [float("nan"), 9.0]),
           ("CVE", 14, "LOW", [float("inf"), 9.0]), ("CWE", 15, None, [9.0, 9.0, 9.0])]
    q = spark.createDataFrame([("a", [0.0, 1.0]), ("b", None), ("c", []), ("d", [None, 1.0]), ("e", [1.0, 0.0, 0.0])],
                              "query_id string, embedding array<double>")
    kb = spark.createDataFrame(good + odd, KB)
    got = sorted((r.query_id, r.source, r.rn, r.chunk_pos) for r in R.top_n_per_source(q, kb, top_k=2).collect())
    assert got == [("a", "CVE", 1, 4), ("a", "CVE", 2, 3), ("a", "CWE", 1, 4), ("a", "CWE", 2, 3), ("e", "CWE", 1, 15)]


def test_cells_are_an_equi_join(spark):
    kb, _, _ = clustered(spark, 200)
    q = kb.where("source = 'CWE'").select(F.col("chunk_pos").alias("query_id"), "embedding")
    p = R.top_n_per_source(q, kb)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in p and "NestedLoop" not in p and "CartesianProduct" not in p


def cell(vec, chunks, n, cluster_rows=16, ids=None):
    """One cell scored in this process: ``{query: {source: [chunk_pos]}}`` by score and position, and its rows."""
    import pyarrow as pa

    q = pa.table({"query_id": ids or [str(k) for k in range(len(vec))], "embedding": [list(map(float, v)) for v in vec]})
    c = pa.table({"source": [x[0] for x in chunks], "chunk_pos": [x[1] for x in chunks],
                  "embedding": pa.array([list(map(float, x[2])) for x in chunks], pa.list_(pa.float64()))})
    batches = lambda t: pa.Table.from_batches(t.to_batches(max_chunksize=50), t.schema)
    rows = R._score(n, cluster_rows)(batches(q), batches(c)).to_pylist()
    out = {}
    for r in sorted(rows, key=lambda r: (-r["score"], -r["chunk_pos"])):
        out.setdefault(r["query_id"], {}).setdefault(r["source"], []).append(r["chunk_pos"])
    return out, rows


def test_a_query_meets_far_positions_in_one_block(spark):
    """A query is sent once for each block: before, a block held 32,768 positions, whatever a vector's size."""
    kb = spark.createDataFrame([(s, p, "HIGH", [1.0, float(p)]) for s in ("CWE", "CVE") for p in (0, 60_000, 120_000, 250_000)], KB)
    q = spark.range(50).selectExpr("cast(id as string) query_id", "array(1D, cast(id as double)) embedding")
    assert {r.source: r.n_cells for r in R.pruning_profile(q, kb).collect()} == {"CWE": 50, "CVE": 50}
    wide = spark.range(3).selectExpr("'CWE' source", "id * 4000 chunk_pos", "'' cvss_severity", "array_repeat(1F, 8192) embedding")
    asked = spark.range(5).selectExpr("cast(id as string) query_id", "array_repeat(1D, 8192) embedding")
    assert R.pruning_profile(asked, wide).first().n_cells == 15  # 2,048 such vectors fill a block


def test_lists_go_on_from_piece_to_piece(monkeypatch):
    monkeypatch.setattr(R, "PIECE_VALUES", 200)
    rng = np.random.default_rng(5)
    mat = rng.normal(size=(900, 8))
    mat[300:340], mat[700:720] = mat[7], mat[7]  # copies in several pieces, more than a list holds
    vec = np.concatenate([rng.normal(size=(60, 8)), mat[5:9], np.zeros((3, 8)), mat[7:8] * 1e200, mat[7:8] * 1e-200])
    chunks = [("CVE" if k % 3 == 0 else "CWE", k, v) for k, v in enumerate(mat)]
    got, rows = cell(vec, chunks, 5)
    assert len(rows) == len(vec) * 2 * 5
    for i, v in enumerate(vec):
        for source in ("CWE", "CVE"):
            mine = [k for s, k, _ in chunks if s == source]
            score = {k: (mat[k] * v).sum() / (np.abs(v).max() or 1) for k in mine}
            assert got[str(i)][source] == sorted(mine, key=lambda k: (-round(score[k], 10), -k))[:5], (i, source)


def test_scores_too_close_for_single_precision_are_told_apart():
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    step = rng.permutation(400)
    chunks = [("CWE", k, base * (1 + 1e-10 * int(step[k]))) for k in range(400)]
    got, rows = cell([base, -base, base * 1e-30], chunks, 4, cluster_rows=64)
    best = np.argsort(-step)
    assert got["0"]["CWE"] == best[:4].tolist() == got["2"]["CWE"]
    assert got["1"]["CWE"] == best[::-1][:4].tolist()
    assert all(r["score"] == pytest.approx(float(np.dot(chunks[r["chunk_pos"]][2], [base, -base, base * 1e-30][int(r["query_id"])])), rel=1e-14)
               for r in rows)


def test_the_smallest_vector_of_an_id_counts_across_slices():
    chunks = [("CWE", k, v) for k, v in enumerate(np.eye(3))]
    vec = [[0.0, 1.0, 0.0]] + [[1.0, 0.0, 0.0]] * 120 + [[0.0, 0.0, 1.0], [0.0, 1.0, -1.0]]
    got, rows = cell(vec, chunks, 1, ids=["a"] + [f"x{k}" for k in range(120)] + ["a", "b"])
    assert len(rows) == 122 and got["a"]["CWE"] == [2] and got["b"]["CWE"] == [1] and got["x7"]["CWE"] == [0]
