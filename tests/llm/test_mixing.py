from collections import defaultdict

import pytest

from findings_lake.llm import mixing as M

from .conftest import CLASHES, ODD_TEXTS


def plain_targets(sizes):
    w = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    total, capped = 1.5 * sum(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        left = total - sum(2 * sizes[k] for k in capped)
        out = [2.0 * sizes[k] if k in capped else left * w[k] / sum(w[j] for j in free) for k in range(len(sizes))]
        over = {k for k in free if out[k] > 2 * sizes[k]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("sizes", [[10], [100, 100, 100], [1, 1000, 5, 0, 40], [0, 0], [7, 7, 7, 7000, 7], []])
def test_targets(sizes):
    assert M.targets(sizes) == pytest.approx(plain_targets(sizes))


def test_schedule_follows_the_shares(spark):
    edges = [0.5, 0.6, 1.0]
    rows = sorted((r.slot, r.source_no, r["rank"]) for r in M.schedule(spark, edges, 150_000).collect())
    assert [r[0] for r in rows] == list(range(150_000))
    seen = defaultdict(int)
    for slot, source, rank in rows:
        assert rank == seen[source]
        seen[source] += 1
        if slot > 100:  # every prefix is close to the shares
            share = (0.5, 0.1, 0.4)[source]
            assert abs(seen[source] - share * (slot + 1)) < 12


def test_mix(spark, documents):
    texts = [f"w{k} " * (k % 37 + 1) for k in range(400)] + ODD_TEXTS + ["same words here"] * 3 + ["long " * 9000]
    sources = [("b", "a", None, "c")[k % 4] if k < 400 else "a" for k in range(len(texts))]
    ids = list(range(len(texts) - 3)) + [0, 0, None]
    docs = documents(texts, sources, ids, extra=CLASHES)
    runs = []
    for parts in (1, 5):
        d, p = M.mix(docs.repartition(parts))
        runs.append(M.taken(d, p).collect())
    key = lambda r: (str(r.id), r.source or "", r.size, r.target, r.source_size, r.taken)
    assert sorted(map(key, runs[0])) == sorted(map(key, runs[1]))
    rows = runs[0]
    assert len(rows) == len(texts)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = (r.target, r.source_size)
    order = ["a", "b", "c", None]
    want = plain_targets([size[s] for s in order])
    for s, t in zip(order, want):
        assert target[s] == (pytest.approx(t), size[s])
        assert abs(taken[s] - t) <= 1


def test_pieces_are_runs_of_words(documents):
    docs, pieces = M.mix(documents(["a b c d e f g " * 10] * 20, ["x", "y"] * 10))
    size = {r.row: r["size"] for r in docs.collect()}
    own = defaultdict(list)
    slots = set()
    for r in pieces.collect():
        own[r.row, r.epoch].append((r.start, r.length))
        slots.add(r.slot)
    for (row, _), parts in own.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at <= size[row]
    assert len(slots) > 10


def test_empty(documents):
    d, p = M.mix(documents(["a"]).limit(0))
    assert M.taken(d, p).collect() == []
    d, p = M.mix(documents([None, "", " "]))
    assert [r.taken for r in M.taken(d, p).collect()] == [0, 0, 0]


@pytest.mark.parametrize("at", range(4))
def test_small_sources_beside_large_ones(spark, at, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BOUNDS", (4096, 4096))
    sizes = {f"s{k}": 60_000 for k in range(12)} | {f"s{k}b": words for k, words in zip(range(at, 12, 4), (1, 7, 300))}
    rows = [(k, "w " * 1000, s) for s, n in sizes.items() for k in range(n // 1000)]
    rows += [(k, "few " * (n % 1000), s) for k, (s, n) in enumerate(sizes.items()) if n % 1000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    d, p = M.mix(docs)
    taken, target = defaultdict(int), {}
    for r in M.taken(d, p).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(target) == 15 and all(abs(taken[s] - t) <= 1 for s, t in target.items())
    slots = {(r.slot, r.source) for r in p.join(d.select("row", "source"), "row").select("slot", "source").collect()}
    assert len(slots) == len({slot for slot, _ in slots})  # no slot serves two sources
