import random

import pytest
import xxhash

from findings_lake.llm import components as C
from findings_lake.llm import simhash as S
from findings_lake.llm.common import pieces_of

from .conftest import CLASHES, ODD_TEXTS


def plain_fingerprint(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, linked):
    group = list(range(n))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in linked:
        a, b = sorted((top(i), top(j)))
        group[b] = a
    return [top(i) for i in range(n)]


def expected_groups(ids, fps, bits=4):
    tops = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= bits])
    least = {}
    for i, t in zip(ids, tops):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    return [least.get(t) for t in tops]


def test_fingerprints_and_groups_of_odd_texts(spark, documents):
    long = "the quick brown fox jumps over a lazy dog and runs away from seven other animals " * 20
    texts = [*ODD_TEXTS, long, long.replace("seven", "eight", 1), long.upper(), "one two three four", "One  TWO three\nfour"]
    ids = [*range(len(texts) - 2), 3, None]
    got = S.simhash_groups(documents(texts, ids=ids, extra=CLASHES)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    want = sorted((str(i), f"{f:016x}", str(c)) for i, f, c in zip(ids, fps, expected_groups(ids, fps)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert len(got) == len(texts)


@pytest.mark.parametrize("hot", [3, 4096])
def test_links_equal_all_pairs(spark, hot):
    rng = random.Random(hot)
    fps = []
    for _ in range(60):  # chains of near fingerprints and one dense cloud
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 4)):
            fps.append(f)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << b
    cloud = rng.getrandbits(64)
    fps += [cloud ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    links = S.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot_key=hot)
    root = {r.node: r.root for r in C.components(links).collect()}
    tops = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i)
                              if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 4])
    least = {}
    for f, t in zip(fps, tops):
        least[t] = min(f, least.get(t, f))
    assert [root.get(f, f) for f in fps] == [least[t] for t in tops]


def test_block_masks_cover_every_choice():
    masks = [m & (2**64 - 1) for m in S.block_masks(4, 2)]
    rng = random.Random(1)
    for _ in range(2000):
        wrong = 0
        for b in rng.sample(range(64), 4):
            wrong |= 1 << b
        assert any(not wrong & m for m in masks)


def test_components_of_random_links(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 600)] + [(7, 7)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(links, "u long, v long")).collect()}
    tops = classes(601, links)
    assert all(got.get(i, i) == tops[i] for i in range(601))


def test_empty_tables(spark, documents):
    assert S.simhash_groups(documents(["a"]).limit(0)).collect() == []
    assert C.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_pieces_do_not_change_a_fingerprint(monkeypatch):
    text = ("alpha beta gamma delta epsilon " * 40 + "x" * 300 + " tail end").encode()
    whole = S.fingerprint(text, 4)
    for size in (1, 7, 64, 500):
        monkeypatch.setattr(S, "pieces_of", lambda t, size=size: pieces_of(t, size))
        assert S.fingerprint(text, 4) == whole
        assert b"".join(pieces_of(text, size)) == text
