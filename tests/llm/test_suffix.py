import hashlib
import random
from collections import Counter

import pytest

from findings_lake.llm import bwt
from findings_lake.llm import suffix_dedup as S

from .conftest import CLASHES, ODD_TEXTS


def test_merged_transforms_equal_counting():
    rng = random.Random(3)
    for _ in range(40):
        symbol = rng.choice([8, 20, 40])
        length = symbol * rng.choice([1, 2, 3])
        letters = rng.choice([b"a", b"ab", b"abc\0", bytes(range(256))])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(4)]
        strings = []
        for _ in range(rng.randint(1, 14)):
            s = rng.choice(base)
            strings.append(bytes(rng.choice(letters) for _ in range(rng.randint(0, 9))) + s[rng.randint(0, len(s)):] + rng.choice(base))
        weights = [rng.choice([1, 1, 2]) for _ in strings]
        count = Counter()
        for s, w in zip(strings, weights):
            for p in range(len(s) - length + 1):
                count[s[p:p + length]] += w
        want = [p + length <= len(s) and count[s[p:p + length]] >= 2 for s in strings for p in range(len(s))]
        assert bwt.repeated(strings, weights, length, rng.choice([30, 100, 10**6]), symbol)[1].tolist() == want


def test_merge_orders_suffixes_and_tells_common_prefixes():
    strings = [b"banana-bandana-banana", b"a bandana and a banana", b"ananas"]
    whole = bwt.Collection(strings, 8)
    depth = 2
    shards = [bwt.Shard(whole, [k], depth) for k in range(3)]
    places, common = bwt.merge(shards, depth)
    text = [strings[whole.owner[p]][len(strings[whole.owner[p]]) - whole.left[p]:] for p in places if p >= 0]
    assert [t[:8] for t in text] == sorted(t[:8] for t in text)
    places = places.tolist()
    assert sorted(p for p in places if p >= 0) == list(range(whole.n))
    for a, b, n in zip(places, places[1:], common[1:].tolist()):
        if a >= 0 and b >= 0 and n == depth:
            assert min(whole.left[a], whole.left[b]) <= 16 or (
                strings[whole.owner[a]][-whole.left[a]:][:16] == strings[whole.owner[b]][-whole.left[b]:][:16])


def plain(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(x[p:p + length] for x in data for p in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if count[x[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone) if not g)
        runs = sum(1 for p in range(len(x)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((len(x), len(x) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("unit,shard_bytes,hot_family", [(2000, 700, 3), (S.UNIT, S.SHARD, S.HOT_FAMILY)])
def test_removed_bytes_equal_counting(documents, unit, shard_bytes, hot_family):
    rng = random.Random(unit)
    word = lambda: "".join(rng.choice("abcdefghijklmnopéü") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(70) for _ in range(3)]
    texts = [prose(30) + " " + rng.choice(shared) + " " + prose(30) for _ in range(40)] + [prose(120) for _ in range(10)]
    near = prose(150)
    for _ in range(12):
        at = rng.randrange(len(near))
        texts.append(near[:at] + rng.choice("XYZ") + near[at + 1:])
    texts += [near, near, "ab" * 400, "q" * 1000, prose(5) + "q" * 300, "\n".join([prose(9)] * 40)]
    edge = prose(60)[:260]
    texts += [edge[:199] + "!", "?" + edge[:199], edge[:200], "x" + edge[:200] + "y", edge[60:260] + edge[60:259]]
    texts += ODD_TEXTS
    ids = [*range(len(texts) - 2), 4, None]
    rows = S.suffix_dedup(documents(texts, ids=ids, extra=CLASHES).repartition(4), unit=unit, shard_bytes=shard_bytes,
                          hot_family=hot_family, with_text=True).collect()
    want = sorted((str(i), *p) for i, p in zip(ids, plain(texts)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)


def test_families_too_large_to_hold(documents, monkeypatch):
    monkeypatch.setattr(S, "HELD", 16)
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = ["".join(rng.choice("ijklm ") for _ in range(50)) + shared + "".join(rng.choice("nopq ") for _ in range(50)) for _ in range(60)]
    texts += [texts[0]] * 30
    rows = S.suffix_dedup(documents(texts)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(plain(texts))


def test_empty(documents):
    assert S.suffix_dedup(documents(["a"]).limit(0)).collect() == []


def test_pieces_of_long_texts_give_the_same_result(documents, monkeypatch):
    rng = random.Random(12)
    body = "".join(rng.choice("abcdefghijk ") for _ in range(3000))
    texts = [body, body[500:2500], "z" * 30 + body[100:1200], "".join(rng.choice("lmnop ") for _ in range(900))]
    monkeypatch.setattr(S.anchors_in_pieces, "__defaults__", (S.LENGTH, S.REACH, 333))
    rows = S.suffix_dedup(documents(texts)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(plain(texts))
