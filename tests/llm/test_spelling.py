import random
import re
import zlib
from collections import Counter

import pytest

from findings_lake.llm import spelling as S

from .conftest import CLASHES, ODD_TEXTS


def one_edit(a, b):
    """By definition: try every deletion, insertion and replacement."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_force(texts, ids, least=5, count=3, modulus=97):
    words = Counter()
    for i, text in zip(ids, texts):
        lowered = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % modulus == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    words = {w: n for w, n in words.items() if n >= count and len(w) >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def corpus(seed, n=160):
    rng = random.Random(seed)
    syllables = ["an", "er", "thé", "On", "ra", "ß", "Ing", "st", "é", "ü"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 5))) for _ in range(90)]
    texts = []
    for _ in range(n):
        own = [words[min(int(rng.expovariate(0.05)), 89)] for _ in range(rng.randint(1, 60))]
        for k in range(len(own)):
            if rng.random() < 0.2:
                w, at = own[k], rng.randrange(len(own[k]))
                own[k] = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("aeéx") + w[at:], w[:at] + rng.choice("stü") + w[at + 1:]])
        texts.append(rng.choice([" ", ", ", "-", "1"]).join(own))
    return texts


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("chunk,groups,modulus", [(2048, None, 97), (3, 2, 97), (5, 6, 3)])
def test_equals_all_pairs(spark, documents, monkeypatch, chunk, groups, modulus):
    monkeypatch.setattr(S, "CHUNK", chunk)
    texts = corpus(4)
    ids = [k * 7 - 3 for k in range(len(texts))]
    got = S.spelling_variants(documents(texts, ids=ids, extra=CLASHES + ("n", "form", "own", "chunk")), groups=groups, modulus=modulus)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_force(texts, ids, modulus=modulus)
    assert rows(got) == want and sum(w[1] is not None for w in want) > 20


def test_odd_texts_ties_and_long_words(spark, documents):
    texts = ODD_TEXTS * 3 + ["x" * 5001] * 4 + ["x" * 4999 + "y"] * 9 + ["alpha alphb alphc"] * 3 + ["grape grapes"] * 5 + ["grape"] * 5
    ids = [None, *range(1, len(texts))]
    assert rows(S.spelling_variants(documents(texts, ids=ids))) == brute_force(texts, ids)
    assert rows(S.spelling_variants(documents([None, "", "one two"]))) == set()
    assert S.spelling_variants(documents(["a"]).limit(0)).collect() == []


def test_roots_follow_long_chains(spark):
    steps = [(f"w{k:02d}", f"w{k + 1:02d}") for k in range(37)] + [("a", "w10"), ("b", "w37")]
    got = {r.word: r.root for r in S.roots(spark.createDataFrame(steps, "word string, form string")).collect()}
    assert got == {w: "w37" for w, _ in steps}
