import random

import pytest

from findings_lake.llm import quality as Q

from .conftest import CLASHES, ODD_TEXTS


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    texts, bad = [], []
    for k in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        bad.append(k % 6 == 0)
        if bad[-1]:
            for _ in range(max(2, len(own) // 25)):
                own[rng.randrange(len(own))] = rng.choice(["zqfoul", "zqvile", "zqnasty"])
        texts.append(" ".join(own))
    return texts, bad


def test_rejects_alien_words_and_keeps_clean_text(spark, documents):
    texts, bad = corpus(1200)
    labels = spark.createDataFrame([(k, 1, int(b)) for k, b in enumerate(bad) if k % 4 < 2], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in Q.quality(documents(texts, extra=CLASHES), labels, keep=("doc_id", "text", "kept")).collect()}
    unseen = [k for k in range(len(texts)) if k % 4 > 1]
    clean = [rows[k].kept for k in unseen if not bad[k]]
    foul = [rows[k].kept for k in unseen if bad[k]]
    assert sum(clean) / len(clean) > 0.97 and sum(foul) / len(foul) < 0.03
    assert rows[5].document.text == texts[5] and rows[5].document.kept == "clash"


def test_slices_do_not_change_words(monkeypatch):
    text = b"alpha beta! GAMMA 12 delta-eps " * 50
    whole = [sorted(h.tolist()) for _, h in Q.ngrams([text])[:4]]
    monkeypatch.setattr(Q, "SLICE", 100)
    parts = [[] for _ in range(4)]
    for numbers, texts in Q._slices([text]):
        assert numbers == [0]
        for k, (_, h) in enumerate(Q.ngrams(texts)[:4]):
            parts[k] += h.tolist()
    assert [sorted(p) for p in parts[:3]] == whole[:3]


def test_ngrams_by_hand():
    families = Q.ngrams([b"Aa bb", b"", b"bb aa! \xc3\xa9"])
    part, word = families[0]
    assert part.tolist() == [0, 0, 2, 2, 2]
    assert word[0] == word[3] and word[1] == word[2] and len(set(word.tolist())) == 3
    assert families[4][0].tolist() == [0, 2, 2]


def test_odd_texts_without_labels_all_stay(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = Q.quality(documents(ODD_TEXTS + ["same"] * 3), none).collect()
    assert len(rows) == len(ODD_TEXTS) + 3 and all(r.kept for r in rows)
    assert Q.quality(documents(["a"]).limit(0), none).collect() == []


@pytest.mark.parametrize("values", [[1.0], [1.0] * 7, [0.1 * k for k in range(500)], [-1e300, 1e-300, 0.0, 1e300] * 5])
def test_kth_largest(spark, values):
    table = spark.createDataFrame([(v,) for v in values], "key double")
    for k in {1, min(2, len(values)), len(values) // 2 or 1, len(values)}:
        assert Q.kth_largest(table, k) == sorted(values, reverse=True)[k - 1]
