import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from findings_lake.llm import language as L

from .conftest import CLASHES, ODD_TEXTS

def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


class Plain:
    """Interpolated Kneser-Ney by dictionaries, one language: the definition."""

    def __init__(self, words, order, symbols):
        self.order, self.symbols = order, symbols
        level = Counter()
        for word, n in words.items():
            shown = L.PAD * (order - 1) + word + L.END
            for k in range(len(word) + 1):
                level[shown[k:k + order]] += n
        self.levels = {order: level}
        for k in range(order - 1, 0, -1):
            fronts = defaultdict(set)
            for gram in self.levels[k + 1]:
                fronts[gram[1:]].add(gram[0])
            self.levels[k] = Counter({g: len(s) for g, s in fronts.items()})
        self.discount, self.total, self.types = {}, defaultdict(int), defaultdict(int)
        for k, counts in self.levels.items():
            once, twice = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
            self.discount[k] = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
            for gram, n in counts.items():
                self.total[k, gram[:-1]] += n
                self.types[k, gram[:-1]] += 1

    def chance(self, gram):
        k = len(gram)
        if not k:
            return 1 / (self.symbols + 1)
        total, lower = self.total.get((k, gram[:-1]), 0), self.chance(gram[1:])
        if not total:
            return lower
        d = self.discount[k]
        return max(self.levels[k].get(gram, 0) - d, 0) / total + d * self.types[k, gram[:-1]] / total * lower

    def word(self, word):
        shown = L.PAD * (self.order - 1) + word + L.END
        return sum(math.log(self.chance(shown[k:k + self.order])) for k in range(len(word) + 1))


def models(words, order):
    grams = Counter()
    for lang, counts in words.items():
        for word, n in counts.items():
            shown = L.PAD * (order - 1) + word + L.END
            for k in range(len(word) + 1):
                grams[lang, shown[k:k + order]] += n
    keys = list(grams)
    return L.Models(sorted(words), [k[1] for k in keys], [k[0] for k in keys], np.array(list(grams.values())), order)


WORDS = {"aa": Counter({"banana": 3, "band": 1, "nab": 2, "éa": 1}), "bb": Counter({"stone": 2, "tone": 1, "on": 5}), "cc": Counter({"x": 1})}


def test_probabilities_equal_the_definition_and_sum_to_one():
    for order in (1, 2, 4):
        m = models(WORDS, order)
        symbols = {c for counts in WORDS.values() for w in counts for c in w + L.END}
        plain = {lang: Plain(counts, order, len(symbols)) for lang, counts in WORDS.items()}
        tried = ["banana", "stone", "ban", "ton", "éé", "日本", "zq", "bananastone", "n"]
        sums, sizes = m.log_probability(tried)
        assert sizes.tolist() == [len(w) + 1 for w in tried]
        want = [[plain[lang].word(w) for lang in m.langs] for w in tried]
        assert np.allclose(sums, want, atol=1e-4)
        for context in ("", "b", "an", "ston", "日"):
            shown = (L.PAD * 3 + context)[len(context) + 3 - (order - 1):]
            for lang in m.langs:
                total = sum(plain[lang].chance(shown + c) for c in symbols) + plain[lang].chance(shown + "ꯍ")
                assert abs(total - 1) < 1e-9


def corpus(n, seed=1):
    rng = random.Random(seed)
    parts = {"en": ["th", "er", "ing", "on", "an"], "de": ["sch", "ung", "ei", "ß", "au"], "fr": ["eau", "é", "ti", "on", "èr"]}
    texts, langs = [], []
    for _ in range(n):
        lang = rng.choice(sorted(parts))
        texts.append(" ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))).capitalize())
        langs.append(lang)
    return texts, langs


def labelled(spark, texts, langs):
    return spark.createDataFrame([(k, t, g, "s") for k, (t, g) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string, source string")


def test_held_out_accuracy_rejection_and_clashing_columns(spark):
    texts, langs = corpus(600)
    texts += ["zzq xxkw qqzx wkxz " * 20] * 8
    langs += [None] * 8
    docs = labelled(spark, texts, langs)
    for name in (*CLASHES, "held_out", "lang_pred", "gram", "n", "share", "later"):
        docs = docs.withColumn(name, F.lit("clash"))
    rows = {r.doc_id: r for r in L.identify(docs, held_out()).collect()}
    assert len(rows) == len(texts)
    out = [k for k in range(600) if rows[k].held_out]
    assert 100 < len(out) < 200
    right = [rows[k].lang_pred == langs[k] for k in out]
    score = [rows[k].score for k in out]
    assert sum(right) / len(right) > 0.99 and all(0 <= s <= 1 for s in score) and abs(np.mean(score) - np.mean(right)) < 0.02
    assert sum(rows[k].rejected for k in out) <= 0.05 * len(out)
    assert all(rows[k].rejected for k in range(600, 608))


def test_never_learns_from_held_out_rows(spark):
    texts, langs = corpus(200, 2)
    docs = labelled(spark, texts, langs)
    held = [r.doc_id for r in docs.where(held_out()).collect()]
    other = [("xx" if k in set(held) else g) for k, g in enumerate(langs)]
    pick = lambda df: sorted(tuple(r) for r in df.drop("held_out").collect())
    assert pick(L.identify(docs, held_out())) == pick(L.identify(labelled(spark, texts, other), held_out()))


def test_sample_bound_and_languages_bound(spark):
    texts, langs = corpus(300, 3)
    rows = L.identify(labelled(spark, texts, langs), held_out(), fit_rows=60).collect()
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.95
    top = Counter(g for k, g in enumerate(langs) if not rows[k].held_out)
    rows = L.identify(labelled(spark, texts, langs), held_out(), max_languages=2, max_cells=400).collect()
    assert {r.lang_pred for r in rows} == {g for g, _ in sorted(top.items(), key=lambda x: (-x[1], x[0]))[:2]}


def test_odd_texts(spark, documents, monkeypatch):
    texts, langs = corpus(80, 4)
    odd = ODD_TEXTS + ["Ⅷ ½ 12", "x" * 300_000, "ΣΑΣ İstanbul", "á é", "same", "same", "same"]
    docs = labelled(spark, texts + odd, langs + [None] * len(odd))
    rows = {r.doc_id: r for r in L.identify(docs, held_out()).collect()}
    for k, text in enumerate(odd, 80):
        letters = any(c.isalpha() for c in text or "")
        assert (rows[k].lang_pred == "und") == (not letters) and 0 <= rows[k].score <= 1
        assert (rows[k].cross_entropy is None) == (not letters) and not (rows[k].rejected and not letters)
    monkeypatch.setattr(L, "AT_ONCE", 5)
    monkeypatch.setattr(L, "CACHE", 10)
    again = {r.doc_id: r for r in L.identify(docs, held_out()).collect()}
    assert all(abs((again[k].cross_entropy or 0) - (rows[k].cross_entropy or 0)) < 1e-9 for k in rows)


def test_nothing_to_learn(spark, documents):
    docs = documents(["some words", None]).withColumn("lang", F.lit(None).cast("string"))
    assert [(r.lang_pred, r.score, r.cross_entropy, r.rejected) for r in L.identify(docs, held_out()).collect()] == [("und", 0.0, None, False)] * 2
    assert L.identify(docs.limit(0), held_out()).collect() == []
