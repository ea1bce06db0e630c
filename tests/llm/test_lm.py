import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from findings_lake.llm import lm

from .conftest import CLASHES, ODD_TEXTS


def test_base_scores_and_better_model(documents):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    nxt = {w: rng.sample(words, 3) for w in words}

    def sentence():
        w, out = rng.choice(words), []
        for _ in range(rng.randint(20, 80)):
            out.append(w)
            w = rng.choice(nxt[w])
        return " ".join(out)

    texts = ODD_TEXTS + [sentence() for _ in range(1500)] + ["unseen" + str(k) + " Words" for k in range(30)]
    ids = [*range(len(texts) - 2), 3, None]
    rows = lm.lm_scores(documents(texts, ids=ids, extra=CLASHES), table_words=250, rounds=2).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [[w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w] + [b"\n"] for t in texts]
    count = Counter(w for i, ws in zip(ids, tokens) if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(ws), sum(count[w] > 0 for w in ws), n,
                   round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in zip(ids, tokens))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == want
    chain = [r for r in rows if r.held_out and r.n_tokens > 15 and r.n_known == r.n_tokens]
    assert sum(r.score for r in chain) > sum(r.base_score for r in chain) * 0.9  # log10: closer to zero is better
    assert all(r.score < 0 for r in rows)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    words = [f"k{i}".encode() for i in range(2500)] + [lm.END]
    counts = sorted(rng.integers(1, 900, len(words)).tolist(), reverse=True)
    named, rare = words[:lm.CLASSES * lm.CLASS_WORDS], words[lm.CLASSES * lm.CLASS_WORDS:]
    tail = [[0, 0] for _ in range(lm.TAIL)]
    for w, c in zip(rare, counts[len(named):]):
        tail[lm.ending(w)][0] += 1
        tail[lm.ending(w)][1] += c
    lex = lm.Lexicon(words, counts, tail, sum(counts), len(words))
    outer, inner = (rng.normal(size=s).astype(np.float32) for s in lm._shapes())
    feature = np.array([[3], [77], [512], [8000]])
    log_class = lm.softmax_log(lm.summed(outer, feature) + lex.bias)[0]
    total = 0.0
    for k in range(lm.CLASSES):
        z = lm.softmax_log(lm.summed(inner, lex.rows_inside(feature, np.array([k]))) + lex.inner_bias[[k]])[0]
        total += math.exp(log_class[k]) * np.exp(z).sum()
    for t in range(lm.TAIL):  # add-one unigram inside, one share for unseen words
        known = sum(c + 1 for w, c in zip(rare, counts[len(named):]) if lm.ending(w) == t)
        total += math.exp(log_class[lm.CLASSES + t]) * (known + 1) / 10 ** lex.log_tail[lm.CLASSES + t]
    assert abs(total - 1) < 1e-4


def test_ending_agrees_with_sql(spark):
    from pyspark.sql import functions as F
    words = ["a", "abcd", "abcde", "été", "ééé", "日本語", "\n", "x" * 50]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", lm.ending_column(F.col("w")).alias("t")).collect()
    assert all(r.t == lm.ending(r.w.encode()) for r in rows)


def test_empty(documents):
    assert lm.lm_scores(documents(["a"]).limit(0)).collect() == []
    assert len(lm.lm_scores(documents([None, ""])).collect()) == 2


def test_rare_words_are_contexts_and_goals(documents):
    rng = random.Random(5)
    chain = [f"{rng.getrandbits(40):x}" for _ in range(6000)]
    common = [f"c{k}" for k in range(lm.CLASSES * lm.CLASS_WORDS)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    texts, turned = [], set()
    for i in range(1600):
        at = rng.randrange(len(chain) - 100)
        words = chain[at:at + 100]
        if held(i) and i % 2:
            rng.shuffle(words)
            turned.add(i)
        texts.append(" ".join(words))
    texts += [" ".join(common)] * 80  # so frequent that no word of the chain is among the model's first words
    rows = [r for r in lm.lm_scores(documents(texts), table_words=4000, rounds=2).collect() if r.held_out and r.doc_id < 1600]
    gain = lambda own: np.mean([(r.score - r.base_score) / r.n_tokens for r in rows if (r.doc_id in turned) == own])
    assert gain(False) > gain(True) + 0.2


def test_probabilities_of_a_deep_tree_sum_to_one():
    rng = np.random.default_rng(1)
    words = [f"k{i}".encode() for i in range(30000)] + [lm.END]
    counts = sorted(rng.integers(1, 900, len(words)).tolist(), reverse=True)
    levels = lm.depth(len(words))
    tail = np.zeros((lm.TAIL * lm.CLASS_WORDS ** levels, 2), dtype=np.int64)
    for w, c in list(zip(words, counts))[lm.CLASSES * lm.CLASS_WORDS:]:
        tail[lm.leaf_of(lm.tail_code(w), levels)] += (1, c)
    lex = lm.Lexicon(words, counts, tail, sum(counts), len(words))
    assert levels == lex.levels == 1
    outer, inner = (rng.normal(size=s).astype(np.float32) for s in lm._shapes(lex.buckets))
    feature = np.array([[3], [77], [512], [8000]])

    def log_path(number, code):
        log_p = (lm.softmax_log(lm.summed(outer, feature) + lex.bias)[0])[lex.group(number, code)].astype(float)
        for at, node, child in lex.choices(number, code):
            z = lm.softmax_log(lm.summed(inner, lex.rows_inside(feature.repeat(len(at), 1), node)) + lex.inner_bias[node])
            log_p[at] += z[np.arange(len(at)), child]
        return log_p

    number = np.arange(len(words))
    total = (np.exp(log_path(number, lex.codes[:-1])) * 10 ** lex.log_inside(number, lex.codes[:-1])).sum()
    code = np.array([(part << 5) * lm.TAIL + t for t in range(lm.TAIL) for part in range(lm.CLASS_WORDS)])
    outside = np.full(len(code), -1)  # a word never seen, once in every leaf
    total += (np.exp(log_path(outside, code)) * 10 ** lex.log_inside(outside, code)).sum()
    assert abs(total - 1) < 1e-4


def test_model_follows_the_vocabulary(spark):
    from pyspark.sql import functions as F
    assert [lm.depth(v) for v in (0, 16 * 1024, 16 * 1024 + 1, 1024 * 1024 + 1, 10 ** 12)] == [0, 0, 1, 2, lm.LEVELS]
    assert [lm.buckets(v) for v in (0, 1_000_000, 100_000_000, 10 ** 12)] == [1 << 13, 48_000, 480_000, lm.MOST_BUCKETS]
    assert [lm.trainers(b, 32_000) for b in (0, 10 ** 8, 10 ** 12, 10 ** 15)] == [1, 12, lm.TRAINERS, lm.TRAINERS]
    words = ["a", "abcde", "été", "日本語", "\n", "x" * 50]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", lm.leaf_column(F.col("w"), 2).alias("t")).collect()
    assert all(r.t == lm.leaf_of(lm.tail_code(r.w.encode()), 2) for r in rows)


def test_every_position_is_learned(documents, monkeypatch):
    learned, train_round = [], lm.train_round

    def kept(rows, lexicon, *more):
        learned.append((lexicon.value[0], train_round(rows, lexicon, *more)))
        return learned[-1][1]

    monkeypatch.setattr(lm, "train_round", kept)
    texts = [f"a{k} b{k} c{k}" for k in range(30)]
    lm.lm_scores(documents(texts)).collect()
    (lexicon, (outer, _)), = learned
    lex = lm.Lexicon(*lexicon)
    own = [t.encode() for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    features = lex.stream(pa.array(own, pa.binary()).cast(pa.string()))[-2]
    assert features.shape == (3, 4 * len(own)) and outer[features].any(axis=2).all()


def test_gradient_rows_are_summed_whole():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.zipf(1.3, size=5000) % 700)
    places, values = rng.integers(0, 900, len(keys)), rng.normal(size=(900, 64))
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    order, size, sums = lm.row_sums(values, places, start)
    assert size.max() > 4 * lm.LONG_RUN and size.sum() == len(keys)
    for k, n, own in zip(order, size, sums):
        assert np.allclose(own, values[places[start[k]:start[k] + n]].sum(axis=0))


def test_words_split_as_bytes_do():
    texts = ["", " ", None, "A\tb\x0bC\x0c d\r\n e ", "ÉTÉ  x y \x1cz", "x" * 5000, " \x85q"]
    words, sizes = lm.words_of(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert lm.as_bytes(words) == [w for own in want for w in own] and sizes.tolist() == [len(own) for own in want]
    assert [len(x) for x in lm.words_of(pa.array([], pa.string()))] == [0, 0]


def _plain_lexicon():
    rng = random.Random(4)
    words = [lm.END] + [f"k{i}".encode() for i in range(3000)]
    counts = sorted((rng.randint(1, 900) for _ in words), reverse=True)
    tail = np.zeros((lm.TAIL, 2), dtype=np.int64)
    for w, c in list(zip(words, counts))[lm.CLASSES * lm.CLASS_WORDS:]:
        tail[lm.ending(w)] += (1, c)
    return lm.Lexicon(words, counts, tail, sum(counts), len(words))


def test_results_do_not_depend_on_the_blocks_worked_on_at_once(monkeypatch):
    rng, lex = random.Random(6), _plain_lexicon()
    text = pa.array([" ".join(f"k{min(rng.randint(0, 4000), rng.randint(0, 4000))}" for _ in range(rng.randint(0, 200))) for _ in range(40)])
    number, code, _, features, _ = lex.stream(text)
    found = []
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(lm, "ROWS", size)
        monkeypatch.setattr(lm, "STEP", size)
        trainer = lm.Trainer(lex)
        for _ in range(2):
            trainer.learn(number, code, features)
        found.append((*trainer.weights, *trainer.touched, lm.path_log(lex, *trainer.weights, number, code, features)))
    assert found[0][0].any() and found[0][1].any() and (found[0][-1] < 0).all()
    for own in found[1:]:
        assert all(np.allclose(a, b, rtol=1e-4, atol=1e-4) for a, b in zip(found[0], own))


def test_stream_looks_words_up_once_and_keeps_every_token():
    lex = _plain_lexicon()
    asked, table = [], lex.table

    class Counted(dict):
        def get(self, word, default=None):
            asked.append(word)
            return super().get(word, default)

    lex.table = Counted(table)
    texts = ["K1 new k2 new", None, "", "k2999 k1 k1 other"] * 3
    number, code, document, features, (at, rare) = lex.stream(pa.array(texts))
    words = [[w.encode() for w in (t or "").lower().split()] + [lm.END] for t in texts]
    flat = [w for ws in words for w in ws]
    assert len(asked) == len(set(asked)) == len(set(flat))
    assert number.tolist() == [table.get(w, -1) for w in flat] and code.tolist() == [lm.tail_code(w) for w in flat]
    assert document.tolist() == [k for k, ws in enumerate(words) for _ in ws]
    assert list(zip(at.tolist(), rare.to_pylist())) == [(k, w.decode()) for k, ws in enumerate(words) for w in ws if w not in table]
    none = lm.TAIL << 32
    for d in (1, 2):
        back = [lm.tail_code(ws[k - d]) if k >= d else none for ws in words for k in range(len(ws))]
        assert features[d - 1].tolist() == (lm.mixed(np.array(back), d) * lex.buckets >> 32).tolist()
    assert lex.stream(pa.array(texts), outside=False)[-1] is None


def test_word_counts_are_whole_however_often_they_are_sent(spark, monkeypatch):
    class Rows:  # runs the task's function here, so that the counter can be small
        def mapInArrow(self, run, schema):
            texts = [["a b b", None, "C a"], ["", "d e f g h"], ["a"] * 5, ["b é c"]]
            self.sent = list(run(iter(pa.record_batch([pa.array(t, pa.string())], ["text"]) for t in texts)))
            return self

        groupBy = agg = lambda self, *_: self

    for counter in (0, 3, 1000):
        monkeypatch.setattr(lm, "COUNTER", counter)
        found = Counter()
        for b in lm.word_counts(Rows()).sent:
            found.update(dict(zip(b["word"].to_pylist(), b["c"].to_pylist())))
        assert found == Counter({"a": 7, "b": 3, "c": 2, "d": 1, "e": 1, "f": 1, "g": 1, "h": 1, "é": 1, "\n": 11})


def test_rows_are_put_whole():
    weights, values = np.zeros((9, 5), dtype=np.float32), np.arange(15, dtype=np.float32).reshape(3, 5)
    lm.put_rows(weights, np.array([7, 0, 4]), values)
    assert np.array_equal(weights[[7, 0, 4]], values) and not weights[[1, 2, 3, 5, 6, 8]].any()


def test_descent_steps_once_on_every_row_of_weights():
    rng, lex = np.random.default_rng(8), _plain_lexicon()
    trainer = lm.Trainer(lex)
    rows = np.where(rng.random((3, 300)) < 0.2, 5, rng.integers(6, 3000, (3, 300)))  # one touched often, many once
    wrong = rng.normal(size=(300, lm.CLASS_WORDS)).astype(np.float32)
    before = [w.copy() for w in trainer.weights]
    trainer._descend(1, rows, wrong, np.einsum("ij,ij->i", wrong, wrong))
    counts = np.bincount(rows.ravel(), minlength=len(before[1]))
    assert (counts == 1).any() and (counts > lm.LONG_RUN).any() and np.array_equal(trainer.touched[1], counts)
    for row in np.flatnonzero(counts):
        grad = wrong[np.nonzero(rows == row)[1]].sum(axis=0, dtype=float)
        step = lm.RATE / np.sqrt(lm.START + (grad ** 2).sum() / lm.SPREAD) * grad
        assert np.allclose(trainer.weights[1][row], -step, rtol=1e-3, atol=1e-4)
    assert not trainer.weights[1][counts == 0].any()
