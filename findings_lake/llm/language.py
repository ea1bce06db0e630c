"""Language identification by character language models.

Every learned language has an interpolated Kneser-Ney model of characters.
Texts are NFC-normalised and lower-cased; words (runs of letters) are
predicted letter by letter, with an end mark, from up to ``order - 1``
letters of the same word. Counts of the highest order are plain counts, those
below count the different letters in front; every order takes one discount
off and hands it to the next lower one, down to equal chances of all
characters. All models lie together in sorted hash arrays: per order the
hashes of its n-grams with one column of log-probabilities per language, and
the hashes of its contexts with the weight of the lower order. A text's
cross-entropy is its log-probability divided by the number of characters
predicted; the language of the lowest is chosen (ties: the smaller name).

Fit: at most ``fit_rows`` labelled documents, an equal number per language
where there are enough, chosen by hash (documented sample; a language with
fewer documents gives all). One in five of them only calibrates: the
temperature that turns differences of cross-entropy into the probability
``score`` of the chosen language, and per language the cross-entropy beyond
which a text is ``rejected`` as none of the learned languages. At most
``max_languages`` labels (the most frequent) are learned, and at most
``max_cells`` (n-gram, language) cells kept, the rarest n-grams left out.
Every document is scored, over its whole text, where it is read.

Null or empty texts and texts without a letter give ``und``, score 0, null
cross-entropy, not rejected; so does everything if nothing can be learned. A
null id is neither held out nor special; repeated rows are scored row by row;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, prepare, stash

ORDER = 4
FIT_ROWS = 20_000
MAX_LANGUAGES = 1000
MAX_CELLS = 1 << 26
#: Words a worker remembers, and characters predicted at once.
CACHE = 400_000
AT_ONCE = 1 << 18
UNKNOWN = "und"
#: Share of rightly chosen calibration texts of a language that are rejected.
REJECTED_SHARE = 0.001
PAD, END = "\x02", "\x03"
#: Distinct n-grams a counting task keeps.
KEPT = 500_000


def words_of(text: bytes):
    """Lower-cased runs of letters, piece by piece."""
    import re

    runs = re.compile(r"[^\W\d_]+")
    for piece in pieces_of(text):
        shown = piece.decode("utf-8", "replace")
        if not shown.isascii():
            shown = unicodedata.normalize("NFC", shown)
        yield runs.findall(shown.lower())


def _is_word(run: str) -> bool:
    """Numbers such as roman numerals are no letters."""
    return run.isalpha() or any(c.isalpha() for c in run)


def _binary(column):
    import pyarrow as pa

    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())


def _gram_counter(order: int):
    """Task body: ``lang, text`` -> partial counts of n-grams."""

    def run(batches):
        from collections import Counter, defaultdict

        import pyarrow as pa

        def flush(grams):
            keys = list(grams)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                               pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

        grams = {}
        for b in batches:
            words = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), _binary(b.column(1)).to_pylist()):
                for runs in words_of(text or b""):
                    words[lang].update(runs)
            for lang, counts in words.items():
                for word, n in counts.items():
                    if _is_word(word):
                        shown = PAD * (order - 1) + word + END
                        for k in range(len(word) + 1):
                            key = (lang, shown[k:k + order])
                            grams[key] = grams.get(key, 0) + n
                        if len(grams) > KEPT:
                            yield flush(grams)
                            grams = {}
        if grams:
            yield flush(grams)

    return run


def _mix(h, symbols):
    """One step of the n-gram hash (arrays of 64 bits)."""
    import numpy as np

    h = (h ^ symbols.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _hashes(codes):
    """Hash of every row of code points, and of the row without its last."""
    import numpy as np

    h = before = np.full(len(codes), 7, dtype=np.uint64)
    for k in range(codes.shape[1]):
        before, h = h, _mix(h, codes[:, k])
    return h, before


class Models:
    """The models of all languages in sorted hash arrays."""

    def __init__(self, langs: list[str], grams: list[str], gram_langs: list[str], counts, order: int):
        import numpy as np

        self.langs, self.order = langs, order
        column = {lang: k for k, lang in enumerate(langs)}
        codes = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(len(grams), order)
        _, first, at = np.unique(_hashes(codes)[0], return_index=True, return_inverse=True)
        count = np.zeros((len(first), len(langs)))
        np.add.at(count, (at, [column[lang] for lang in gram_langs]), counts)
        codes = codes[first]
        levels = [(codes, count, None)]
        for _ in range(order - 1):  # how many different letters stand in front
            _, first, at = np.unique(_hashes(codes[:, 1:])[0], return_index=True, return_inverse=True)
            fronts = np.zeros((len(first), len(langs)))
            np.add.at(fronts, at, (count > 0).astype(float))
            levels[-1] = (*levels[-1][:2], at)
            codes, count = codes[first, 1:], fronts
            levels.append((codes, count, None))
        self.least = float(-np.log(len(codes) + 1))  # one more character for all unseen ones
        lower = np.full((1, len(langs)), 1 / (len(codes) + 1))
        self.tables = []
        for codes, count, at in reversed(levels):
            whole, before = _hashes(codes)
            contexts, inside = np.unique(before, return_inverse=True)
            total, types = np.zeros((2, len(contexts), len(langs)))
            np.add.at(total, inside, count)
            np.add.at(types, inside, (count > 0).astype(float))
            once, twice = (count == 1).sum(axis=0), (count == 2).sum(axis=0)
            discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
            seen = np.maximum(total, 1)
            weight = np.where(total > 0, discount * types / seen, 1.0)
            chance = np.maximum(count - discount, 0) / seen[inside] + weight[inside] * (lower if at is None else lower[at])
            order_of = np.argsort(whole)
            self.tables.append((whole[order_of], np.log(chance[order_of]).astype(np.float32), contexts, np.log(weight).astype(np.float32)))
            lower = chance

    def log_probability(self, words: list[str]):
        """Sums of natural log-probabilities (a row per word, a column per
        language) and the characters predicted."""
        import numpy as np

        pad = PAD * (self.order - 1)
        sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
        codes = np.frombuffer((pad + (END + pad).join(words) + END).encode("utf-32-le"), "<u4")
        stops = np.cumsum(sizes + len(pad))
        at = np.arange(int(sizes.sum())) + np.repeat((np.arange(len(words)) + 1) * len(pad), sizes)
        out = np.zeros((len(words), len(self.langs)))
        word = np.repeat(np.arange(len(words)), sizes)
        assert len(codes) == (stops[-1] if len(words) else len(pad) + 1)
        for lo in range(0, len(at), AT_ONCE):
            rows = self._positions(codes, at[lo:lo + AT_ONCE])
            own = word[lo:lo + AT_ONCE]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[own[first]] += np.add.reduceat(rows, first, axis=0)
        return out, sizes

    def _positions(self, codes, at):
        import numpy as np

        out = np.zeros((len(at), len(self.langs)))
        left = np.arange(len(at))
        for k in range(self.order, 0, -1):
            whole, chance, contexts, weight = self.tables[k - 1]
            h, before = _hashes(codes[at[left][:, None] + np.arange(1 - k, 1)])
            row = np.minimum(np.searchsorted(whole, h), len(whole) - 1)
            hit = whole[row] == h
            out[left[hit]] += chance[row[hit]]
            left, before = left[~hit], before[~hit]
            if not len(left):
                return out
            row = np.minimum(np.searchsorted(contexts, before), len(contexts) - 1)
            known = contexts[row] == before
            out[left[known]] += weight[row[known]]
        out[left] += self.least
        return out


class Scorer:
    """Sums of log-probabilities of texts, words remembered by a worker."""

    def __init__(self, models: Models):
        import numpy as np

        self.models = models
        self.place: dict[str, int] = {}
        self.sums = np.zeros((0, len(models.langs)))
        self.sizes = np.zeros(0, dtype=np.int64)

    def learn(self, runs: set[str]) -> None:
        import numpy as np

        fresh = sorted(runs.difference(self.place))
        if len(fresh) + len(self.place) > CACHE:
            self.place.clear()
            fresh = sorted(runs)
        if not fresh:
            return
        lo = len(self.place)
        hi = lo + len(fresh)
        if hi > len(self.sums):  # room for twice as many
            room = 2 * hi - len(self.sums)
            self.sums = np.concatenate([self.sums, np.zeros((room, self.sums.shape[1]))])
            self.sizes = np.concatenate([self.sizes, np.zeros(room, dtype=np.int64)])
        self.sums[lo:hi], self.sizes[lo:hi] = 0, 0
        real = np.array([_is_word(w) for w in fresh])
        if real.any():
            self.sums[lo:hi][real], self.sizes[lo:hi][real] = self.models.log_probability([w for w, r in zip(fresh, real) if r])
        self.place.update(zip(fresh, range(lo, hi)))

    def texts(self, texts: list[bytes]):
        """Sums of log-probabilities by language, and characters predicted, of every text."""
        import numpy as np

        sums, sizes = np.zeros((len(texts), len(self.models.langs))), np.zeros(len(texts), dtype=np.int64)
        held, owners = [], []

        def settle():
            if held:
                self.learn(set(held))
                at = np.fromiter(map(self.place.__getitem__, held), dtype=np.int64, count=len(held))
                stops = np.cumsum([n for _, n in owners])
                starts = np.append(0, stops[:-1])
                own = [k for k, _ in owners]
                np.add.at(sums, own, np.add.reduceat(self.sums[at], starts, axis=0))
                np.add.at(sizes, own, np.add.reduceat(self.sizes[at], starts))
                held.clear()
                owners.clear()

        for k, text in enumerate(texts):
            for runs in words_of(text or b""):
                if runs:
                    held.extend(runs)
                    owners.append((k, len(runs)))
                if len(held) > AT_ONCE:
                    settle()
        settle()
        return sums, sizes


class Calibration:
    """How sure a choice is, and which texts are of no learned language."""

    def __init__(self, langs: int, right, sizes, entropies):
        """``right``: column of the true language; ``entropies``: a row per text."""
        import numpy as np

        self.power, self.slope = 0.5, 10.0
        self.mean, self.limit = np.zeros(langs), np.full(langs, np.inf)
        if not len(right):
            return
        best = np.inf
        for power in (0.0, 0.25, 0.5, 0.75, 1.0):
            for slope in 2.0 ** np.arange(-4, 9):
                chance = self._chances(entropies, sizes, power, slope)[np.arange(len(right)), right]
                loss = -np.log(np.maximum(chance, 1e-12)).mean()
                if loss < best - 1e-9:
                    best, self.power, self.slope = loss, power, slope
        for k in range(langs):
            mine = (right == k) & (entropies.argmin(axis=1) == k)
            if mine.any():
                own = entropies[mine, k]
                self.mean[k] = own.mean()
                spread = (own - self.mean[k]) * np.sqrt(sizes[mine])
                # few texts say little about the tail: never within four standard deviations
                self.limit[k] = max(np.quantile(spread, 1 - REJECTED_SHARE), 4 * spread.std())

    @staticmethod
    def _chances(entropies, sizes, power, slope):
        import numpy as np

        odds = -slope * np.asarray(sizes, dtype=float)[:, None] ** power * (entropies - entropies.min(axis=1)[:, None])
        e = np.exp(np.maximum(odds, -700.0))
        return e / e.sum(axis=1)[:, None]

    def judge(self, sizes, entropies):
        """Chosen column, score and rejection of every text."""
        import numpy as np

        best = entropies.argmin(axis=1)
        score = self._chances(entropies, sizes, self.power, self.slope)[np.arange(len(best)), best]
        lowest = entropies[np.arange(len(best)), best]
        return best, score, (lowest - self.mean[best]) * np.sqrt(sizes) > self.limit[best]


def _entropies(batches, models: Models, column: int):
    """Batches with characters predicted and cross-entropies of their texts."""
    import numpy as np

    scorer = Scorer(models)
    for b in batches:
        sums, sizes = scorer.texts(_binary(b.column(column)).to_pylist())
        yield b, sizes, -sums / np.maximum(sizes, 1)[:, None]


def learn(rows: DataFrame, order: int = ORDER, fit_rows: int = FIT_ROWS, max_languages: int = MAX_LANGUAGES,
          max_cells: int = MAX_CELLS) -> tuple[Models, Calibration] | None:
    """Models and calibration of labelled rows ``id, text, lang``."""
    import numpy as np

    spark = rows.sparkSession
    rows = rows.where("lang is not null and text is not null")
    top = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not top:
        return None
    each = max(1, fit_rows // len(top))
    shares = spark.createDataFrame([(r.lang, int(min(1.0, each / r.n) * (1 << 30))) for r in top], "lang string, share long")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < F.col("share"))
    chosen = stash(chosen.select("lang", "text", (F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(5)) == 0).alias("later")), "labelled")
    grams = stash(chosen.where("not later").select("lang", "text").mapInArrow(_gram_counter(order), "lang string, gram string, n long")
                  .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    most = max_cells // (len(top) * order)
    if grams.count() > most:
        grams = grams.orderBy(F.desc("n"), "lang", "gram").limit(most)
    counts = grams.toArrow()
    if not counts.num_rows:
        return None
    langs = sorted(set(counts["lang"].to_pylist()))
    models = Models(langs, counts["gram"].to_pylist(), counts["lang"].to_pylist(), counts["n"].to_numpy(), order)
    shared = spark.sparkContext.broadcast(models)

    def measure(batches):
        import pyarrow as pa

        for b, sizes, entropies in _entropies(batches, shared.value, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(entropies.tolist(), pa.list_(pa.float64()))], ["lang", "n", "e"])

    later = chosen.where("later").where(F.col("lang").isin(langs) if len(langs) < 100 else F.lit(True))
    seen = later.select("lang", "text").mapInArrow(measure, "lang string, n long, e array<double>").where("n > 0").collect()
    place = {lang: k for k, lang in enumerate(langs)}
    seen = sorted((r for r in seen if r.lang in place), key=lambda r: (r.lang, r.n, r.e))
    shared.destroy()
    return models, Calibration(len(langs), np.array([place[r.lang] for r in seen], dtype=np.int64),
                               np.array([r.n for r in seen], dtype=np.int64), np.array([r.e for r in seen]).reshape(len(seen), len(langs)))


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit) -> DataFrame:
    """One row per input row: ``id_col, held_out, lang_pred, score,
    cross_entropy`` (bits a character) and ``rejected``. Rows where
    ``held_out`` holds are never learned from."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    fitted = learn(rows.where("not held_out").select("id", "text", "lang"), **fit)
    shared = spark.sparkContext.broadcast(fitted)

    def judge(batches):
        import numpy as np
        import pyarrow as pa

        if shared.value is None:
            for b in batches:
                m = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([UNKNOWN] * m, pa.string()), pa.array([0.0] * m),
                                                  pa.nulls(m, pa.float64()), pa.array([False] * m)], names)
            return
        models, calibration = shared.value
        for b, sizes, entropies in _entropies(batches, models, 2):
            best, score, rejected = calibration.judge(sizes, entropies)
            real = sizes > 0
            lowest = entropies[np.arange(len(best)), best] / np.log(2)
            pred = [models.langs[k] if r else UNKNOWN for k, r in zip(best, real)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(np.where(real, score, 0.0)),
                pa.array(lowest, mask=~real), pa.array(rejected & real)], names)

    names = ["id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "held_out", "text").mapInArrow(
        judge, f"id {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean").withColumnRenamed("id", id_col)
