"""Spelling variants of words, by blocked Gram matrices of letter counts.

Words (runs of Latin letters, counted over all texts) are dealt to blocks:
the letters are put into a few groups of equal weight, and a block holds the
words with the same number of letters in every group, hence of one length. One
inserted, deleted or replaced letter moves a word by one step in one group or
by a step up and a step down in two, so only neighbouring blocks have to
meet. Two blocks meet as a matrix product of their letter counts, which
gives the squared distances of all their words; pairs at a distance a single
edit can have (1 between neighbouring lengths, 2 within a length) are
verified letter by letter. Blocks beyond ``CHUNK`` words are cut into chunks,
and a chunk meets its partners one after the other, so no task holds more than
two chunks. A task sends on counts and best partners by word, never pairs.

Null and empty texts have no words; a null document id counts as empty text
where a run is hashed; repeated rows count as often as they occur; ties go to
the smaller word in code-point order; words of any length take part; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, stash

#: Words and letters of a chunk, and distinct words a counting task keeps.
CHUNK = 2048
CHUNK_LETTERS = 4 << 20
KEPT = 300_000
#: Cells of one matrix product.
PRODUCT = 4 << 20
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def spelled(doc_id, run: str, prefix: int, modulus: int) -> str:
    """``run`` of a document as the corpus spells it: where ``modulus``
    divides the hash of id and run, one code point is missing."""
    h = zlib.crc32(run.encode(), prefix)
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counter(least_letters: int, modulus: int):
    """Task body: ``id, text`` rows -> partial counts of words."""

    def run(batches):
        import re
        from collections import Counter

        import pyarrow as pa

        runs = re.compile(f"[a-zÀ-ÿ]{{{least_letters},}}")

        def flush(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        counts = {}
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = b.column(1).cast(pa.binary() if pa.types.is_string(b.column(1).type) else pa.large_binary()).to_pylist()
            for doc_id, text in zip(ids, texts):
                if not text:
                    continue
                prefix = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
                for word, n in Counter(runs.findall(text.translate(LOWER).decode())).items():
                    word = spelled(doc_id, word, prefix, modulus)
                    if len(word) >= least_letters:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > KEPT:
                    yield flush(counts)
                    counts = {}
        if counts:
            yield flush(counts)

    return run


def vocabulary(docs: DataFrame, id_col: str, text_col: str, least_letters: int, least_count: int, modulus: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_counter(least_letters, modulus), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """Letters in ``groups`` strings whose words' letters weigh about the same
    (at most 256 letters exist)."""
    def letters(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(256, dtype=np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer("".join(b.column(0).to_pylist()).encode("latin-1"), np.uint8), minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["letter", "n"])

    found = words.select("word").mapInArrow(letters, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    load, out = [0] * groups, [""] * groups
    for r in sorted(found, key=lambda r: (-r.n, r.letter)):
        k = load.index(min(load))
        out[k] += chr(r.letter)
        load[k] += r.n
    return out


def _block_keys(groups: list[str]):
    """Adds ``block``: the number of letters in every group."""

    def run(batches):
        import pyarrow as pa

        shown = {ord(c): chr(65 + k) for k, g in enumerate(groups) for c in g}
        marks = [chr(65 + k) for k in range(len(groups))]
        for b in batches:
            keys = []
            for word in b.column(0).to_pylist():
                short = word.translate(shown)
                keys.append(",".join([str(short.count(m)) for m in marks]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.string())], ["word", "n", "block"])

    return run


def _lower_blocks(batches):
    """``block`` -> the neighbouring blocks it is sent to: one letter less, or
    one letter moved to a later group (the others send their words here)."""
    import pyarrow as pa

    for b in batches:
        own, other = [], []
        for key in b.column(0).to_pylist():
            at = [int(c) for c in key.split(",")]
            for p in range(len(at)):
                if not at[p]:
                    continue
                less = [*at[:p], at[p] - 1, *at[p + 1:]]
                near = [less] + [[*less[:q], less[q] + 1, *less[q + 1:]] for q in range(p + 1, len(at))]
                own += [key] * len(near)
                other += [",".join(map(str, c)) for c in near]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(other, pa.string())], ["block", "anchor"])


class Block:
    """Words of one length: letters, counts of letters and occurrences."""

    def __init__(self, words: str, ns: str):
        import numpy as np

        self.words = words.split("\n")
        self.n = np.array(ns.split(","), dtype=np.int64)
        self.length = len(self.words[0])
        m = len(self.words)
        self.codes = np.frombuffer("".join(self.words).encode("latin-1"), np.uint8).reshape(m, self.length)
        at = self.codes.astype(np.int64) + (np.arange(m) * 256)[:, None]
        counts = np.bincount(at.ravel(), minlength=m * 256).reshape(m, 256)
        # products of counts stay exact: below 2^24 in single precision
        self.kind = np.float32 if self.length < 2000 else np.float64
        self.counts = counts.astype(self.kind)
        self.square = (self.counts ** 2).sum(axis=1, dtype=self.kind)


def near_pairs(a: Block, b: Block, same: bool):
    """Indices ``i, j`` of the words of ``a`` and ``b`` (``b`` as long or one
    letter longer) that differ by exactly one edit; ``same``: i < j only."""
    import numpy as np

    longer = b.length - a.length
    letters = np.flatnonzero(a.counts.any(axis=0) & b.counts.any(axis=0))
    ones = np.ones(len(b.words), dtype=b.kind)
    right = np.column_stack([b.counts[:, letters], ones, b.square]).T
    step = max(1, PRODUCT // len(b.words))
    out_i, out_j = [], []
    for lo in range(0, len(a.words), step):
        part = a.counts[lo:lo + step, letters]
        left = np.column_stack([-2 * part, a.square[lo:lo + step], np.ones(len(part), dtype=a.kind)])
        i, j = np.nonzero(left @ right == (1 if longer else 2))
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), max(1, PRODUCT // max(b.length, 1))):  # verify letter by letter
            p, q = i[k:k + max(1, PRODUCT // b.length)], j[k:k + max(1, PRODUCT // b.length)]
            if longer:
                head = a.codes[p] == b.codes[q, :-1]
                tail = a.codes[p] == b.codes[q, 1:]
                # letters equal from the front, and from the back behind the extra letter
                front = np.where(head.all(axis=1), a.length, head.argmin(axis=1))
                back = np.where(tail.all(axis=1), a.length, tail[:, ::-1].argmin(axis=1))
                good = front + back >= a.length
            else:
                good = (a.codes[p] != b.codes[q]).sum(axis=1) == 1
            out_i.append(p[good])
            out_j.append(q[good])
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *out_i]), np.concatenate([empty, *out_j])


def _best(own: Block, other: Block, i, j):
    """Rows ``word, n_near, best_n, best`` of the words of ``own``."""
    import numpy as np

    rank = np.argsort(np.argsort(np.array(other.words)))  # numpy compares texts by code point
    order = np.lexsort((rank[j], -other.n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(i)))
    return ([own.words[k] for k in i[first]], counts.tolist(), other.n[j[first]].tolist(), [other.words[k] for k in j[first]])


def _meet(batches):
    """Task body: rows sorted by anchor, the anchor's own chunk first ->
    partial results of all words near each other."""
    import pyarrow as pa

    names = ["word", "n_near", "best_n", "best"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    anchor = key = None
    out = [[] for _ in names]
    for b in batches:
        for block, chunk, own, words, ns in zip(*(b.column(k).to_pylist() for k in range(5))):
            other = Block(words, ns)
            if own:
                anchor, key, i, j = other, (block, chunk), *near_pairs(other, other, True)
            elif key != (block, chunk):  # no word was dealt to that chunk
                continue
            else:
                i, j = near_pairs(anchor, other, False)
            if len(i):
                for rows in (_best(anchor, other, i, j), _best(other, anchor, j, i)):
                    for column, values in zip(out, rows):
                        column += values
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)
                out = [[] for _ in names]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)


def near_words(words: DataFrame, groups: int) -> DataFrame:
    """``word, n_near, best_n, best`` of every word that has near words."""
    keyed = stash(words.select("word", "n").mapInArrow(_block_keys(letter_groups(words, groups)), "word string, n long, block string"), "keyed")
    size = F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(F.lit(CHUNK_LETTERS) / F.first(F.length("word")))))
    blocks = stash(keyed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("chunks")), "blocks")
    dealt = keyed.join(blocks, "block").withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    listed = dealt.groupBy("block", "chunk").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("rows"))
    listed = stash(listed.select("block", "chunk", F.array_join(F.transform("rows", lambda r: r["word"]), "\n").alias("words"),
                                 F.array_join(F.transform("rows", lambda r: r["n"].cast("string")), ",").alias("ns")), "chunks")

    lower = blocks.select("block").mapInArrow(_lower_blocks, "block string, anchor string")
    lower = lower.join(blocks.select(F.col("block").alias("anchor"), "chunks"), "anchor")
    texts = ["words", "ns"]
    own = listed.select("block", "chunk", F.lit(True).alias("own"), *texts)
    # chunks of one block: each is sent to those before it
    fellow = listed.where("chunk > 0").select("block", F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)).alias("to"), *texts).select(
        "block", F.col("to").alias("chunk"), F.lit(False).alias("own"), *texts)
    sent = listed.join(lower, "block").select(
        F.col("anchor").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("own"), *texts)
    met = own.unionByName(fellow).unionByName(sent).repartition("block", "chunk").sortWithinPartitions("block", "chunk", F.desc("own"))
    found = met.mapInArrow(_meet, "word string, n_near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the rows ``word, form``: forms are followed to the
    last, twice as far in every round (occurrences at least double along the
    way, so rounds are few)."""
    state = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stash(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(state)
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        state = new.select("word", "root")
        state.stash_path = new.stash_path


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5,
                      least_count: int = 3, ratio: int = 2, modulus: int = 97, groups: int | None = None) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    ``form`` is the most frequent word one edit away, if it occurs at least
    ``ratio`` times as often; ``groups`` (letter groups of the block keys, by
    default from the logarithm of the vocabulary) changes the speed only."""
    prepare(docs.sparkSession)
    words = stash(vocabulary(docs, id_col, text_col, least_letters, least_count, modulus), "words")
    if groups is None:
        groups = max(2, math.ceil(math.log10(max(words.count(), 10))) - 1)
    near = stash(near_words(words, groups), "near")
    follows = F.col("best_n") >= ratio * F.col("n")
    rows = stash(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("best")).alias("form"),
        F.when(follows, F.col("best_n")).alias("form_n")), "forms")
    last = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
