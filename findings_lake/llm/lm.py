"""Language-model scores: a hashed maximum-entropy model with class-factored
softmax.

P(word | context) is a product of choices down a tree of words, each a softmax
over hashed features of the two words before: n-grams (one and two words
back to back) and a skip (the second word alone). Every word, also
one outside every table, is a context of its own by its hash. The
``CLASSES * CLASS_WORDS`` most frequent tokens lie in classes by frequency, two
choices deep. All other words lie in ``TAIL`` classes by their ending, each
split by the word's hash into ``CLASS_WORDS`` parts, level by level (``LEVELS``
at most), until a leaf holds about ``LEAF`` of the counted words or fewer; inside a leaf the last
factor is the add-one unigram of the whole corpus, with one share for words
that were never seen, so probabilities sum to one. The tree's depth and the
number of feature buckets follow the counted vocabulary up to bounds that keep
a worker's memory bounded (``LEVELS``, ``MOST_BUCKETS``).

Corpus counts are exact, over every training token. Training is distributed
gradient descent: each task walks its own training documents in minibatches
(AdaGrad, every position of every document) from the given weights, zeros at first;
the rows that it changed are then averaged by how often tasks touched them. A task
ships at most one model, so the number of tasks is chosen to keep all of it
below ``SHARE`` of the text. Scoring runs in sparse numpy batches; counts of words outside a
table of frequent words, bounded in words and bytes, come by an equi-join on the word. A word of any length
enters the table by its count alone, so no word outside it is hot.

Texts are whole; a null text is empty (its end token alone is scored); a null
id counts as empty text for the held-out rule; repeated rows are scored and
counted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import repeat
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stash

CLASSES, CLASS_WORDS, TAIL = 16, 64, 16
#: Class sizes are powers of two, so that inner loops may shift and mask.
WORD_BITS, TAIL_BITS = (CLASS_WORDS - 1).bit_length(), (TAIL - 1).bit_length()
#: Counted words that a leaf of the tail may hold before the tree gets a level more, and most levels.
LEAF, LEVELS = 1024, 2
#: Feature buckets (rows of weights) of either table: at least, for each root of a counted word, at most.
BUCKETS, ROOT_BUCKETS, MOST_BUCKETS = 1 << 13, 48, 1 << 19
#: Words in the broadcast table of counts, and their bytes together.
TABLE_WORDS, TABLE_BYTES = 1 << 18, 16 << 20
#: A task adds its word counts up when it holds twice so many, and sends them if more words than this are left.
COUNTER = 400_000
MINIBATCH, RATE, START = 16384, 0.5, 0.5
#: Times that a minibatch touches a row before the rest of its gradient is summed by itself.
LONG_RUN = 32
#: Squares of a row's gradient count by this part in its step size.
SPREAD = 64.0
#: Logits end here, far above any that training reaches, so that ``exp`` stays finite.
HIGHEST = 80.0
#: Training tasks at most, and the share of the training text that their changed rows may take on the network.
TRAINERS, SHARE = 4096, 0.75
#: Weight rows in one block on their way to the average.
BLOCK = 256
#: Tokens that one scoring step looks at, and rows that training works on at once.
STEP, ROWS = 1 << 12, 1 << 12
#: The end of a text, a word that no text can hold.
END = b"\n"


def held_out(id_col: str):
    """Whether a row is held out: crc32 of its id as text leaves 2 modulo 7."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def depth(distinct: int) -> int:
    """Levels of choices below a tail class, for so many counted words."""
    levels = 0
    while levels < LEVELS and TAIL * CLASS_WORDS ** levels * LEAF < distinct:
        levels += 1
    return levels


def buckets(distinct: int) -> int:
    """Rows of weights for so many counted words."""
    import math

    return min(MOST_BUCKETS, max(BUCKETS, math.ceil(ROOT_BUCKETS * math.sqrt(distinct))))


def trainers(text_bytes: int, rows: int) -> int:
    """Training tasks: as many as may send a whole model of so many rows each."""
    return max(1, min(TRAINERS, int(SHARE * text_bytes / (2 * sum(rows * width for _, width in _shapes(rows))))))


def mixed(x, y):
    """A hash of integer arrays, below 2^32."""
    import numpy as np

    z = np.asarray(x).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z ^= np.asarray(y).astype(np.uint64)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z >>= np.uint64(32)
    return z.view(np.int64)


def mixed_small(x, y):
    """A hash of integer arrays below 2^31, below 2^31 (half the width of ``mixed``, for the inner loops)."""
    import numpy as np

    z = np.asarray(x).astype(np.uint32) * np.uint32(0x9E3779B1) ^ np.asarray(y).astype(np.uint32) * np.uint32(0x85EBCA6B)
    z = (z ^ (z >> np.uint32(15))) * np.uint32(0xC2B2AE35)
    return (z >> np.uint32(1)).astype(np.int64)


def ending(word: bytes) -> int:
    """The tail class of a word (``ending_column`` in SQL)."""
    return crc32(word[-4:]) % TAIL


def ending_column(word):
    raw = word.cast("binary")
    return (F.crc32(F.when(F.octet_length(word) > 4, F.substring(raw, -4, 4)).otherwise(raw)) % TAIL).cast("int")


def tail_code(word: bytes) -> int:
    """The word's hash and tail class in one number."""
    return crc32(word) * TAIL + crc32(word[-4:]) % TAIL


def leaf_of(code, levels: int):
    """The leaf of words (``leaf_column`` in SQL) below all tail classes, from their ``tail_code``."""
    parts = CLASS_WORDS ** levels
    return (code & TAIL - 1) * parts + (code >> TAIL_BITS + 5 & parts - 1)


def leaf_column(word, levels: int):
    parts = CLASS_WORDS ** levels
    own = F.shiftright(F.crc32(word.cast("binary")), 5) % parts
    return (ending_column(word).cast("long") * parts + own).cast("int")


def as_bytes(words) -> list[bytes]:
    """Values of an Arrow string array without nulls (as objects at once, several times faster than one by one)."""
    import pyarrow as pa

    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def words_of(column):
    """Lower-cased words of an Arrow string column, one after another, and the number of words of each text."""
    import numpy as np
    import pyarrow.compute as pc

    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    lists = pc.ascii_split_whitespace(texts)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    return words.filter(pc.greater(pc.binary_length(words), 0)), np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, sizes)


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, c`` over all rows (``text``); the end token counts once a row."""

    def run(batches):
        import pyarrow as pa

        def merged(parts):
            whole = pa.Table.from_batches(parts).group_by("word", use_threads=False).aggregate([("c", "sum")])
            return whole.select(["word", "c_sum"]).rename_columns(["word", "c"]).combine_chunks().to_batches()

        parts, held = [], 0
        for b in batches:
            found = words_of(b.column(0))[0].value_counts()
            values, counts = found.field("values"), found.field("counts")
            parts.append(pa.RecordBatch.from_arrays(
                [pa.concat_arrays([values, pa.array([END.decode()], values.type)]),
                 pa.concat_arrays([counts, pa.array([b.num_rows], counts.type)])], ["word", "c"]))
            held += parts[-1].num_rows
            if held > 2 * COUNTER:
                parts = merged(parts)
                held = sum(p.num_rows for p in parts)
                if held > COUNTER:
                    yield from parts
                    parts, held = [], 0
        if parts:
            yield from merged(parts)

    return rows.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def tail_codes(words: list[bytes]):
    """``tail_code`` of each word."""
    import numpy as np

    whole = np.fromiter(map(crc32, words), dtype=np.int64, count=len(words))
    end = np.fromiter(map(crc32, [w[-4:] for w in words]), dtype=np.int64, count=len(words))
    return whole * TAIL + end % TAIL


class Lexicon:
    """What tasks know of words: numbers, counts, classes. ``words`` in order
    of frequency, ``tail`` the number of words and tokens of each leaf below the tail classes,
    ``codes`` the ``tail_code`` of each word where it is known."""

    def __init__(self, words: list[bytes], counts: list[int], tail, total: int, distinct: int, codes=None):
        import numpy as np

        self.table = {w: k for k, w in enumerate(words)}
        self.total, self.distinct, self.buckets = total, distinct, buckets(distinct)
        self.named = named = min(len(words), CLASSES * CLASS_WORDS)
        self.codes = np.r_[tail_codes(words) if codes is None else codes, 0]
        # One entry for each table word and one for all others.
        self.log_c = np.r_[np.log10(np.array(counts, dtype=float) + 1), 0]
        mass = np.asarray(tail, dtype=float).sum(axis=1) + 1
        self.log_tail = np.r_[np.zeros(CLASSES), np.log10(mass)]
        self.levels, level = 0, mass.reshape(TAIL, -1)
        head = np.zeros(CLASSES * CLASS_WORDS)
        head[:named] = np.array(counts[:named], dtype=float) + 1
        head = head.reshape(CLASSES, CLASS_WORDS)
        nodes = []
        while level.shape[1] >= CLASS_WORDS:  # from the leaves up
            level = level.reshape(TAIL, -1, CLASS_WORDS)
            nodes.append(level.reshape(-1, CLASS_WORDS))
            level = level.sum(axis=2)
            self.levels += 1
        with np.errstate(divide="ignore"):
            prior = np.r_[head.sum(axis=1), level[:, 0]]
            self.bias = np.log(np.maximum(prior, 1e-6) / prior.sum()).astype(np.float32)
            self.bias[:CLASSES][head.sum(axis=1) == 0] = -np.inf
            self.inner_bias = np.concatenate([np.log(v / np.maximum(v.sum(axis=1, keepdims=True), 1e-9)).astype(np.float32)
                                              for v in (head, *reversed(nodes))])

    @classmethod
    def of(cls, held: list):
        """The lexicon of a broadcast ``[arguments, lexicon or None]``, built once in a worker."""
        if held[1] is None:
            held[1] = cls(*held[0])
        return held[1]

    def stream(self, column, outside: bool = True):
        """``(numbers, codes, document, features, rare)`` of all tokens of an Arrow string column, ends
        included: table numbers (-1: outside), ``tail_code``, text numbers, feature buckets (a row for each feature), and
        the tokens outside the table as (document, words), if asked for."""
        import numpy as np
        import pyarrow as pa

        words, sizes = words_of(column)
        coded = words.dictionary_encode()
        distinct = as_bytes(coded.dictionary) + [END]
        # What is known of a word is found once for each distinct word of the column.
        found = np.fromiter(map(self.table.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        codes, lost = self.codes[found], np.flatnonzero(found < 0)
        codes[lost] = tail_codes([distinct[k] for k in lost])
        bucket = lambda x, k: mixed(x, k) * self.buckets >> 32
        ends = np.cumsum(sizes + 1) - 1
        n = len(words) + len(sizes)
        own, word = np.ones(n, dtype=bool), np.full(n, len(distinct) - 1)
        own[ends] = False
        word[own] = coded.indices.to_numpy(zero_copy_only=False)
        number, code = found.take(word), codes.take(word)
        document = np.repeat(np.arange(len(sizes)), sizes + 1)
        rare = None
        if outside:
            at = np.flatnonzero(number < 0)
            rare = (document[at], pa.concat_arrays([coded.dictionary, pa.array([END.decode()], coded.dictionary.type)])
                    .cast(pa.string()).take(pa.array(word[at])))
        none = np.array([TAIL << 32])  # no word's code
        starts = ends - sizes
        early = (starts, np.r_[starts, starts[sizes > 0] + 1])  # tokens with no word so many places before

        def before(d, values, filler, b):
            b[d:] = values[:-d] if n > d else values[:0]
            b[early[d - 1]] = filler
            return b

        features = np.empty((3, n), dtype=np.int64)
        both = mixed(before(1, code, none, features[0]), before(2, code, none, features[1]))
        features[2] = bucket(both, 4)
        for d in (1, 2):
            before(d, bucket(codes, d).take(word), bucket(none, d), features[d - 1])
        return number, code, document, features, rare

    def group(self, number, code):
        """The first choice: classes of frequent words, then tail classes."""
        import numpy as np

        return np.where((number >= 0) & (number < self.named), number >> WORD_BITS, CLASSES + (code & TAIL - 1))

    def choices(self, number, code):
        """The choices after the first, level by level: ``(tokens, nodes, children)``."""
        import numpy as np

        named = (number >= 0) & (number < self.named)
        inside = np.flatnonzero(named)
        own = number[inside]
        yield inside, own >> WORD_BITS, own & CLASS_WORDS - 1
        tail = np.flatnonzero(~named)
        leaf, first = leaf_of(code[tail], self.levels), CLASSES
        for k in range(self.levels):
            below = leaf >> WORD_BITS * (self.levels - 1 - k)
            yield tail, first + (below >> WORD_BITS), below & CLASS_WORDS - 1
            first += TAIL * CLASS_WORDS ** k

    def log_inside(self, number, code):
        """log10 of the last factor as far as the table knows it: the count's share
        in its leaf (the count of a word outside the table comes by a join)."""
        import numpy as np

        named = (number >= 0) & (number < self.named)
        return np.where(named, 0, self.log_c[number] - self.log_tail[CLASSES + leaf_of(code, self.levels)])

    def rows_inside(self, features, node):
        return mixed_small(features, node + 17) * self.buckets >> 31


def softmax_log(z):
    import numpy as np

    z = np.minimum(z, HIGHEST)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def across(z):
    """Sums of the rows of ``z`` (a product with ones, several times faster than ``sum``)."""
    import numpy as np

    return z @ np.ones(z.shape[1], dtype=z.dtype)


def bounded(z):
    """``z`` with no logit above ``HIGHEST``, in place."""
    import numpy as np

    return np.minimum(z, HIGHEST, out=z) if z.max(initial=0) > HIGHEST else z


def goal_log(z, goal):
    """``softmax_log(z)`` at one column of each row; ``z`` is overwritten."""
    import numpy as np

    own = bounded(z).reshape(-1).take(np.arange(0, z.size, z.shape[1]) + goal)
    return own - np.log(across(np.exp(z, out=z)))


def summed(weights, rows, out=None, room=None):
    """Sums of the rows of weights of each token, into ``out`` by way of ``room`` if given. (Every
    row is there: "clip" only saves numpy a copy.)"""
    import numpy as np

    n, width = rows.shape[1], weights.shape[1]
    out = np.empty((n, width), dtype=weights.dtype) if out is None else out
    room = np.empty((n, width), dtype=weights.dtype) if room is None else room[:n]
    weights.take(rows[0], axis=0, out=out, mode="clip")
    for own in rows[1:]:
        out += weights.take(own, axis=0, out=room, mode="clip")
    return out


def by_size(start, n: int):
    """Runs of ``n`` places that begin at ``start``: their order, long ones first, and their sizes in it."""
    import numpy as np

    size = np.diff(np.r_[start, n])
    order = np.argsort((LONG_RUN + 1 - np.minimum(size, LONG_RUN + 1)).astype(np.uint8), kind="stable")
    return order, size[order]


def run_sums(values, places, start, size):
    """Sums of ``values[places]`` over runs of ``places`` (long ones first, as ``by_size`` puts them) that begin
    at ``start``. Runs are added step by step, all at once; what a long run holds beyond ``LONG_RUN`` is
    summed by itself."""
    import numpy as np

    sums = values.take(places[start], axis=0)
    more_than = np.searchsorted(-np.minimum(size, LONG_RUN + 1), -np.arange(LONG_RUN + 1))  # runs of more than so many
    for step, live in enumerate(more_than[1:LONG_RUN].tolist(), 1):
        if not live:
            break
        sums[:live] += values.take(places[start[:live] + step], axis=0)
    for k in range(more_than[LONG_RUN]):
        sums[k] += values.take(places[start[k] + LONG_RUN:start[k] + size[k]], axis=0).sum(axis=0)
    return sums


def put_rows(weights, row, values):
    """``weights[row] = values`` for whole rows (each row copied as one item, which takes numpy half the time)."""
    import numpy as np

    item = np.dtype((np.void, weights.itemsize * weights.shape[1]))
    weights.view(item).reshape(-1).put(row, values.view(item).reshape(-1), mode="clip")


def row_sums(values, places, start):
    """Sums of ``values[places]`` over runs of ``places`` that begin at ``start``, long runs first:
    ``(order of the runs, their sizes, sums)``."""
    order, size = by_size(start, len(places))
    return order, size, run_sums(values, places, start[order], size)


class Trainer:
    """AdaGrad on both factors (one step size for each row of weights), from
    given weights or from zero."""

    def __init__(self, lexicon: Lexicon, weights=None):
        import numpy as np

        self.lexicon = lexicon
        self.weights = ([w.astype(np.float32) for w in weights] if weights else
                        [np.zeros(s, dtype=np.float32) for s in _shapes(lexicon.buckets)])
        self.squares = [np.full(len(w), START, dtype=np.float32) for w in self.weights]
        self.touched = [np.zeros(len(w), dtype=np.int64) for w in self.weights]

    def _descend(self, which: int, rows, wrong, norm):
        """``norm``: the squares of each row of ``wrong`` together, the gradient's of a row of weights touched once."""
        import numpy as np

        shift = rows.shape[1].bit_length()
        tag = np.uint32 if len(self.weights[which]) << shift <= 1 << 32 else np.uint64
        tagged = np.sort((rows.astype(tag) << tag(shift) | np.arange(rows.shape[1], dtype=tag)).ravel())  # by row of weights, then by token
        flat, places = tagged >> tag(shift), (tagged & tag((1 << shift) - 1)).astype(np.int64)
        first = np.ones(len(flat), dtype=bool)
        np.not_equal(flat[1:], flat[:-1], out=first[1:])
        start = np.flatnonzero(first)
        order, size = by_size(start, len(flat))
        start = start.take(order)
        used, weights, squares = flat.take(start).astype(np.int64), self.weights[which], self.squares[which]
        self.touched[which][used] += size
        square = squares.take(used)
        room = np.empty((2, min(ROWS, len(used)), weights.shape[1]), dtype=np.float32)
        several = np.count_nonzero(size > 1)
        for at, end in [(at, min(at + ROWS, stop)) for begin, stop in ((0, several), (several, len(used)))
                        for at in range(begin, stop, ROWS)]:  # blocks of rows stay in the cache
            own, row, old = slice(at, end), used[at:end], room[0, :end - at]
            if at < several:
                grad = run_sums(wrong, places, start[own], size[own])
                more = np.einsum("ij,ij->i", grad, grad)
            else:
                alone = places.take(start[own])
                grad, more = wrong.take(alone, axis=0, out=room[1, :end - at], mode="clip"), norm.take(alone)
            square[own] += more / SPREAD
            grad *= (RATE / np.sqrt(square[own]))[:, None]
            put_rows(weights, row, np.subtract(weights.take(row, axis=0, out=old, mode="clip"), grad, out=grad))
        squares[used] = square

    def learn(self, number, code, features):
        lex = self.lexicon
        self._step(0, features, lex.group(number, code), lex.bias)
        for at, node, child in lex.choices(number, code):
            if len(at):
                self._step(1, lex.rows_inside(features[:, at], node), child, lex.inner_bias, node)

    def _step(self, which: int, rows, goal, bias, node=None):
        import numpy as np

        weights = self.weights[which]
        wrong = np.empty((len(goal), weights.shape[1]), dtype=np.float32)
        room, norm = np.empty((ROWS, weights.shape[1]), dtype=np.float32), np.empty(len(goal), dtype=np.float32)
        for at in range(0, len(goal), ROWS):  # blocks of tokens stay in the cache
            own = slice(at, at + ROWS)
            z = summed(weights, rows[:, own], wrong[own], room)
            z += bias if node is None else bias.take(node[own], axis=0, out=room[:len(z)], mode="clip")
            np.exp(bounded(z), out=z)
            z /= z.sum(axis=1, keepdims=True)
            z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + goal[own]] -= 1
            np.einsum("ij,ij->i", z, z, out=norm[own])
        self._descend(which, rows, wrong, norm)


def _shapes(rows: int = BUCKETS):
    return [(rows, CLASSES + TAIL), (rows, CLASS_WORDS)]


def train_round(rows: DataFrame, lexicon, weights=None, tasks: int = TRAINERS) -> list:
    """New weights after one round over ``text`` in so many tasks at most; the other two arguments
    are broadcasts, without ``weights`` training begins at zero."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        trainer = Trainer(Lexicon.of(lexicon.value), weights.value if weights else None)
        held, size = [], 0
        for b in batches:
            number, code, _, features, _ = trainer.lexicon.stream(b.column(0), outside=False)
            if not len(number):
                continue
            held.append((number, code, features))
            size += len(number)
            if size >= MINIBATCH:
                whole = [np.concatenate(part, axis=-1) for part in zip(*held)]
                full = size - size % MINIBATCH
                for at in range(0, full, MINIBATCH):
                    trainer.learn(*(part[..., at:at + MINIBATCH] for part in whole))
                held, size = [tuple(part[..., full:] for part in whole)], size - full
        if size:
            trainer.learn(*(np.concatenate(part, axis=-1) for part in zip(*held)))
        for which, (w, t) in enumerate(zip(trainer.weights, trainer.touched)):
            changed = np.flatnonzero(t)
            parts = np.split(changed, np.flatnonzero(np.diff(changed // BLOCK)) + 1) if len(changed) else []
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([which * (len(t) // BLOCK + 1) + int(k[0]) // BLOCK for k in parts], pa.int32()),
                     pa.array([(k % BLOCK).astype(np.uint8).tobytes() for k in parts], pa.binary()),
                     pa.array([t[k].astype(np.uint32).tobytes() for k in parts], pa.binary()),
                     pa.array([w[k].astype(np.float16).tobytes() for k in parts], pa.binary())],
                    ["block", "at", "touched", "rows"])

    def average(key, group):
        import pyarrow as pa

        parts = sorted((a.as_py(), t.as_py(), r.as_py()) for a, t, r in zip(group["at"], group["touched"], group["rows"]))
        total, weight = 0.0, np.zeros(BLOCK)
        for a, t, r in parts:  # in an order of their own, so that sums agree
            at, t = np.frombuffer(a, dtype=np.uint8), np.frombuffer(t, dtype=np.uint32).astype(float)
            own = np.frombuffer(r, dtype=np.float16).reshape(len(at), -1)
            total = total + np.zeros((BLOCK, own.shape[1]))
            total[at] += own * t[:, None]
            weight[at] += t
        seen = np.flatnonzero(weight)
        rows = (total[seen] / weight[seen, None]).astype(np.float16)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()),
                         "at": pa.array([seen.astype(np.uint8).tobytes()], pa.binary()),
                         "rows": pa.array([rows.tobytes()], pa.binary())})

    parts = rows.coalesce(tasks).mapInArrow(run, "block int, at binary, touched binary, rows binary")
    shapes = _shapes(buckets(lexicon.value[0][4]))
    new = [w.copy() for w in weights.value] if weights else [np.zeros(s, dtype=np.float16) for s in shapes]
    for r in parts.groupBy("block").applyInArrow(average, "block int, at binary, rows binary").toLocalIterator():
        which, k = divmod(r.block, len(new[0]) // BLOCK + 1)
        at = np.frombuffer(r.at, dtype=np.uint8)
        new[which][k * BLOCK + at.astype(int)] = np.frombuffer(r.rows, dtype=np.float16).reshape(len(at), -1)
    return new


def path_log(lex: Lexicon, outer, inner, number, code, features):
    """The natural logarithm of each token's choices together, ``STEP`` tokens at a time."""
    import numpy as np

    log_p = np.zeros(len(number))
    room = [np.empty((STEP, w.shape[1]), dtype=w.dtype) for w in (outer, outer, inner, inner)]
    for at in range(0, len(number), STEP):
        own = slice(at, at + STEP)
        f, goal = features[:, own], lex.group(number[own], code[own])
        z = summed(outer, f, room[0][:len(goal)], room[1])
        z += lex.bias
        log_p[own] = goal_log(z, goal)
        for k, node, child in lex.choices(number[own], code[own]):
            z = summed(inner, lex.rows_inside(f[:, k], node), room[2][:len(k)], room[3])
            z += lex.inner_bias.take(node, axis=0, out=room[3][:len(k)], mode="clip")
            log_p[at + k] += goal_log(z, child)
    return log_p


def score_rows(rows: DataFrame, lexicon, weights) -> DataFrame:
    """Rows ``id, held_out, text`` -> for each row ``row`` one line with its
    sums (``word`` null) and one line for each token outside the table."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        lex, (outer, inner) = Lexicon.of(lexicon.value), (w.astype(np.float32) for w in weights.value)
        base = TaskContext.get().partitionId() << 33
        for b in batches:
            m = b.num_rows
            number, code, document, features, (rare, words) = lex.stream(b.column(2))
            log_p = path_log(lex, outer, inner, number, code, features) / np.log(10)
            log_c = lex.log_c[number]
            log_p += lex.log_inside(number, code)
            n_tokens = np.bincount(document, minlength=m)
            first = np.cumsum(n_tokens) - n_tokens
            add = lambda w: np.add.reduceat(w, first) if m else w  # every text has its end token
            row = base + np.arange(m)
            base += m
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[row, row[rare]], pa.int64()),
                 pa.concat_arrays([pa.nulls(m, pa.string()), words]),
                 pa.concat_arrays([b.column(0), pa.nulls(len(words), b.column(0).type)]),
                 pa.concat_arrays([b.column(1), pa.nulls(len(words), pa.bool_())]),
                 pa.array(np.r_[n_tokens, np.ones(len(words), dtype=np.int64)], pa.int64()),
                 pa.array(np.r_[add((number >= 0).astype(np.int64)), np.zeros(len(words), dtype=np.int64)], pa.int64()),
                 pa.array(np.r_[add(log_c), np.zeros(len(words))]), pa.array(np.r_[add(log_p), np.zeros(len(words))])],
                ["row", "word", "id", "held_out", "n", "known", "base", "score"])

    return rows.mapInArrow(run, f"row long, word string, id {kind}, held_out boolean, n long, known long, base double, score double")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1,
              table_words: int = TABLE_WORDS) -> DataFrame:
    """One row per input row: ``id_col, held_out, n_tokens, n_known,
    train_tokens, base_score, score`` (log10 probabilities)."""
    import math

    import numpy as np

    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    train = rows.where("not held_out")
    counts = stash(word_counts(train.select("text")), "words")
    size = F.octet_length("word").cast("long") + 1
    total, distinct, size_all = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(size * F.col("c"))).first()
    total = total or 0

    least, room, room_bytes = 0, table_words, TABLE_BYTES
    levels_of_c = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"))
    for r in levels_of_c.orderBy(F.desc("c")).toLocalIterator():
        room, room_bytes = room - r.n, room_bytes - r.b
        if min(room, room_bytes) < 0:
            least = r.c
            break
    frequent = sorted(((r.word.encode(), r.c) for r in counts.where(F.col("c") > least).toLocalIterator()),
                      key=lambda x: (-x[1], x[0]))
    levels = depth(distinct)
    tail = np.zeros((TAIL * CLASS_WORDS ** levels, 2), dtype=np.int64)
    leaves = counts.groupBy(leaf_column(F.col("word"), levels).alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).toArrow()
    tail[leaves["t"].to_numpy()] = np.stack([leaves["n"].to_numpy(), leaves["c"].to_numpy()], axis=1)
    for w, c in frequent[:CLASSES * CLASS_WORDS]:  # the model's own words are no tail words
        tail[leaf_of(tail_code(w), levels)] -= (1, c)
    codes = tail_codes([w for w, _ in frequent])
    lexicon = spark.sparkContext.broadcast([([w for w, _ in frequent], [c for _, c in frequent], tail, total, distinct, codes), None])

    weights = None
    for _ in range(max(rounds, 1)):
        new = train_round(train.select("text"), lexicon, weights, trainers(size_all or 0, buckets(distinct)))
        if weights:
            weights.destroy()
        weights = spark.sparkContext.broadcast(new)

    lines = stash(score_rows(rows, lexicon, weights), "scores")
    lexicon.destroy()
    weights.destroy()
    rare = counts.where(F.col("c") <= least)
    more = (lines.where("word is not null").select("row", "word").join(rare, "word").groupBy("row")
            .agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("log_c")))
    log_c, more_known = F.coalesce("log_c", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return lines.where("word is null").join(more, "row", "left").select(
        F.col("id").alias(id_col), "held_out", F.col("n").alias("n_tokens"), (F.col("known") + more_known).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + log_c - F.col("n") * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("score") + log_c).alias("score"))
