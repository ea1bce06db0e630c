"""Quality classifier by importance resampling.

Two bags of hashed n-grams are counted: the raw text (every document) and
the target text (documents labelled clean). The ratio of the two generative
models gives each n-gram a log weight; a document's importance is read off
the weights of its n-grams, by family: words, 4- and 5-byte word beginnings,
word pairs, and the marks and case around words. A bounded sample of labelled
rows sets the scale of the families (logistic regression) and the cut; a
labelled document is always weighed by a target model of the other half of
the sample, since a model looks kindly on its own text. Then
``k`` documents are drawn without replacement by Gumbel top-k: log weight
plus Gumbel noise of a small ``temperature`` seeded by the row's content, the
``k`` largest stay. ``k`` is the number of documents on the clean side of the cut.

Counts cover all documents and all of each text. Null and empty texts have no
n-grams and get the weight of an empty text; a null id is never labelled; of
several labels of one id the worst counts; repeated rows have one key and
stay or go together, as do ties at the k-th key; without labels of both kinds
every row stays. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, pieces_of, prepare, stash

FAMILIES = 5
BUCKETS = 1 << 16
#: Labelled rows that the target model and the calibration may use, chosen by hash.
FIT_ROWS = 20_000
#: Added to both counts of an n-gram, and the log weight from which an n-gram counts as alien.
SMOOTHING, ALIEN = 2.0, 0.5
TEMPERATURE = 0.05
#: A clean document lost counts as much as so many others let through (shares of either kind).
CLEAN_WEIGHT = 3
#: Text that one vectorised step looks at.
SLICE = 4 << 20
FEATURES = 2 * FAMILIES + 1


def _slices(texts: list[bytes]):
    """``(document numbers, parts)`` of about SLICE bytes; a longer text is cut at white space."""
    numbers, parts, held = [], [], 0
    for k, text in enumerate(texts):
        *heads, text = pieces_of(text, SLICE)
        for head in heads:
            yield [k], [head]
        numbers.append(k)
        parts.append(text)
        held += len(text)
        if held >= SLICE:
            yield numbers, parts
            numbers, parts, held = [], [], 0
    if parts:
        yield numbers, parts


def ngrams(parts: list[bytes]):
    """Hashed n-grams of texts: ``(part number, bucket)`` arrays for each family."""
    import numpy as np

    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[48:58] = 48
    letter = np.zeros(256, dtype=bool)
    letter[97:123] = letter[65:91] = letter[128:] = True
    mask = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

    def mixed(x):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    raw = np.frombuffer(b"\n".join(parts) + b"\n" + bytes(40), dtype=np.uint8)
    n = len(raw) - 40
    ends = np.cumsum([len(p) + 1 for p in parts])
    is_word = letter[raw]
    is_word[n:] = False
    edge = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=np.int8(0)))
    a, b = edge[::2], edge[1::2]
    part = np.searchsorted(ends, a, side="right")
    size = b - a
    text = fold[raw]
    eight = np.lib.stride_tricks.as_strided(text.view(), shape=(len(text) - 7, 8), strides=(1, 1))
    at = lambda i: eight[i].copy().view("<u8").ravel()
    some = lambda x, k: x & mask[np.clip(k, 0, 8)]
    head = at(a)
    word = mixed(some(head, size) + size.astype(np.uint64))
    long = np.flatnonzero(size > 8)
    tail = mixed(some(at(a[long] + 8), size[long] - 8) + np.uint64(7)) + mixed(some(at(a[long] + 16), size[long] - 16))
    word[long] = mixed(word[long] + tail + at(b[long] - 8))
    gap = np.minimum(np.r_[a[1:], n], ends[part] - 1) - b
    shout = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    case = np.minimum(shout[b] - shout[a], 2).astype(np.uint64)
    marks = mixed(some(at(b), np.minimum(gap, 6)) + (case << np.uint64(56)) + np.uint64(3))
    same = np.flatnonzero(part[1:] == part[:-1])
    pair = mixed(word[same] * np.uint64(3) + word[same + 1])
    families = [(part, word), (part, mixed(some(head, np.minimum(size, 4)) + np.uint64(11))),
                (part, mixed(some(head, np.minimum(size, 5)) + np.uint64(13))), (part, marks), (part[same], pair)]
    return [(p, (h >> np.uint64(48)).astype(np.int64) + k * BUCKETS) for k, (p, h) in enumerate(families)]


def model_counts(rows: DataFrame, known) -> DataFrame:
    """``bucket, raw, first, second``: n-gram counts over all rows (``doc,
    text``) and over the clean ones of either half of the broadcast
    ``known`` (id: half, clean)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts = np.zeros((3, FAMILIES * BUCKETS), dtype=np.int64)
        for batch in batches:
            half = np.array([h if clean else -1 for h, clean in (known.value.get(x, (-1, False)) for x in batch.column(0).to_pylist())],
                            dtype=np.int64)
            for numbers, parts in _slices(byte_list(batch.column(1))):
                own = half[numbers]
                for part, bucket in ngrams(parts):
                    counts[0] += np.bincount(bucket, minlength=counts.shape[1])
                    for k in (0, 1):
                        if (own == k).any():
                            counts[k + 1] += np.bincount(bucket[own[part] == k], minlength=counts.shape[1])
        found = np.flatnonzero(counts[0])
        for i in range(0, len(found), 1 << 15):
            k = found[i:i + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), *(pa.array(c[k]) for c in counts)],
                                             ["bucket", "raw", "first", "second"])

    counts = rows.mapInArrow(run, "bucket int, raw long, first long, second long")
    return counts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "first", "second")])


def log_ratios(raw, target):
    """Log weights of all buckets; each family's models have equal mass."""
    import numpy as np

    out = np.zeros(FAMILIES * BUCKETS, dtype=np.float32)
    for k in range(FAMILIES):
        own = slice(k * BUCKETS, (k + 1) * BUCKETS)
        share = target[own].sum() / max(raw[own].sum(), 1)
        out[own] = np.log((target[own] + SMOOTHING) / (raw[own] * share + SMOOTHING))
    return out


def document_weights(rows: DataFrame, known, weights) -> DataFrame:
    """``id, h, n_words, log_weight, x`` of every row of ``id, h, text, doc``:
    the sum of log weights and the features (mean and alien weight by family).
    ``weights``: log weights of the model of all, without the first and without the second half."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        ratio = weights.value
        alien = np.minimum(ratio + ALIEN, 0)
        for batch in batches:
            n = batch.num_rows
            model = np.array([1 + known.value[x][0] if x in known.value else 0 for x in batch.column(3).to_pylist()], dtype=np.int64)
            count, total, bad = (np.zeros((n, FAMILIES)) for _ in range(3))
            for numbers, parts in _slices(byte_list(batch.column(2))):
                numbers = np.array(numbers)
                for k, (part, bucket) in enumerate(ngrams(parts)):
                    m = len(parts)  # a number may repeat over slices, never within one
                    at = model[numbers][part]
                    count[numbers, k] += np.bincount(part, minlength=m)
                    total[numbers, k] += np.bincount(part, weights=ratio[at, bucket], minlength=m)
                    bad[numbers, k] += np.bincount(part, weights=alien[at, bucket], minlength=m)
            x = np.hstack([total / (count + 10), bad / (count + 10), 1 / (count[:, :1] + 10)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(count[:, 0].astype(np.int64)), pa.array(total.sum(axis=1)),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))],
                ["id", "h", "n_words", "log_weight", "x"])

    out = rows.select("id", "h", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("log_weight"),
                      F.array(F.lit(0.0)).alias("x"))
    return rows.mapInArrow(run, out.schema)


def calibrate(x, clean):
    """Logistic regression (balanced, ridge) of ``clean`` on features, and
    the cut with the fewest errors: ``(weights, bias)``; the clean side is >= 0."""
    import numpy as np

    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    y = clean.astype(float)
    per = np.where(clean, 0.5 / clean.mean(), 0.5 / (~clean).mean())
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (per * (p - y)) + 1.0 * w
        step = np.linalg.solve((z * (per * p * (1 - p) + 1e-6)[:, None]).T @ z + np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    score = z @ w
    order = np.argsort(score)
    kept = np.cumsum(clean[order]) / clean.sum()          # clean rows lost by a cut behind each place
    passed = 1 - np.cumsum(~clean[order]) / (~clean).sum()  # others let through
    best = int(np.argmin(CLEAN_WEIGHT * kept + passed))
    cut = score[order[best]] if best + 1 >= len(order) else (score[order[best]] + score[order[best + 1]]) / 2
    own = w[:-1] / scale
    return own.tolist(), float(w[-1] - own @ mean - cut)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest ``key`` (double) of a table: histograms of ever
    narrower ranges, a thousand bins sent to the driver each round."""
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k >= n:
        return lo
    while lo < hi:
        step = (hi - lo) / 1024
        if not lo < lo + step < hi:
            break
        bin_ = F.least(F.floor((F.col("key") - lo) / step), F.lit(1023))
        bins = keys.where(F.col("key").between(lo, hi)).groupBy(bin_.alias("bin")).agg(
            F.count("key").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for b in sorted(bins, key=lambda b: -b.bin):
            if k <= b.n:
                lo, hi = b.lo, b.hi
                break
            k -= b.n
        if sum(b.n for b in bins) == 1:
            break
    if lo < hi:  # neighbours that no bin can part: the few distinct values decide
        for key, n in keys.where(F.col("key").between(lo, hi)).groupBy("key").count().orderBy(F.desc("key")).collect():
            if k <= n:
                return key
            k -= n
    return lo


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            fit_rows: int = FIT_ROWS, temperature: float = TEMPERATURE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``log_weight`` (sum over
    n-grams), ``logit`` (calibrated, clean side >= 0), ``key``, ``kept`` and,
    if ``keep`` names columns, the struct ``document`` of them.

    ``labels`` has ``doc_id, quality, toxic``; clean means quality 1 and not toxic.
    """
    import numpy as np

    spark = prepare(docs.sparkSession)
    found = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("clean"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect())
    known = {r.doc_id: (k % 2, r.clean) for k, r in enumerate(found)}
    ident = F.col(id_col)
    text = F.col(text_col).cast("string")
    halves = spark.sparkContext.broadcast(known)
    counts = np.zeros((3, FAMILIES * BUCKETS))
    for r in model_counts(docs.select(ident.alias("doc"), text.alias("text")), halves).toLocalIterator():  # at most FAMILIES * BUCKETS rows
        counts[:, r.bucket] = r.raw, r.first, r.second
    weights = spark.sparkContext.broadcast(np.stack([log_ratios(counts[0], t) for t in (counts[1] + counts[2], counts[2], counts[1])]))
    rows = docs.select(ident.alias("id"), F.xxhash64(ident, text).alias("h"), text.alias("text"), ident.alias("doc"))
    own = stash(document_weights(rows, halves, weights), "weights").withColumn("doc", F.col("id"))

    fit = own.join(F.broadcast(spark.createDataFrame([(k, c) for k, (_, c) in known.items()] or [(None, None)],
                                                     f"doc {own.schema['doc'].dataType.simpleString()}, clean boolean")), "doc")
    sample = fit.orderBy(F.xxhash64("doc"), "h").limit(2 * fit_rows).select("x", "clean").collect()
    x, y = np.array([r.x for r in sample]).reshape(-1, FEATURES), np.array([r.clean for r in sample], dtype=bool)
    coef, bias = calibrate(x, y) if y.any() and not y.all() else ([0.0] * FEATURES, 0.0)
    logit = sum((F.col("x")[k] * w for k, w in enumerate(coef)), F.lit(bias))
    unit = (F.shiftrightunsigned(F.xxhash64("h", F.lit("gumbel")), 11) + F.lit(0.5)) / float(1 << 53)

    def drawn(weighed):
        return weighed.withColumn("logit", logit).withColumn("key", F.col("logit") - temperature * F.log(-F.log(unit)))

    keyed = drawn(own)
    k = keyed.where("logit >= 0").count()
    kept = F.col("key") >= kth_largest(keyed.select("key"), k) if k else F.lit(False)
    if keep:  # weigh the texts once more beside their columns: cheaper than to write or shuffle them
        packed = F.struct(ident.alias("doc"), F.struct(*keep).alias("document"))
        weighed = document_weights(docs.select(packed.alias("id"), F.xxhash64(ident, text).alias("h"), text.alias("text"),
                                               ident.alias("doc")), halves, weights)
        keyed = drawn(weighed.withColumn("doc", F.col("id.doc")))
    return keyed.select(F.col("doc").alias(id_col), "n_words", "log_weight", "logit", "key",
                        kept.alias("kept"), *([F.col("id.document").alias("document")] if keep else []))
