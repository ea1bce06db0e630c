"""Vector retrieval over the knowledge base.

Physical design
---------------
Scoring is a dot product of every query with every chunk. The pairs are
never materialised and the knowledge base never passes through the driver:
chunks are cut into blocks by position, queries into parts by hash; every block
meets every part in an equi-join on (block, part). A query is sent once for
each block and a chunk once for each part, so both are as large as a task's
memory allows (``CELL_VALUES`` components), and there are only so many parts
that ``CELLS`` cells keep the cluster busy.

Inside such a cell chunks come in pieces of ``PIECE_VALUES`` components. Each
source's chunks of a piece are put into clusters of about ``CLUSTER_ROWS``
around a few centres, each with the radius that holds its rows, so
``query . centre + |query| * radius`` bounds every score of a cluster. A query
scores its best-bounded cluster first and skips every cluster whose bound lies
below its n-th score. Scores are first taken in single precision, in tiles that
stay in the cache; what its error lets reach the n-th score is scored again in
double precision, always in one order of its components, so equal vectors have
equal scores wherever they lie. The result is exact, and clusters that can't
matter cost one number. Lists go on from piece to piece; one window per
(query, source) merges the lists of the blocks. Block ids and the number of
parts are scalar subqueries, so building a query starts no job, and there is
one path whatever the sizes.

Vectors that are null, empty or hold null or non-finite components take no
part; a query meets the chunks of its own number of dimensions.

Ordering rule (R7): score descending, ties -> higher chunk position first.
Interleave (R8): i-th CWE then i-th CVE, stop at the shorter list, cut to
``top_k``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rounding
from ..functions import severity as sev

DEFAULT_TOP_K = 6
# Fixed value: prefix of the text that the embedding model sees.
QUERY_PREFIX = "search_query: "
CELL_VALUES = 1 << 24        # vector components of each side of a cell (chunks: of each source), on average
BLOCK_ROWS = 1 << 18         # chunks of each source in a block, at most: every query is sent to every block
QUERY_ROWS = 4096            # queries in a part, at least (about: parts are dealt by hash): every chunk is sent to every part
CELLS = 64                   # cells that are wanted before parts grow
PIECE_VALUES = 1 << 21       # vector components of the chunks that are clustered and scored at once
CLUSTER_ROWS = 512           # chunks of a cluster (on average)
MAX_SCORE_BYTES = 4 << 20    # score matrix of a slice of queries and a cluster (single precision takes half of it)

TOPN_SCHEMA = "query_id string, source string, chunk_pos long, score double"


def per_source_n(top_k: int) -> int:
    """``top_k // 2 + 1`` per source; negative ``top_k`` is rejected."""
    if top_k < 0:
        raise ValueError("top_k must be >= 0")
    return top_k // 2 + 1


def query_text_prefixed(col) -> "F.Column":
    """The text the embedding model sees."""
    return F.concat(F.lit(QUERY_PREFIX), col)


def function_query_id():
    """Query id of a catalogued function: ``fn_ord`` and ``file``, in an order
    that any file name leaves readable."""
    return F.concat(F.col("fn_ord").cast("string"), F.lit("#"), F.col("file"))


def with_function_key(df: DataFrame) -> DataFrame:
    """``file, fn_ord`` back from ``function_query_id``."""
    return (df.withColumn("fn_ord", F.expr("left(query_id, instr(query_id, '#') - 1)").cast("int"))
            .withColumn("file", F.expr("substring(query_id, instr(query_id, '#') + 1)")).drop("query_id"))


def normalise_vectors(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Scale each vector to unit length (zero vectors stay zero)."""
    sq = F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    out = df.withColumn("_norm", F.sqrt(sq))
    as_double = F.transform(col, lambda x: x.cast("double"))
    return (out.withColumn(col, F.when(F.col("_norm") > 0, F.transform(
        col, lambda x: x.cast("double") / F.col("_norm"))).otherwise(as_double))
        .drop("_norm"))


def eligible_chunks(kb: DataFrame, min_severity: str = sev.DEFAULT_MIN_SEVERITY) -> DataFrame:
    """Every CWE chunk; CVE chunks with rank(cvss_severity) >= rank(min).

    A CVE table without a ``cvss_severity`` column counts as LOW; a null or
    unknown value ranks 0. Filtering before scoring gives the same result as
    the reference's filter-after-scoring and scores fewer rows.
    """
    sev_col = F.col("cvss_severity") if "cvss_severity" in kb.columns else F.lit("LOW")
    keep = (F.col("source") == "CWE") | (sev.rank(sev_col) >= F.lit(sev.rank_of(min_severity)))
    return kb.where(keep)


def _matrices(column):
    """``(rows, values)`` for every number of dimensions in an Arrow list
    array: matrices of the vectors that are whole and finite, in place where
    the array allows it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        own = column if len(rows) == len(column) else column.take(pa.array(rows))
        values = own.flatten().to_numpy(zero_copy_only=False)  # a null becomes NaN
        if values.dtype not in (np.float32, np.float64):
            values = values.astype(np.float64)
        values = values.reshape(len(rows), int(d))
        good = np.isfinite(values).all(axis=1)
        if good.all():
            yield rows, values
        elif good.any():
            yield rows[good], values[good]


def clusters(pos: np.ndarray, mat: np.ndarray, rows: int = CLUSTER_ROWS):
    """Clusters of a block's chunks: ``(centre, radius, pos, mat)`` each, rows
    by descending position. Centres start at rows picked by a hash of their
    position and are moved to their cluster's mean twice."""
    k = max(1, len(pos) // rows)
    seed = np.argsort((pos.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), kind="stable")[:k]
    centre = mat[seed]
    for _ in range(3 if k > 1 else 1):
        own = (mat @ centre.T - (centre ** 2).sum(axis=1) / 2).argmax(axis=1)
        present = np.unique(own)
        centre = np.stack([mat[own == c].mean(axis=0) for c in present])
        own = np.searchsorted(present, own)
    out = []
    for c in range(len(centre)):
        mine = np.flatnonzero(own == c)
        mine = mine[np.argsort(-pos[mine], kind="stable")]  # the tie rule is then "first column wins"
        radius = np.sqrt(((mat[mine] - centre[c]) ** 2).sum(axis=1).max())
        out.append((centre[c], radius, pos[mine], mat[mine]))
    return out


def _in_range(norm):
    """Lengths whose products neither overflow nor vanish."""
    return (norm > 1e-140) & (norm < 1e140)


def _reaching(vec: np.ndarray, mat: np.ndarray, least: np.ndarray, n: int, slack: float, space=None):
    """``(rows, columns)`` of the scores that may be among a row's best ``n``:
    those that reach ``least`` (where it is ``-inf``, the row's own ``n``-th
    score), less ``slack``."""
    got = np.matmul(vec, mat.T, out=None if space is None else space[:len(vec) * len(mat)].reshape(len(vec), len(mat)))
    new = np.flatnonzero(np.isneginf(least))
    if len(new) and n < len(mat):
        least = least.copy()
        least[new] = np.partition(got[new], len(mat) - n, axis=1)[:, len(mat) - n]
    least = least - slack
    rows = np.flatnonzero(got.max(axis=1) >= least)
    r, c = np.nonzero(got[rows] >= least[rows, None])
    return rows[r], c


def _candidates(vec, unit, scale, zero, mat, flat, least, n: int, space):
    """``(rows, columns)`` of all scores that can be among the best ``n`` and
    reach ``least``: found in single precision (``unit`` and ``flat`` have
    length 1 at most, ``scale`` is what they were divided by), again in double
    precision if that leaves many. A zero vector scores 0 everywhere: its best
    are the first columns. Where lengths are too large or small for this
    (``scale`` is NaN), all columns are taken. None is where ``least`` is
    ``inf``."""
    d, m = vec.shape[1], len(mat)
    odd = np.isnan(scale) & (least < np.inf)
    least = np.where(np.isnan(scale), np.inf, least / scale)
    r, c = _reaching(unit, flat, least, n, (d + 16) * 2.0 ** -22, space)
    if len(r) > len(vec) * m // 8:
        r, c = _reaching(vec / scale[:, None], mat, least, n, (d + 16) * 2.0 ** -51)
    if not odd.any():
        return r, c
    rest = [(r, c)]
    for who, width in ((np.flatnonzero(odd & zero), min(n, m)), (np.flatnonzero(odd & ~zero), m)):
        rest.append((np.repeat(who, width), np.tile(np.arange(width), len(who))))
    return tuple(np.concatenate(x) for x in zip(*rest))


def pruned_top(vec: np.ndarray, parts, n: int, best=None):
    """``(pos, scores, skipped)``: each query's best ``n`` chunks over the
    clusters ``parts`` (fewer are filled with ``-inf``), and how many
    (query, cluster) cells were skipped by their bound. ``best`` holds the
    ``(pos, scores)`` of chunks seen before and is brought up to date."""
    vec = vec.astype(np.float64, copy=False)
    with np.errstate(over="ignore"):
        norm = np.sqrt((vec ** 2).sum(axis=1))
    centres, radii = np.stack([c for c, _, _, _ in parts]), np.array([r for _, r, _, _ in parts])
    size = norm[:, None] * (np.sqrt((centres ** 2).sum(axis=1)) + radii)
    bound = vec @ centres.T + norm[:, None] * radii + 1e-9 * size  # more than rounding can take away
    found, scores = best or (np.full((len(vec), n), -1, dtype=np.int64), np.full((len(vec), n), -np.inf))
    unit = (vec / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)
    zero, sound = ~vec.any(axis=1), _in_range(norm)
    bound[~sound & ~zero] = np.inf  # bounds don't hold there
    space = np.empty(max(MAX_SCORE_BYTES // 8, max(len(p) for _, _, p, _ in parts)), dtype=np.float32)
    pairs = max(1, MAX_SCORE_BYTES // (8 * vec.shape[1]))
    skipped = 0

    def visit(c: int, wanted: np.ndarray):
        _, _, pos, mat = parts[c]
        longest = float(np.sqrt((mat ** 2).sum(axis=1).max())) or 1.0
        flat = (mat / longest).astype(np.float32)
        scale = np.where(sound & ~zero & _in_range(longest), norm * longest, np.nan)
        step = max(1, MAX_SCORE_BYTES // (len(pos) * 8))
        who = None if 2 * wanted.sum() > len(vec) else np.flatnonzero(wanted)  # mostly all: no copies, the others left out
        for lo in range(0, len(vec) if who is None else len(who), step):
            some = slice(lo, lo + step) if who is None else who[lo:lo + step]
            least = np.where(wanted[some], scores[some, -1], np.inf)
            at, col = _candidates(vec[some], unit[some], scale[some], zero[some], mat, flat, least, n, space)
            if not len(at):
                continue
            at = at + lo if who is None else some[at]
            exact = np.concatenate([np.einsum("ij,ij->i", vec[at[i:i + pairs]], mat[col[i:i + pairs]])
                                    for i in range(0, len(at), pairs)])
            mine, row = np.unique(at, return_inverse=True)
            row = np.concatenate([np.repeat(np.arange(len(mine)), n), row])
            values, places = np.append(scores[mine].ravel(), exact), np.append(found[mine].ravel(), pos[col])
            order = np.lexsort((-places, -values, row))
            row = row[order]
            order = order[np.arange(len(row)) - np.searchsorted(row, row) < n].reshape(len(mine), n)
            scores[mine], found[mine] = values[order], places[order]

    first = np.where(np.isneginf(scores[:, -1]), bound.argmax(axis=1), -1)
    for c in np.unique(first[first >= 0]):
        visit(c, first == c)
    for c in np.argsort(-bound.max(axis=0, where=sound[:, None], initial=-np.inf), kind="stable"):
        other = first != c
        open_ = other & (bound[:, c] >= scores[:, -1])  # an equal score may still win by position
        skipped += int(other.sum() - open_.sum())
        if open_.any():
            visit(c, open_)
    return found, scores, skipped


def _by_source(sources: list, matrices):
    """``(source, rows, values)``: the matrices' rows of one source each."""
    names = list(dict.fromkeys(sources))
    code = np.array([names.index(x) for x in sources], dtype=np.int64)
    for rows, mat in matrices:
        for c in np.unique(code[rows]):
            mine = code[rows] == c
            yield names[c], rows[mine], mat[mine]


def _asked(queries) -> dict:
    """By number of dimensions, ``(ids, vectors)`` of the queries, in the
    slices they came in. Of several vectors of one id the smallest counts,
    component by component."""
    import pyarrow as pa

    out = {}
    for batch in queries.to_batches():
        for rows, mat in _matrices(batch.column("embedding")):
            out.setdefault(mat.shape[1], []).append((batch.column("query_id").take(pa.array(rows)), mat))
    for d, slices in out.items():
        code = pa.concat_arrays([ids for ids, _ in slices]).dictionary_encode("encode").indices.to_numpy()
        again = np.flatnonzero((np.bincount(code) > 1)[code])
        if not len(again):
            continue
        at = np.cumsum([0] + [len(mat) for _, mat in slices])
        vec = np.concatenate([mat[again[(again >= lo) & (again < lo + len(mat))] - lo] for lo, (_, mat) in zip(at, slices)])
        order = np.lexsort((*vec.T[::-1], code[again]))
        again = again[order]
        keep = np.ones(len(code), dtype=bool)
        keep[again[1:][code[again[1:]] == code[again[:-1]]]] = False
        out[d] = [(ids.filter(pa.array(own)), mat[own]) for lo, (ids, mat) in zip(at, slices) if (own := keep[lo:lo + len(mat)]).any()]
    return out


def _without_copies(pos: np.ndarray, mat: np.ndarray, n: int):
    """Of equal vectors the ``n`` of highest position: no other can be in a list."""
    key = mat @ np.cos(np.arange(mat.shape[1]))
    order = np.argsort(key, kind="stable")
    like = key[order[1:]] == key[order[:-1]]
    if not like.any():
        return pos, mat
    rows = order[np.append(like, False) | np.append(False, like)]
    own = np.unique(mat[rows], axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((-pos[rows], own))
    rows, own = rows[order], own[order]
    keep = np.ones(len(pos), dtype=bool)
    keep[rows[np.arange(len(own)) - np.searchsorted(own, own) >= n]] = False
    return pos[keep], mat[keep]


def _pieces(chunks, dims, n: int):
    """``(source, pos, matrix)`` of a cell's chunks, about ``PIECE_VALUES`` components each."""
    waiting: dict = {}

    def whole(source, d):
        pos, mat = zip(*waiting.pop((source, d)))
        return source, *_without_copies(np.concatenate(pos), np.concatenate(mat).astype(np.float64), n)

    for batch in chunks.to_batches():
        all_pos = batch.column("chunk_pos").to_numpy()
        for source, rows, mat in _by_source(batch.column("source").to_pylist(), _matrices(batch.column("embedding"))):
            if (d := mat.shape[1]) not in dims:
                continue
            waiting.setdefault((source, d), []).append((all_pos[rows], mat))
            if sum(m.size for _, m in waiting[source, d]) >= PIECE_VALUES:
                yield whole(source, d)
    for source, d in list(waiting):
        yield whole(source, d)


def _score(n: int, cluster_rows: int, profile: bool = False):
    def run(queries, chunks):
        import pyarrow as pa

        out = [pa.table({"query_id": pa.array([], pa.string()), "source": pa.array([], pa.string()),
                         "chunk_pos": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        asked, lists = _asked(queries), {}
        for source, pos, mat in _pieces(chunks, asked, n) if asked else ():
            parts = clusters(pos, mat, cluster_rows)
            for i, (ids, vec) in enumerate(asked[mat.shape[1]]):
                best = lists.setdefault((source, mat.shape[1], i), (np.full((len(vec), n), -1, dtype=np.int64), np.full((len(vec), n), -np.inf)))
                skipped = pruned_top(vec, parts, n, best)[2]
                if profile:
                    out.append(pa.table({"query_id": ["cells", "skipped"], "source": [source] * 2,
                                         "chunk_pos": [len(ids) * len(parts), skipped], "score": [0.0, 0.0]}))
        for (source, d, i), (pos, scores) in lists.items() if not profile else ():
            real = np.flatnonzero(pos.ravel() >= 0)
            out.append(pa.table({
                "query_id": asked[d][i][0].take(pa.array(real // n)), "source": pa.array([source] * len(real), pa.string()),
                "chunk_pos": pos.ravel()[real], "score": scores.ravel()[real]}))
        return pa.concat_tables(out)

    return run


def _cells(queries: DataFrame, kb: DataFrame, min_severity: str, block_rows: int, query_rows: int):
    """Queries and chunks, both grouped by the (block, part) they meet in."""
    chunks = eligible_chunks(kb, min_severity).select("source", F.col("chunk_pos").cast("long").alias("chunk_pos"), "embedding")
    # rows of either side that a cell may hold
    most = F.greatest(F.floor(CELL_VALUES / F.greatest(F.avg(F.array_size("embedding")), F.lit(1))), F.lit(1))
    most = chunks.select(F.coalesce(most, F.lit(1)).cast("long")).scalar()
    block = F.floor(F.col("chunk_pos") / F.least(F.lit(block_rows).cast("long"), most))  # of every source, so a query is sent once for all
    chunks = chunks.withColumn("block", block.cast("long"))
    blocks = chunks.select(F.collect_set("block")).scalar()
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    n = F.count(F.lit(1))
    wanted = F.ceil(CELLS / F.greatest(F.size(blocks), F.lit(1)))
    parts = q.select(F.greatest(F.ceil(n / F.greatest(most, F.lit(query_rows))), F.least(F.ceil(n / query_rows), wanted), F.lit(1)).cast("int")).scalar()
    held = (chunks.withColumn("parts", F.sequence(F.lit(0), parts - 1)).withColumn("part", F.explode("parts")).drop("parts"))
    asked = (q.withColumn("part", F.pmod(F.xxhash64("query_id"), parts).cast("int"))
             .withColumn("blocks", blocks).withColumn("block", F.explode("blocks")).drop("blocks"))
    return asked.groupBy("block", "part").cogroup(held.groupBy("block", "part"))


def top_n_per_source(queries: DataFrame, kb: DataFrame, top_k: int = DEFAULT_TOP_K,
                     min_severity: str = sev.DEFAULT_MIN_SEVERITY, block_rows: int = BLOCK_ROWS,
                     query_rows: int = QUERY_ROWS, cluster_rows: int = CLUSTER_ROWS) -> DataFrame:
    """``(query_id, source, rn, chunk_pos, score)``, rn <= n per source.

    ``queries``: ``query_id, embedding`` (already normalised, R4); one result
    per ``query_id``. ``kb`` rows are told apart by ``(source, chunk_pos)``.
    """
    n = per_source_n(top_k)
    found = _cells(queries, kb, min_severity, block_rows, query_rows).applyInArrow(_score(n, cluster_rows), TOPN_SCHEMA)
    found = found.repartition("query_id")  # for this window and what else goes by query
    w = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), F.desc("chunk_pos"))
    return (found.withColumn("rn", F.row_number().over(w).cast("int")).where(F.col("rn") <= n)
            .select("query_id", "source", "rn", "chunk_pos", "score"))


def pruning_profile(queries: DataFrame, kb: DataFrame, top_k: int = DEFAULT_TOP_K,
                    min_severity: str = sev.DEFAULT_MIN_SEVERITY, block_rows: int = BLOCK_ROWS,
                    query_rows: int = QUERY_ROWS, cluster_rows: int = CLUSTER_ROWS) -> DataFrame:
    """Per source, how many (query, cluster) cells ``top_n_per_source`` meets
    and how many of them it skips by their bound."""
    found = _cells(queries, kb, min_severity, block_rows, query_rows).applyInArrow(
        _score(per_source_n(top_k), cluster_rows, profile=True), TOPN_SCHEMA)
    of = lambda what: F.sum(F.when(F.col("query_id") == what, F.col("chunk_pos")).otherwise(0))
    return found.groupBy("source").agg(of("cells").alias("n_cells"), of("skipped").alias("n_skipped"))


def interleave(topn: DataFrame, top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """``pos`` 0.. = CWE1, CVE1, CWE2, CVE2, ...; stop at the shorter
    list; keep ``pos < top_k``. A query without any CVE gets nothing."""
    w = Window.partitionBy("query_id")
    n_cwe = F.count_if(F.col("source") == "CWE").over(w)
    n_cve = F.count_if(F.col("source") == "CVE").over(w)
    pos = 2 * (F.col("rn") - 1) + F.when(F.col("source") == "CVE", 1).otherwise(0)
    return (topn.withColumn("_m", F.least(n_cwe, n_cve))
            .where(F.col("rn") <= F.col("_m"))
            .withColumn("pos", pos.cast("int"))
            .where(F.col("pos") < top_k)
            .drop("_m"))


def hydrate(hits: DataFrame, kb: DataFrame) -> DataFrame:
    """Attach the chunk row to each hit by ``(source, chunk_pos)``; Spark
    chooses the join by the sides' real sizes and splits hot chunks."""
    return hits.join(kb.drop("embedding"), ["source", "chunk_pos"], "left")


def retrieve(queries: DataFrame, kb: DataFrame, top_k: int = DEFAULT_TOP_K,
             min_severity: str = sev.DEFAULT_MIN_SEVERITY, **sizes: int) -> DataFrame:
    """Hydrated hits with ``pos``."""
    return hydrate(interleave(top_n_per_source(queries, kb, top_k, min_severity, **sizes), top_k), kb)


def context_text(hits: DataFrame) -> DataFrame:
    """One ``context`` text per query from hydrated hits.

    Fixed values: the header formats.

    CWE header ``[Ref i | chunk_id | relevance 0.00]``; CVE header
    ``[Ref i | cve_id | CVSS score sev | cwe_id | relevance 0.00]``; header,
    newline, chunk text; blocks joined by a blank line in ``pos`` order.
    """
    rel = F.format_string("%.2f", rounding.round2("score"))
    ref = F.concat(F.lit("[Ref "), (F.col("pos") + 1).cast("string"), F.lit(" | "))

    def opt(c, default):
        return F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in hits.columns \
            else F.lit(default)
    cwe_head = F.concat(ref, opt("chunk_id", ""), F.lit(" | relevance "), rel, F.lit("]"))
    cve_head = F.concat(ref, opt("cve_id", ""), F.lit(" | CVSS "), opt("cvss_score", "?"),
                        F.lit(" "), opt("cvss_severity", "?"), F.lit(" | "), opt("cwe_id", ""),
                        F.lit(" | relevance "), rel, F.lit("]"))
    block = F.concat(F.when(F.col("source") == "CWE", cwe_head).otherwise(cve_head),
                     F.lit("\n"), F.coalesce(F.col("chunk_text"), F.lit("")))
    per_q = (hits.groupBy("query_id")
             .agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("_b")))
    return per_q.select("query_id", F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n")
                        .alias("context"))


def retrieve_context(queries: DataFrame, kb: DataFrame, top_k: int = DEFAULT_TOP_K,
                     min_severity: str = sev.DEFAULT_MIN_SEVERITY, **sizes: int) -> DataFrame:
    """R5-R10 in one step: ``(query_id, context)``; queries without hits get no row."""
    return context_text(retrieve(queries, kb, top_k, min_severity, **sizes))


def similarity_profile(queries: DataFrame, kb: DataFrame,
                       min_severity: str | None = None) -> DataFrame:
    """R5 summary without materialising pairs: per query and source, how
    many chunks were scored and the best score (from the n=1 top list)."""
    level = min_severity or "INFO"  # INFO keeps every chunk
    counts = (eligible_chunks(kb, level).groupBy("source")
              .agg(F.count(F.lit(1)).alias("n_scored")))
    best = top_n_per_source(queries, kb, top_k=0, min_severity=level)
    return best.join(F.broadcast(counts), "source").select(
        "query_id", "source", "n_scored", F.col("score").alias("max_score"),
        F.col("chunk_pos").alias("best_chunk_pos"))
