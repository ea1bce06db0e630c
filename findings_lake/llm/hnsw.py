"""Hierarchical navigable small-world graphs in numpy, worked in batches.

Rows come in random order; the first ``n // width**l`` of them form layer
``l``. Layers are built from the top; a batch of rows is inserted at once:
all its members search the layer as it stands, see each other directly, keep
a diverse choice of neighbours, and are linked back.
"""

from __future__ import annotations

WIDTH = 12
BUILD_BEAM = 40
BATCH = 512
#: Beam entries that one step opens.
OPEN = 3


def _nearest(graph: list, x, q):
    """Entry points of queries, walked down the layers above the lowest of ``graph``."""
    import numpy as np

    at = np.zeros(len(q), dtype=np.int64)
    for links in graph:
        ids, sims = beam(x, links, q, at, 4)
        at = ids[np.arange(len(q)), sims.argmax(axis=1)]
    return at


def beam(x, links, q, entry, ef: int):
    """Beam search of one layer for all queries together: ``(ids, sims)``,
    the ``ef`` best that were met (-1: none)."""
    import numpy as np

    m, width = len(q), links.shape[1]
    ids, sims = np.full((m, ef), -1), np.full((m, ef), -np.inf, dtype=np.float32)
    ids[:, 0], sims[:, 0] = entry, np.einsum("ij,ij->i", x[entry], q)
    opened = ids < 0
    seen = np.zeros((m, len(links)), dtype=bool)
    seen[np.arange(m), entry] = True
    act = np.arange(m)
    while len(act):
        waiting = np.where(opened[act], -np.inf, sims[act])
        top = np.argpartition(-waiting, min(OPEN, ef) - 1, axis=1)[:, :OPEN]
        live = np.take_along_axis(waiting, top, 1) > -np.inf
        more = live.any(axis=1)
        act, top, live = act[more], top[more], live[more]
        if not len(act):
            break
        rows = act[:, None]
        opened[rows, top] = True
        near = np.where(live[:, :, None], links[ids[rows, top]], -1).reshape(len(act), -1)
        near = np.sort(near, axis=1)
        good = near >= 0
        good[:, 1:] &= near[:, 1:] != near[:, :-1]
        good &= ~seen[rows, near]
        r, c = np.nonzero(good)
        found = near[r, c]
        seen[act[r], found] = True
        s = np.full(near.shape, -np.inf, dtype=np.float32)
        s[r, c] = np.einsum("ij,ij->i", x[found], q[act[r]])
        all_s = np.hstack([sims[act], s])
        best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        sims[act] = np.take_along_axis(all_s, best, 1)
        ids[act] = np.take_along_axis(np.hstack([ids[act], np.where(good, near, -1)]), best, 1)
        opened[act] = np.take_along_axis(np.hstack([opened[act], ~good]), best, 1)
    return ids, sims


def diverse(x, ids, sims, width: int, pool: int):
    """For each row the ``width`` neighbours to keep: near ones that aren't
    nearer to a kept one than to the row, then the nearest of the rest."""
    import numpy as np

    order = np.argsort(ids, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1).copy()
    sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
    sims[ids < 0] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")[:, :pool]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    valid = sims > -np.inf
    got = x[ids]
    between = got @ got.transpose(0, 2, 1)
    kept = np.zeros(ids.shape, dtype=bool)
    count = np.zeros(len(ids), dtype=np.int64)
    for j in range(ids.shape[1]):
        shadow = (kept[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(axis=1)
        kept[:, j] = valid[:, j] & ~shadow & (count < width)
        count += kept[:, j]
    place = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :width]
    out = np.where(np.take_along_axis(valid, place, 1), np.take_along_axis(ids, place, 1), -1)
    if out.shape[1] < width:
        out = np.hstack([out, np.full((len(out), width - out.shape[1]), -1)])
    return out


def _link_back(x, links, users, chosen):
    """Add ``users`` to the lists of the neighbours they have chosen."""
    import numpy as np

    width = links.shape[1]
    r, c = np.nonzero(chosen >= 0)
    if not len(r):
        return
    v, u = chosen[r, c], users[r]
    s = np.einsum("ij,ij->i", x[v], x[u])
    order = np.lexsort((-s, v))
    v, u = v[order], u[order]
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    rank = np.arange(len(v)) - np.repeat(start, np.diff(np.r_[start, len(v)]))
    targets = v[start]
    slot = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(v)]))
    fits = rank < width
    extra = np.full((len(targets), width), -1)
    extra[slot[fits], rank[fits]] = u[fits]
    for at in range(0, len(targets), BATCH):
        t = targets[at:at + BATCH]
        ids = np.hstack([links[t], extra[at:at + BATCH]])
        sims = np.einsum("ijk,ik->ij", x[ids], x[t])
        sims[ids < 0] = -np.inf
        links[t] = diverse(x, ids, sims, width, 2 * width)


def build(x, width: int = WIDTH, ef: int = BUILD_BEAM) -> list:
    """Neighbour lists of all layers, top first, of unit rows ``x`` (float32)."""
    import numpy as np

    sizes = [len(x)]
    while sizes[-1] // width >= 1 and sizes[-1] > width:
        sizes.append(sizes[-1] // width)
    graph: list = []
    for size in reversed(sizes):
        own = 2 * width if size == len(x) else width
        links = np.full((size, own), -1, dtype=np.int64)
        above = len(graph[-1]) if graph else 0
        at = 0
        while at < size:
            stop = min(size, at + BATCH, max(2 * at, at + 64))
            users, q = np.arange(at, stop), x[at:stop]
            inside = q @ q.T
            np.fill_diagonal(inside, -np.inf)
            k = min(own, len(q))
            ids = np.argpartition(-inside, k - 1, axis=1)[:, :k]
            sims = np.take_along_axis(inside, ids, 1)
            ids = np.where(sims > -np.inf, ids + at, -1)
            if at:
                entry = _nearest(graph, x, q) if at >= above > 0 else np.zeros(len(q), dtype=np.int64)
                older, near = beam(x, links[:at], q, entry, ef)
                ids, sims = np.hstack([older, ids]), np.hstack([near, sims])
            chosen = diverse(x, ids, sims, own, ef)
            links[users] = chosen
            _link_back(x, links, users, chosen)
            at = stop
        graph.append(links)
    return graph


def weak_rows(graph: list, n: int):
    """Rows of the lowest layer that a search may never meet: no path leads to
    them from the rows of the layer above, or fewer than two links do."""
    import numpy as np

    links = graph[-1]
    seen = np.zeros(n, dtype=bool)
    front = np.arange(len(graph[-2]) if len(graph) > 1 else 1)
    while len(front):
        seen[front] = True
        ahead = links[front].ravel()
        front = np.unique(ahead[ahead >= 0])
        front = front[~seen[front]]
    return np.flatnonzero(~seen | (np.bincount(links[links >= 0], minlength=n) < 2))


def planted(x, least: float, audit: int):
    """Queries whose partner is known without a scan: ``audit`` rows of ``x``
    turned by angles spread from none to that of ``least``, and the rows."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = rng.permutation(len(x))[:audit]
    side = rng.normal(size=(len(rows), x.shape[1]))
    side -= (side * x[rows]).sum(axis=1)[:, None] * x[rows]
    side /= np.maximum(np.linalg.norm(side, axis=1), 1e-12)[:, None]
    cosine = 1 - (1 - least) * np.linspace(0, 0.98, len(rows))
    return (cosine[:, None] * x[rows] + np.sqrt(1 - cosine ** 2)[:, None] * side).astype(np.float32), rows


def near_pairs(x, graph: list, q, least: float, ef: int = 32, audit: int = 256, recall: float = 0.99, same: bool = False):
    """``(query, row)`` numbers whose similarity is about ``least`` or more,
    found by beams through the graph.

    The beams' width is set by an audit: of ``audit`` planted queries (rows of
    the graph turned by a known angle) and of all true pairs of ``audit`` real
    queries, ``recall`` must be found, else the width doubles. Every query then
    searches with that width; a query whose every entry qualifies searches
    again, four times as wide. Rows the graph hardly leads to (``weak_rows``)
    are compared with all queries. Only where a beam would hold an eighth of
    the rows (small graphs, huge groups) all rows are compared. With ``same``
    the queries are the rows themselves (their pair with themselves may be among the results).
    """
    import numpy as np

    n = len(x)

    def scan(rows, columns=None):
        parts = []
        to = x if columns is None else x[columns]
        for at in range(0, len(rows), BATCH):
            r, c = np.nonzero(q[rows[at:at + BATCH]] @ to.T >= least)
            parts.append((rows[at:at + BATCH][r], c if columns is None else columns[c]))
        return tuple(np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))

    def search(asked, width):
        """Pairs by beams of one width, and the queries whose whole beam qualifies."""
        found, full_rows = [], [np.zeros(0, np.int64)]
        for at in range(0, len(asked), BATCH):
            own = asked[at:at + BATCH]
            ids, sims = beam(x, graph[-1], own, _nearest(graph[:-1], x, own), width)
            full = sims.min(axis=1) >= least
            r, c = np.nonzero(sims >= least)
            found.append((at + r, ids[r, c]))
            full_rows.append(at + np.flatnonzero(full))
        r, c = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return r, c, np.concatenate(full_rows)

    if not len(q) or 8 * ef > n:
        return scan(np.arange(len(q)))
    code, weak = np.int64(n), weak_rows(graph, n)
    reachable = np.ones(n, dtype=bool)
    reachable[weak] = False
    probes, partner = planted(x, least, audit)
    some = np.random.default_rng(8).permutation(len(q))[:audit]
    r, c = scan(some)
    place = np.full(len(q), -1)
    place[some] = np.arange(len(some))
    known = reachable[c] & ((r != c) if same else True)
    truth = np.concatenate([np.flatnonzero(reachable[partner]) * code + partner[reachable[partner]],
                            (len(probes) + place[r[known]]) * code + c[known]])
    asked = np.concatenate([probes, q[some]])
    while 8 * ef <= n:
        r, c, full = search(asked, ef)
        # a full beam is searched again later, so what it lacks is not lost
        fit = ~np.isin(truth // code, full)
        if not fit.any() or np.isin(truth[fit], r * code + c).mean() >= recall:
            break
        ef *= 2
    else:
        return scan(np.arange(len(q)))
    found, rows, width = [scan(np.arange(len(q)), weak)], np.arange(len(q)), ef
    while len(rows) and 8 * width <= n:
        r, c, full = search(q[rows], width)
        keep = ~np.isin(r, full)
        found.append((rows[r[keep]], c[keep]))
        rows, width = rows[full], 4 * width
    found.append(scan(rows))
    return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))
