"""Burrows-Wheeler transforms of string collections and their merge.

Symbols are ``symbol`` bytes read at every byte position: the suffix at ``p``
is followed by the one at ``p + symbol``, so a collection holds ``symbol``
interleaved chains for each string, each closed by an end mark that sorts
first. Suffixes are told apart up to ``depth`` symbols, all that a repeat of
``symbol * depth`` bytes asks for; wide symbols need few rounds.

``Shard`` sorts the suffixes of one bounded collection and keeps its
transform. ``merge`` interleaves the transforms of several shards by iterative
refinement: round ``h`` orders all suffixes by their first ``h`` symbols with
one stable bucket pass over the transforms, starting from no order at all. It
reads transforms only - no suffix is compared or sorted again - and a boundary
that first appears in round ``h`` tells a common prefix of ``h - 1`` symbols.
"""

from __future__ import annotations

#: Bytes of a machine word, by which symbols are read.
WORD = 8


class Collection:
    """Strings laid out end to end: text, symbol codes (0: end mark) and chain ends."""

    def __init__(self, strings: list[bytes], symbol: int):
        import numpy as np

        self.symbol = symbol
        self.sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        raw = np.frombuffer(b"".join(strings) + bytes(WORD), dtype=np.uint8)
        self.n = n = len(raw) - WORD
        self.owner = np.repeat(np.arange(len(strings)), self.sizes)
        self.left = self.starts[self.owner] + self.sizes[self.owner] - np.arange(n)  # bytes from here to the string's end
        word = np.lib.stride_tricks.as_strided(raw, shape=(n, WORD), strides=(1, 1)).copy().view(">u8").ravel().astype(np.uint64)
        cut = np.minimum(self.left, WORD).astype(np.uint64)
        if n:
            word &= ~np.uint64(0) << ((np.uint64(WORD) - cut) * np.uint64(8))
        # a cut word sorts before a whole one of the same bytes
        code = np.unique(word, return_inverse=True)[1] * 2 + (cut == WORD) + 1
        known = WORD
        while known < symbol:
            step = min(known, symbol - known)
            code = np.unique(code * (2 * n + 3) + ahead(code, self.left, step), return_inverse=True)[1] + 1
            known += step
        self.code = code


def ahead(rank, left, step: int):
    """Ranks ``step`` bytes further on in the same string (0: past its end)."""
    import numpy as np

    out = np.zeros(len(rank), dtype=np.int64)
    ok = np.flatnonzero(left > step)
    out[ok] = rank[ok + step]
    return out


class Shard:
    """Suffixes of some strings of a collection, sorted by ``depth`` symbols,
    and their transform (the code before each suffix)."""

    def __init__(self, whole: Collection, strings, depth: int):
        import numpy as np

        chosen = np.zeros(len(whole.sizes), dtype=bool)
        chosen[strings] = True
        at = np.flatnonzero(chosen[whole.owner])  # positions, in text order
        n = len(at)
        left, code = whole.left[at], whole.code[at]

        rank, known = code, 1
        while known < depth:
            step = min(known, depth - known)
            rank = np.unique(rank * (2 * whole.n + 3) + ahead(rank, left, step * whole.symbol), return_inverse=True)[1] + 1
            known += step
        order = np.argsort(rank, kind="stable")
        # Chain ends come first; behind each of them stands the last symbol of its chain.
        tail = np.flatnonzero(left <= whole.symbol)
        first = whole.starts[whole.owner[at]] + whole.symbol > at  # no symbol before these
        before = np.zeros(n, dtype=np.int64)
        inner = np.flatnonzero(~first)
        before[inner] = code[inner - whole.symbol]
        self.places = np.concatenate([np.full(len(tail), -1), at[order]])
        self.transform = np.concatenate([code[tail], before[order]])


def _bucketed(code):
    """Stable order by code, by two passes over its 16-bit halves."""
    import numpy as np

    low = np.argsort((code & 0xFFFF).astype(np.uint16), kind="stable")
    high = (code >> 16).astype(np.uint16)[low]
    return low[np.argsort(high, kind="stable")] if len(high) and high.max() else low


def merge(shards: list[Shard], depth: int):
    """``(places, common)``: all suffixes of the shards in merged order
    (-1: chain ends) and the symbols each shares with the one before, up to ``depth``."""
    import numpy as np

    sizes = [len(s.transform) for s in shards]
    source = np.repeat(np.arange(len(shards), dtype=np.int16), sizes)
    n = len(source)
    block = np.zeros(n, dtype=np.int32)
    common = np.full(n, depth, dtype=np.int16)
    open_ = np.ones(n, dtype=bool)
    for h in range(1, depth + 1):
        code = np.empty(n, dtype=np.int32)
        for k, s in enumerate(shards):
            code[source == k] = s.transform  # a shard's suffixes stand in its own order
        order = _bucketed(code)
        code, block, source = code[order], block[order], source[order]
        edge = np.ones(n, dtype=bool)
        edge[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
        fresh = edge & open_
        if h > 1 and not fresh.any():
            break  # nothing was told apart in this round, so nothing will be
        common[fresh] = h - 1
        open_ &= ~edge
        block = np.cumsum(edge, dtype=np.int32)
    places = np.empty(n, dtype=np.int64)
    for k, s in enumerate(shards):
        places[source == k] = s.places
    return places, common


def repeated(strings: list[bytes], weights, length: int, shard_bytes: int, symbol: int):
    """Whether the ``length`` bytes (a multiple of ``symbol``) from each position occur
    in strings of weight 2 or more together: ``(collection, flags)``."""
    import numpy as np

    depth = length // symbol
    whole = Collection(strings, symbol)
    parts = np.cumsum(whole.sizes) // max(1, shard_bytes)
    shards = [Shard(whole, np.flatnonzero(parts == k), depth) for k in np.unique(parts)]
    places, common = merge(shards, depth)
    interval = np.cumsum(common < depth)  # suffixes that share all symbols
    real = places >= 0
    real[real] = whole.left[places[real]] >= length
    at, interval = places[real], interval[real]
    mass = np.bincount(interval, weights=np.asarray(weights)[whole.owner[at]])
    flags = np.zeros(whole.n, dtype=bool)
    flags[at[mass[interval] >= 2]] = True
    return whole, flags
