"""Connected components of a link table, as Spark jobs, and the local
spanning forests that keep link tables small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def forest(u, v):
    """Star edges ``(node, root)`` spanning the links ``u[i] - v[i]`` (numpy
    arrays of int64): every node but a component's smallest, with it."""
    import numpy as np

    if not len(u):
        return u, v
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)  # hook roots
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:  # jump to the root
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _summary(edges: DataFrame):
    # decimal sums: 64-bit hashes must not overflow
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``u, v``, 64-bit
    integers, any order, repeats and loops allowed); ``root`` is the smallest
    node that can be reached.

    Alternating large-star and small-star rounds: each is a minimum by node
    (combined before the shuffle) and an equi-join back. The minima are
    written first, so the join knows their size and deals both of its sides
    anew: a node with a great many links can be split. Rounds are
    written to the shared folder and deleted when the next one is there.
    Rounds grow with the logarithm of the longest path. No links give no rows.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = stash(edges, "links")
    state = _summary(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        high = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = (both.where("v > u").join(high, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: now every edge points down; link lower neighbours and the node itself to the least of them
        large = stash(large, "links")
        low = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges, old = stash(small, "links"), edges
        discard(old, large, low, high)
        new = _summary(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
