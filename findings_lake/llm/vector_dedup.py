"""Embedding near-dedup with small-world graphs.

Equal vectors of a label are one node with a number of copies. A label's
nodes are dealt by hash to shards of bounded size; each shard gets a
hierarchical navigable small-world graph, and every node queries every shard
of its label. Beams widen until an audit passes that knows its pairs beforehand
(planted near copies of indexed rows, and the true pairs of a bounded number
of queries; see ``hnsw.near_pairs``). Every pair that is found is verified by its cosine
in double precision. Two shards meet in one task, which sends on link counts
by node and a spanning forest of the links, never the pairs themselves.

Only vectors of one non-null label and one length are compared. Vectors
that are null, empty, zero or hold null or non-finite components link with
nothing and are their own component; repeated rows are copies of each other;
a null id takes part but names a component only if there is no other; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stash
from .components import components, forest
from .hnsw import build, near_pairs
from .vectors import matrix

LEAST_COSINE = 0.93
SHARD_ROWS = 6144
#: What single precision may miss, verified away in double precision.
MARGIN = 1e-4
#: Pairs verified at once.
VERIFY = 1 << 17


def _unit(values):
    import numpy as np

    values = values / np.abs(values).max(axis=1)[:, None]
    return values / np.linalg.norm(values, axis=1)[:, None]


def _graph(key, group):
    import numpy as np
    import pyarrow as pa

    node = group["node"].to_numpy()
    order = np.argsort(np.array([hash((int(n), 7)) for n in node]))
    unit = _unit(matrix(group["v"])[0])[order]
    data = {"node": node[order], "copies": group["copies"].to_numpy()[order], "unit": unit,
            "graph": [links.astype(np.int32) for links in build(unit.astype(np.float32))]}
    return pa.table({"space": group["space"].slice(0, 1), "shard": group["shard"].slice(0, 1),
                     "shards": group["shards"].slice(0, 1), "data": pa.array([pickle.dumps(data, protocol=5)], pa.binary())})


def _links(least: float):
    """Task body: one shard with itself or two with each other -> counts and spanning links."""

    def run(key, group):
        import numpy as np
        import pyarrow as pa

        sides = [pickle.loads(d.as_py()) for _, d in sorted(zip(group["shard"].to_pylist(), group["data"]))]
        a, b = sides[0], sides[-1]
        single = [s["unit"].astype(np.float32) for s in (a, b)]
        graph = [[links.astype(np.int64) for links in s["graph"]] for s in (a, b)]
        code = np.int64(len(b["node"]))
        i, j = near_pairs(single[1], graph[1], single[0], least - MARGIN, same=a is b)
        pairs = [i * code + j]
        if a is not b:
            j, i = near_pairs(single[0], graph[0], single[1], least - MARGIN)
            pairs.append(i * code + j)
        else:
            pairs.append(j * code + i)
        pairs = np.unique(np.concatenate(pairs))
        i, j = np.divmod(pairs, code)
        near = [np.einsum("ij,ij->i", a["unit"][i[k:k + VERIFY]], b["unit"][j[k:k + VERIFY]]) >= least
                for k in range(0, len(i), VERIFY)]
        near = np.concatenate(near or [np.zeros(0, dtype=bool)])
        if a is b:
            near &= i != j
        i, j = i[near], j[near]
        counts = {}
        for own, other, own_side, other_side in ((i, j, a, b), (j, i, b, a))[: 1 if a is b else 2]:
            n = np.bincount(own, weights=other_side["copies"][other], minlength=len(own_side["node"])).astype(np.int64)
            for k in np.flatnonzero(n):
                counts[int(own_side["node"][k])] = int(n[k])
        u, v = forest(a["node"][i], b["node"][j])
        return pa.table({"u": pa.array([*counts, *u.tolist()], pa.int64()),
                         "v": pa.array([None] * len(counts) + v.tolist(), pa.int64()),
                         "n": pa.array([*counts.values(), *[0] * len(u)], pa.int64())})

    return run


def vector_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                  least: float = LEAST_COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per input row: ``id_col, n_links`` (other vectors linked
    directly), ``component_id`` (smallest id reachable), ``kept``."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fit = F.coalesce(whole & F.col("label").isNotNull(), F.lit(False))
    rows = rows.withColumn("fit", fit)
    nodes = stash(rows.where("fit").groupBy("label", "v").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
                  .withColumn("node", F.monotonically_increasing_id())
                  .withColumn("space", F.struct(F.col("label"), F.size("v").alias("d"))), "nodes")
    spaces = nodes.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(spaces, "space").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    space = nodes.schema["space"].dataType.simpleString()
    graphs = stash(dealt.select("space", "shard", "shards", "node", "copies", "v").groupBy("space", "shard")
                   .applyInArrow(_graph, f"space {space}, shard int, shards int, data binary"), "graphs")
    met = graphs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(
        "space", F.least("shard", "other").alias("a"), F.greatest("shard", "other").alias("b"), "shard", "data")
    links = stash(met.groupBy("space", "a", "b").applyInArrow(_links(least), "u long, v long, n long"), "found")

    counts = links.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    member = components(links.where("v is not null").select("u", "v"))
    named = nodes.select("label", "v", "node", "least_id", "copies").join(member, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    # written, so that the join deals both sides by root anew and a large group can be split
    least_of = stash(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = named.join(least_of, "root").join(counts, "node", "left").select(
        "label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.where("fit").select("id", "label", "v").join(named, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
