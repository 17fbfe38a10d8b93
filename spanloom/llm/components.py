"""Connected components of an edge table, distributed but for tables that are small whatever the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = 0) -> DataFrame:
    """Map each node to the smallest node of its component.

    ``edges`` has long columns ``a`` and ``b``; self-links, repeats and either direction are allowed,
    rows with a null end are dropped. Returns ``(node, root)`` for every node that is not itself the
    smallest of its component. An empty table gives an empty result.

    Large-star / small-star rounds: every round replaces the edges by links to the smallest known
    neighbour, first among larger nodes, then among smaller ones, until only stars are left. Minima are
    pre-aggregated before the shuffle, so a hub costs a row per task; the joins are plain inner joins
    whose hot side adaptive execution can split. Each round is checkpointed in the shared folder. At most ``few``
    distinct edges are settled on the driver instead, as rounds of a few rows cost files in every partition.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    e = checkpoint(edges.where("a is not null and b is not null and a <> b").select(lo.alias("lo"), hi.alias("hi")).distinct())
    before = _signature(e)
    if before[0] <= few:
        return _settled(e) if before[0] else e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    for _ in range(max_rounds):
        if not before[0]:
            break
        e = checkpoint(_small_star(_large_star(e)))
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _settled(e: DataFrame) -> DataFrame:
    t = e.toArrow()
    nodes, ends = np.unique(np.concatenate([t.column(c).to_numpy() for c in ("lo", "hi")]), return_inverse=True)
    root, (a, b) = np.arange(len(nodes)), ends.reshape(2, -1)
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return e.sparkSession.createDataFrame(pa.table({"node": nodes[far], "root": nodes[root[far]]}))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return e.withColumnRenamed("lo", "u").join(least, "u").select(F.col("m").alias("lo"), "hi").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    linked = e.join(least, "hi").select("m", F.explode(F.array("hi", "lo")).alias("v"))
    return linked.where("v <> m").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()


def _signature(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]
