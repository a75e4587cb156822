"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

#: Far more rounds than a graph of any size needs; reaching it is an error, never a partial result.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of all nodes in edges (a, b: long).

    Each round points nodes to the smallest node among their neighbours; only minima, pre-aggregated, are taken per
    node, so a node with very many edges is no burden. Rounds are written to the shared folder. Self-loops and
    repeated edges change nothing; rows with a null are left out; without edges there are no rows.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state.n:
            break
        before = state
        # large star: every larger neighbour of a node goes to the smallest of its neighbours and itself
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = now.join(least, now.b == least.node).select("a", F.col("m").alias("b")).where("a <> b")
        # a node's own smallest neighbour stays its neighbour too
        large = large.unionByName(least.where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()
        # small star: smaller neighbours of a node and the node itself go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        old, now = now, materialize(small, "edges")
        discard(old)
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
