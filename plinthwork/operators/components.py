"""Connected components by alternating stars (Kiveris et al., "Connected Components in MapReduce and Beyond").

Each round replaces the edges by stars around smaller neighbours; labels only ever move as aggregated minima
and equi-joins; a hub's minimum is pre-aggregated on the map side. In the joins a hub's edges meet in one partition,
which adaptive execution does not split (the other side is an aggregate), so a hub costs the time of its own edges.
Nothing is collected but one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plinthwork.functions.storage import cut, drop

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component`` for every node that occurs in an edge; the component is its smallest node.

    Edges are undirected; null ends, loops and repeated edges are allowed and change nothing. No edges: an
    empty result. Nodes may be of any orderable type.
    """
    a, b = F.col(left), F.col(right)
    stars = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    seen, kept = None, None
    for _ in range(MAX_ROUNDS):
        state = Observation()
        after = cut(stars, "stars", (state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
        if kept is not None:
            drop(kept)
        kept, now = after, (state.get["n"], state.get["sum"])
        if now == seen or not now[0]:
            break
        seen = now
        stars = _small_star(_large_star(kept))
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = kept.select(F.col("v").alias("node")).distinct()
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
