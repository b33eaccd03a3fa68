"""Connected components over an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.session import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Relink the neighbours of each node to the least of them and itself: the greater ones (large) or the smaller ones."""
    hood = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = hood.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    pairs = hood.join(least, "u")
    if large:
        out = pairs.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) longs, in any order, loops allowed -> (node, root): root is the least node of its component.

    Only linked nodes come back. Each round relinks and shrinks the graph towards stars (logarithmically many rounds in practice);
    every round is checkpointed in the shared folder. An empty edge table gives an empty result.
    """
    now = checkpointed(edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if seen == tuple(row) or not row[0]:
            break
        seen = tuple(row)
        now = checkpointed(_star(_star(now, True), False))
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
