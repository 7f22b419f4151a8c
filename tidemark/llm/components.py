"""Connected components of links in the DataFrame API, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the least of them. Edges run from larger a to smaller b."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of `edges` (a long, b long; a <> b).

    Each round is two shuffles of the edges and is written to the shared folder. It ends when a round
    changes nothing; a path of length n takes about log n rounds. Nodes without edges are not returned.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = _mark(now)
    while seen[0]:
        now = stored(_small_star(_large_star(now)), "links")
        seen, before = _mark(now), seen
        if seen == before:
            break
    stars = now.groupBy("a").agg(F.min("b").alias("component"))
    return (stars.select(F.col("a").alias("node"), "component")
            .union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    """What tells two sets of distinct edges apart: their number and two sums of hashes."""
    both = [F.sum(F.xxhash64("a", "b", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
    return tuple(edges.agg(F.count("*"), *both).first())
