"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.storage import discard, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of the edges (a, b: long); component is the smallest node that is reachable.

    Alternating large-star and small-star steps: each is one minimum for a node (pre-aggregated before its shuffle) and
    one join; a hub with many edges is thus never gathered. The number of rounds grows with the logarithm of the
    longest path. Every round ends in a written table, and the one before is deleted.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = stored(pairs, "edges"), None
    for _ in range(rounds):
        before = now
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(star.union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        discard(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
