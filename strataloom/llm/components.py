"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins; nothing but two counters reaches the driver. Rounds grow with the
logarithm of the longest chain. Every round's links are a written table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.runtime import Scratch

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    ).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links(a, b)`` of one orderable type, any orientation, repeats and self-links allowed.

    Returns ``(node, root)`` for every node in a link between different nodes except the roots themselves; root is the
    least node of the component. Nulls in either column link nothing. An empty table gives an empty table.
    """
    oriented = (
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    now = scratch.cut(oriented, "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        after = scratch.cut(_small_star(_large_star(now)), "stars")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
