"""Bounded traversal, closure and impact over edge tables ``(src, dst, kind, status, confidence)``.

A level is one join and one aggregation; depth is at most five, so plans are unrolled and Catalyst sees all of them.
Closures of unknown depth write each frontier to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.runtime import Scratch

CONFIRMED = 0.9


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges with (at, to): where a walk stands and where it goes."""
    out = edges.withColumns({"at": F.col("src"), "to": F.col("dst")})
    back = edges.withColumns({"at": F.col("dst"), "to": F.col("src")})
    return {"out": out, "in": back}.get(direction) or out.unionByName(back.filter("src <> dst"))


def trace(
    edges: DataFrame, starts: DataFrame, direction: str = "both", depth: int = 2, kinds: Sequence[str] | None = None, limit: int | None = None
) -> DataFrame:
    """(start, depth, src, dst, kind, status) of the edges met from ``starts(start)``, level by level.

    A node is expanded once, at its least depth; an edge between two expanded nodes is met from both. Rejected edges are
    reported and not followed. ``limit`` keeps, for each start, the first edges by (depth, kind, source, target).
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth is 1 to 5")
    if direction not in ("in", "out", "both"):
        raise ValueError("direction is in, out or both")
    if kinds is not None:
        edges = edges.filter(F.col("kind").isin(*kinds))
    steps = _directed(edges, direction)
    frontier = starts.select("start", F.col("start").alias("at"))
    visited, levels = frontier, []
    for d in range(1, depth + 1):
        met = frontier.join(steps, "at").select("start", F.lit(d).alias("depth"), "src", "dst", "kind", "status", "to")
        levels.append(met.drop("to"))
        if d < depth:
            reached = met.filter("status <> 'rejected'").select("start", F.col("to").alias("at")).distinct()
            frontier = reached.join(visited, ["start", "at"], "left_anti")
            visited = visited.unionByName(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    if limit is not None:
        order = Window.partitionBy("start").orderBy("depth", "kind", "src", "dst")
        out = out.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("place")
    return out


def closure(edges: DataFrame, seeds: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, depth) of everything that depends on ``seeds(node)``, over edges (src depends on dst), to any depth."""
    scratch = scratch or Scratch(edges.sparkSession)
    back = edges.filter("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct()
    frontier = scratch.cut(seeds.select("node").distinct(), "seeds")
    seen = scratch.cut(frontier.withColumn("depth", F.lit(0).cast("long")), "seen")
    depth = 0
    while True:
        depth += 1
        fresh = frontier.join(back, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = scratch.cut(fresh, "frontier")
        if not frontier.head(1):
            return seen
        seen = scratch.cut(seen.unionByName(frontier.withColumn("depth", F.lit(depth).cast("long"))), "seen")


def impact(edges: DataFrame, starts: DataFrame, direction: str = "in", depth: int = 3) -> DataFrame:
    """(start, node, min_depth, confidence, confirmed) of what a change of each start reaches.

    A path is confirmed if all its edges are resolved with confidence 0.9 or more; its confidence is that of its weakest
    edge. Of several ways to a node a confirmed one goes on, then the more confident; the best confidence is reported.
    """
    steps = _directed(edges.filter("status <> 'rejected'"), direction).select(
        "at", "to", "confidence", ((F.col("status") == "resolved") & (F.col("confidence") >= CONFIRMED)).alias("sure")
    )
    frontier = starts.select("start", F.col("start").alias("at"), F.struct(F.lit(True).alias("confirmed"), F.lit(1.0).alias("confidence")).alias("path"))
    visited = frontier.select("start", "at")
    levels = []
    for d in range(1, depth + 1):
        path = F.struct((F.col("path.confirmed") & F.col("sure")).alias("confirmed"), F.least("path.confidence", "confidence").alias("confidence"))
        met = frontier.join(steps, "at").filter("to <> start").select("start", F.col("to").alias("at"), path.alias("path"))
        best = met.groupBy("start", "at").agg(F.max("path").alias("path"), F.max("path.confidence").alias("top"))
        levels.append(best.withColumn("depth", F.lit(d).cast("long")))
        if d < depth:
            frontier = best.join(visited, ["start", "at"], "left_anti").select("start", "at", "path")
            visited = visited.unionByName(frontier.select("start", "at"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.groupBy("start", F.col("at").alias("node")).agg(
        F.min("depth").alias("min_depth"), F.max("top").alias("confidence"), F.max("path.confirmed").alias("confirmed")
    )
