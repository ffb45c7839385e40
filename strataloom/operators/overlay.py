"""Corrections laid over a base graph, and merging of graph batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.expr import looked_up

EDGE = ["src", "dst", "kind"]
# Which status wins.
STATUS_RANK = {"candidate": 1, "rejected": 2, "resolved": 3}


def live_overlay(overlay: DataFrame, providers: DataFrame) -> DataFrame:
    """Overlay rows of providers that are ready or partial and at the same generation and revision."""
    live = providers.filter(F.col("status").isin("ready", "partial")).select("provider", "generation", "revision")
    return overlay.join(live, ["provider", "generation", "revision"], "left_semi")


def effective_edges(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """(src, dst, kind, status, confidence, origin): the higher-ranked status wins, at a tie the overlay."""
    over = overlay.groupBy(*EDGE).agg(
        F.max(F.struct(looked_up(STATUS_RANK, F.col("status")).alias("r"), F.col("confidence"), F.col("status"))).alias("o")
    )
    both = base.select(*EDGE, F.struct(looked_up(STATUS_RANK, F.col("status")).alias("r"), F.col("confidence"), F.col("status")).alias("b"))
    joined = both.join(over, EDGE, "full")
    wins = F.col("b").isNull() | F.coalesce(F.col("o.r") >= F.col("b.r"), F.lit(False))
    return joined.select(
        *EDGE,
        F.when(wins, F.col("o.status")).otherwise(F.col("b.status")).alias("status"),
        F.when(wins, F.col("o.confidence")).otherwise(F.col("b.confidence")).alias("confidence"),
        F.when(wins, "overlay").otherwise("base").alias("origin"),
    )


def effective_nodes(base: DataFrame, overlay: DataFrame, columns: list[str]) -> DataFrame:
    """Base rows with ``columns`` replaced by the strongest overlay: typed before resolved, latest revision, provider."""
    order = Window.partitionBy("id").orderBy(F.when(F.col("level") == "typed", 0).otherwise(1), F.desc("revision"), "provider")
    best = overlay.withColumn("place", F.row_number().over(order)).filter("place = 1")
    best = best.select("id", *(F.col(c).alias(f"over_{c}") for c in columns))
    joined = base.join(best, "id", "left")
    return joined.select(*(F.coalesce(f"over_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def merge_edges(batches: DataFrame) -> DataFrame:
    """One edge a key: greatest confidence, highest-ranked status, distinct evidence in order."""
    rank = looked_up(STATUS_RANK, F.col("status"))
    return batches.groupBy(*EDGE).agg(
        F.max("confidence").alias("confidence"),
        F.max_by("status", rank).alias("status"),
        F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"),
    )


def keyed_union(batches: list[DataFrame], key: list[str]) -> DataFrame:
    """Union by name in which the last batch that has a key wins."""
    rows = batches[0].withColumn("batch", F.lit(0))
    for n, b in enumerate(batches[1:], 1):
        rows = rows.unionByName(b.withColumn("batch", F.lit(n)))
    last = Window.partitionBy(*key).orderBy(F.desc("batch"))
    return rows.withColumn("place", F.row_number().over(last)).filter("place = 1").drop("place", "batch")


def coverage(items: DataFrame, by: str) -> DataFrame:
    """(by, resolved, eligible, ratio) of ``items(by, status)``; 1 where nothing is eligible."""
    got = items.groupBy(by).agg(
        F.sum(F.when(F.col("status") == "resolved", 1).otherwise(0)).alias("resolved"),
        F.sum(F.when(F.col("status") != "rejected", 1).otherwise(0)).alias("eligible"),
    )
    ratio = F.when(F.col("eligible") == 0, 1.0).otherwise(F.col("resolved") / F.col("eligible"))
    return got.withColumn("ratio", F.floor(ratio * 1e6 + 0.5) / 1e6)


def overlay_violations(overlay: DataFrame, nodes: DataFrame, base: DataFrame, generation: int) -> DataFrame:
    """(src, dst, kind, reason) for overlay rows that may not be committed."""
    ids = nodes.select(F.col("id"))
    checks = [
        (overlay.filter(F.col("generation") != generation), "GENERATION"),
        (overlay.filter(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))), "CONFIDENCE"),
        (overlay.join(ids, overlay.src == ids.id, "left_anti"), "SOURCE_MISSING"),
        (overlay.join(ids, overlay.dst == ids.id, "left_anti"), "TARGET_MISSING"),
        (overlay.filter("status = 'rejected'").join(base.filter("status = 'candidate'"), EDGE, "left_anti"), "REJECTS_NOTHING"),
    ]
    out = None
    for rows, reason in checks:
        part = rows.select(*EDGE, F.lit(reason).alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def next_revisions(states: DataFrame, prior: DataFrame, desired: DataFrame) -> DataFrame:
    """(provider, revision) of ``states``, one more where the distinct rows of a provider differ between prior and desired.

    Both tables have ``provider`` and the same further columns; nulls equal nulls. One shuffle compares all columns at once.
    """
    both = prior.withColumn("side", F.lit(1)).unionByName(desired.withColumn("side", F.lit(2)))
    sides = both.groupBy(*prior.columns).agg(F.min("side").alias("least"), F.max("side").alias("most"))
    changed = sides.filter("least = most").select("provider").distinct().withColumn("changed", F.lit(1))
    moved = states.join(changed, "provider", "left")
    return moved.select("provider", (F.col("revision") + F.coalesce("changed", F.lit(0))).alias("revision"))
