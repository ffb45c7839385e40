"""Retrieval metrics over rankings ``(query_id, id, rank)`` and grades ``(query_id, id, grade)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RELEVANT = 2


def ranking_scores(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, rr, ndcg) at k, rounded to 1e-6. Recall is 1 where nothing is relevant."""
    top = ranked.filter(F.col("rank") <= k).join(gold, ["query_id", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = lambda rank: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(rank + 1)
    got = top.groupBy("query_id").agg(
        F.sum(F.when(F.col("grade") >= RELEVANT, 1).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("grade") >= RELEVANT, F.col("rank"))).alias("first"),
        F.sum(gain(F.col("rank"))).alias("dcg"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id"))
    ideal = gold.withColumn("rank", place).groupBy("query_id").agg(
        F.sum(F.when(F.col("grade") >= RELEVANT, 1).otherwise(0)).alias("relevant"),
        F.sum(F.when(F.col("rank") <= k, gain(F.col("rank"))).otherwise(0.0)).alias("best"),
    )
    six = lambda c: F.floor(c * 1e6 + 0.5) / 1e6
    joined = ideal.join(got, "query_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    return joined.select(
        "query_id",
        six(F.when(F.col("relevant") == 0, 1.0).otherwise(hits / F.col("relevant"))).alias("recall"),
        six(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"),
        six(F.when(F.col("best") == 0, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("best"))).alias("ndcg"),
    )


def edge_scores(found: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """One row: true and false positives, false negatives, precision and recall to four digits."""
    both = found.select(*key, F.lit(1).alias("f")).distinct().join(gold.select(*key, F.lit(1).alias("g")).distinct(), key, "full")
    n = lambda c: F.count(F.when(c, 1))
    counts = both.agg(
        n(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("tp"), n(F.col("g").isNull()).alias("fp"), n(F.col("f").isNull()).alias("fn")
    )
    four = lambda a, b: F.when(b == 0, 1.0).otherwise(F.floor(a / b * 1e4 + 0.5) / 1e4)
    return counts.select("tp", "fp", "fn", four(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), four(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def gates(recall: float, ndcg: float) -> tuple[float, float]:
    """What a baseline asks of the next release: (recall, ndcg)."""
    return (max(0.8, recall + 0.15) if recall < 0.75 else 0.9), min(1.0, ndcg + 0.08)


def _six(value):
    return F.floor(value * 1e6 + 0.5) / 1e6


def macro_micro(scores: DataFrame) -> DataFrame:
    """One row of ``scores(query_id, hits, relevant)``: the mean of the queries' recall, and the recall of all together."""
    each = F.when(F.col("relevant") == 0, 1.0).otherwise(F.col("hits") / F.col("relevant"))
    both = scores.agg(F.avg(each).alias("macro"), F.sum("hits").alias("h"), F.sum("relevant").alias("r"))
    return both.select(_six(F.col("macro")).alias("macro"), _six(F.when(F.col("r") == 0, 1.0).otherwise(F.col("h") / F.col("r"))).alias("micro"))


def binary_scores(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, ndcg) of ``ranked(query_id, item, rank)`` for ``gold(query_id, target)``, by substring.

    Each target gains once, at the first item that holds it; an item gains for one target only.
    """
    top = ranked.filter(F.col("rank") <= k)
    hit = top.join(gold, "query_id").filter(F.col("item").contains(F.col("target")))
    found = hit.groupBy("query_id").agg(F.count_distinct("target").alias("found"))
    # items in order of rank take the least target that no earlier item took
    pairs = hit.groupBy("query_id", "rank").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    per_query = pairs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "targets"))).alias("items"))
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(0.0).alias("dcg"))

    def step(state, item):
        free = F.array_except(item["targets"], state["taken"])
        gain = F.when(F.size(free) > 0, 1 / F.log2(item["rank"] + 1.0)).otherwise(0.0)
        return F.struct(F.concat(state["taken"], F.slice(free, 1, 1)).alias("taken"), (state["dcg"] + gain).alias("dcg"))

    gained = per_query.select("query_id", F.aggregate("items", start, step)["dcg"].alias("dcg"))
    sizes = gold.groupBy("query_id").agg(F.count_distinct("target").alias("n"))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    joined = sizes.join(found, "query_id", "left").join(gained, "query_id", "left")
    return joined.select("query_id", _six(F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"), _six(F.coalesce("dcg", F.lit(0.0)) / best).alias("ndcg"))
