"""Records over time: expiry, review candidates and decisions, maintenance states, retries, leases, health.

State is never updated in place: each function folds a log into what holds now, so a lost task is just run again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import expr

# Relations by kind of record, seconds between retries, and orders in which failures and candidates count.
RELATIONS = {"decision": "decision_for", "error": "error_in", "procedure": "procedure_for"}
RETRY_SECONDS = [30, 120, 600]
FAILURES = ["material_sticky", "scale_limit", "runtime_retryable", "data_repairable"]
UNSAFE = ["stale", "orphaned", "contradicted", "needs_review"]
STATE_OF_CANDIDATE = {"code_validation": "review_required", "episode_compaction": "review_required", "conflict": "conflict_candidate", "duplicate": "duplicate_candidate"}
STATES = ["review_required", "conflict_candidate", "duplicate_candidate", "clean"]
DECISIONS = {"dismiss": "dismissed", "reject": "rejected", "forget": "forgotten", "relink": "resolved", "compact": "resolved"}


def relation_of(kind: Column) -> Column:
    return expr.looked_up(RELATIONS, kind, "about")


def transitions(records: DataFrame, now: Column) -> DataFrame:
    """(id, kind, prior, next) of ``records(id, state, expires, valid_from, valid_to, maintenance)``.

    Active records whose time is up expire; others that are outside their validity go to review, once.
    """
    active = F.col("state") == "active"
    up = active & (F.col("expires") <= now)
    outside = active & ((F.col("valid_from") > now) | (F.col("valid_to") <= now)) & (F.col("maintenance") != "review_required")
    kind = F.when(up, "expiry").when(outside, "validity")
    found = records.withColumn("kind", kind).filter("kind is not null")
    return found.select(
        "id",
        "kind",
        F.when(F.col("kind") == "expiry", F.col("state")).otherwise(F.col("maintenance")).alias("prior"),
        F.when(F.col("kind") == "expiry", "expired").otherwise("review_required").alias("next"),
    )


def candidate_id(kind: Column, left: Column, right: Column) -> Column:
    """The same for either order of the two."""
    return F.sha2(F.concat_ws("|", kind, F.least(left, right).cast("string"), F.greatest(left, right).cast("string")), 256)


def new_candidates(found: DataFrame, present: DataFrame) -> DataFrame:
    """``found(kind, left, right)`` with their ids, each once, without those of ``present(candidate_id)``."""
    named = found.select(candidate_id(F.col("kind"), F.col("left"), F.col("right")).alias("candidate_id"), "kind", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"))
    return named.distinct().join(present.select("candidate_id"), "candidate_id", "left_anti")


def decided(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """(review, status) of ``reviews(review)`` by the first of ``decisions(review, decision, at, id)``; later ones change nothing."""
    first = decisions.filter(F.col("decision").isin(list(DECISIONS))).groupBy("review").agg(F.min_by("decision", F.struct("at", "id")).alias("decision"))
    return reviews.join(first, "review", "left").select("review", F.coalesce(expr.looked_up(DECISIONS, F.col("decision")), F.lit("pending")).alias("status"))


def maintenance_states(records: DataFrame, validations: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, maintenance) of ``records(id)``: the most urgent of its ``validations(id, state)`` and pending ``candidates(kind, left, right)``."""
    place = lambda state: F.array_position(F.array(*(F.lit(s) for s in STATES)), state)
    unsafe = validations.filter(F.col("state").isin(UNSAFE)).select("id", F.lit(1).cast("long").alias("place"))
    of = place(expr.looked_up(STATE_OF_CANDIDATE, F.col("kind"), "clean")).alias("place")
    both = candidates.select(F.explode(F.array("left", "right")).alias("id"), of)
    worst = unsafe.unionAll(both).groupBy("id").agg(F.min("place").alias("place"))
    state = F.element_at(F.array(*(F.lit(s) for s in STATES)), F.coalesce("place", F.lit(len(STATES))).cast("int"))
    return records.join(worst, "id", "left").select("id", state.alias("maintenance"))


def first_failures(failures: DataFrame) -> DataFrame:
    """(component, failure) of ``failures(component, failure)``: that which counts most; unknown ones count last."""
    place = F.array_position(F.array(*(F.lit(f) for f in FAILURES)), F.col("failure"))
    order = F.struct(F.when(place == 0, len(FAILURES) + 1).otherwise(place).alias("p"), "failure")
    return failures.groupBy("component").agg(F.min_by("failure", order).alias("failure"))


def retry_at(failed: Column, attempts: Column) -> Column:
    """When to try again after so many failures in a row."""
    waits = F.array(*(F.lit(s) for s in RETRY_SECONDS))
    return F.timestamp_seconds(F.unix_seconds(failed.cast("timestamp")) + F.element_at(waits, F.least(F.greatest(attempts, F.lit(1)), F.lit(len(RETRY_SECONDS))).cast("int")))


def granted_claims(claims: DataFrame, seconds: int = 30) -> DataFrame:
    """(job, worker, at, token) of ``claims(job, worker, at)`` that were granted: a lease holds for so long, then it can be taken over.

    Its holder renews it by claiming again; a claim refused changes nothing. A job's claims are read in order of time.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        kept, holder, until = [], None, None
        for i, (worker, at) in enumerate(zip(group["worker"], group["at"], strict=True)):
            if until is None or at >= until or worker == holder:
                kept.append(i)
                holder, until = worker, at + pd.Timedelta(seconds=seconds)
        return group.iloc[kept]

    ordered = claims.select("job", "worker", "at")
    got = ordered.groupBy("job").applyInPandas(lambda g: run(g.sort_values(["at", "worker"])), ordered.schema)
    return got.withColumn("token", F.sha2(F.concat_ws("|", "job", "worker", F.unix_micros(F.col("at").cast("timestamp"))), 256))


def provider_states(log: DataFrame, now: Column, silent_seconds: int) -> DataFrame:
    """(provider, state) from ``log(provider, state, at, id)``: the last state, or abandoned if it runs and was silent too long."""
    last = log.groupBy("provider").agg(F.max_by("state", F.struct("at", "id")).alias("state"), F.max("at").alias("at"))
    silent = F.unix_seconds(now) - F.unix_seconds(F.col("at").cast("timestamp")) > silent_seconds
    return last.select("provider", F.when((F.col("state") == "running") & silent, "abandoned").otherwise(F.col("state")).alias("state"))


def health(log: DataFrame, most_failures: int = 3) -> DataFrame:
    """(component, health) from ``log(component, ok, at, id)``.

    Failures in a row at the end make it degraded, ``most_failures`` of them failed; a success after a failure, recovered.
    """
    order = Window.partitionBy("component").orderBy("at", "id")
    runs = log.withColumn("run", F.sum(F.col("ok").cast("long")).over(order)).withColumn("before", F.lag("ok").over(order))
    last = runs.groupBy("component").agg(F.max_by(F.struct("ok", "run", "before"), F.struct("at", "id")).alias("l"))
    since = runs.join(last, "component").filter("run = l.run and not ok").groupBy("component").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    state = F.when(n >= most_failures, "failed").when(n > 0, "degraded").when(~F.col("l.before"), "recovered").otherwise("healthy")
    return last.join(since, "component", "left").select("component", state.alias("health"))


def coalesced(events: DataFrame, seconds: float) -> DataFrame:
    """(key, batch, started, paths, n): events of a key that follow each other within ``seconds`` are one batch."""
    order = Window.partitionBy("key").orderBy("at", "path")
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    cut = F.when(gap <= int(seconds * 1e6), 0).otherwise(1)
    numbered = events.withColumn("cut", cut).withColumn("batch", F.sum("cut").over(order).cast("long"))
    return numbered.groupBy("key", "batch").agg(F.min("at").alias("started"), F.count_distinct("path").alias("paths"), F.count("*").alias("n"))
