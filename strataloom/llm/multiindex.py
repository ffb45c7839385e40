"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are centred, turned by principal axes and by a rotation learnt so that the signs lose least (iterative
quantisation), and their signs are the code. A code is split into 16-bit substrings, each with an index of its own: rows
ordered by substring, and where each value starts. With m substrings and a radius of m * a + b, a query probes all values
within a bits in the first b + 1 indexes and within a - 1 bits in the others; by the pigeonhole principle that meets every
code within the radius in at least one index. What is met
is held to the radius over the whole code, and the rest is ranked by distance in double precision.

The turning is fitted on at most SAMPLE vectors. The radius is the least that keeps, in the sample, TARGET of the nearest
of sample queries; over more rows nearest neighbours only come closer. A query that finds fewer than k searches again
without a radius.

Rows are dealt to index shards by hash of their id, queries to blocks; each shard and block is a task of bounded size that
returns its k best for each query. Nothing but the fitted turning is broadcast.

Rows: vectors that are null, zero or hold null or non-finite components take no part, nor do those whose dimension is not
the most frequent one, nor rows with a null id. Rows that repeat an id are candidates of their own (a query skips only
candidates with its own id), and queries that repeat an id answer once. Empty tables give no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.vectors import matrix, usable
from strataloom.runtime import Scratch

SAMPLE, SAMPLE_QUERIES, TARGET = 8000, 200, 0.985
SHARD, BLOCK = 8192, 32_768
BITS = 16


@dataclass
class Codes:
    """The fitted turning: a mean, and axes as columns."""

    mean: np.ndarray
    axes: np.ndarray

    @property
    def parts(self) -> int:
        return -(-self.axes.shape[1] // BITS)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        signs = (x - self.mean) @ self.axes > 0
        pad = self.parts * BITS - signs.shape[1]
        return np.packbits(np.pad(signs, ((0, 0), (0, pad))), axis=1).view(np.uint16).reshape(len(x), self.parts)


def fit_codes(x: np.ndarray, seed: int = 0, rounds: int = 30) -> Codes:
    """Principal axes, and the rotation of them that brings the rows nearest to their signs."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    v = centred @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1],) * 2))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (left @ right).T
    return Codes(mean, axes @ turn)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def fit_radius(codes: Codes, x: np.ndarray, k: int, target: float = TARGET, queries: int = SAMPLE_QUERIES) -> int:
    """The least radius that holds ``target`` of the k nearest of some rows among all rows of the sample."""
    if len(x) < 2:
        return codes.parts * BITS
    own = codes.of(x)
    needed = []
    for i in np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int):
        far = ((x - x[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        best = np.argpartition(far, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        needed.append(hamming(own[best], own[i]))
    return int(np.quantile(np.concatenate(needed), target, method="higher"))


class MultiIndex:
    """The substring indexes of some codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in codes.T]
        self.starts = [np.concatenate(([0], np.cumsum(np.bincount(c, minlength=1 << BITS)))) for c in codes.T]
        self._masks: dict[int, np.ndarray] = {}

    def masks(self, radius: int) -> np.ndarray:
        """All substrings of at most ``radius`` set bits."""
        if radius not in self._masks:
            some = [sum(1 << b for b in bits) for r in range(min(radius, BITS) + 1) for bits in combinations(range(BITS), r)]
            self._masks[radius] = np.array(some, np.int64)
        return self._masks[radius]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs from ``code`` in at most ``radius`` bits."""
        met = np.zeros(len(self.codes), bool)
        each, over = divmod(radius, self.codes.shape[1])
        for part, (order, starts) in enumerate(zip(self.order, self.starts, strict=True)):
            allowed = each if part <= over else each - 1
            if allowed < 0:
                break
            values = np.int64(code[part]) ^ self.masks(allowed)
            low, n = starts[values], starts[values + 1] - starts[values]
            low, n = low[n > 0], n[n > 0]
            at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else n
            met[order[at]] = True
        rows = np.flatnonzero(met)
        return rows[hamming(self.codes[rows], code) <= radius]


def _answer(codes: Codes, radius: int | None, k: int):
    schema = ["query_id", "vec_id", "score"]

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and rows.num_rows:
            x, ids = matrix(rows.column("vector")).astype(np.float64), rows.column("id").to_numpy()
            index = MultiIndex(codes.of(x)) if radius is not None else None
            asked = matrix(queries.column("vector")).astype(np.float64)
            for q, code, own in zip(asked, codes.of(asked), queries.column("id").to_numpy(), strict=True):
                near = index.within(code, radius) if index else np.arange(len(x))
                near = near[ids[near] != own]
                score = np.sqrt(((x[near] - q) ** 2).sum(axis=1))
                if len(near) > k:
                    limit = np.partition(score, k - 1)[k - 1]
                    near, score = near[score <= limit], score[score <= limit]
                best = np.lexsort((ids[near], score))[:k]
                out.append((np.full(len(best), own), ids[near[best]], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.empty(0)] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=schema)

    return run


def _search(queries: DataFrame, rows: DataFrame, shards: int, blocks: int, codes: Codes, radius: int | None, k: int) -> DataFrame:
    """The k best in each shard for each query, then over shards."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))
    index = rows.select("id", "vector", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    got = (
        asked.groupBy("shard", "block")
        .cogroup(index.groupBy("shard", "block"))
        .applyInArrow(_answer(codes, radius, k), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scratch: Scratch | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest found of each row for which ``is_query``."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark)
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), is_query.alias("asks"))
    good = scratch.cut(named.filter(usable(F.col("vector")) & F.col("id").isNotNull()), "vectors")
    dims = good.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dims is None:
        return empty
    good = good.filter(F.size("vector") == dims.dim)
    queries = good.filter("asks").dropDuplicates(["id"]).select("id", "vector")
    blocks = max(1, -(-queries.count() // BLOCK))
    shards = max(1, -(-dims.n // SHARD))
    some = good.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, dims.n // SAMPLE))) == 0)
    sample = matrix(some.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow().column("vector"))
    sample = sample.astype(np.float64) if len(sample) else np.zeros((1, dims.dim))
    codes = fit_codes(sample)
    radius = fit_radius(codes, sample, k)
    found = scratch.cut(_search(queries, good, shards, blocks, codes, radius, k), "found")
    short = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
    again = scratch.cut(queries.join(short, "id", "left_anti"), "again")
    if again.head(1):
        rest = _search(again, good, shards, blocks, codes, None, k)
        found = found.join(again.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
