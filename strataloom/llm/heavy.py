"""Joins in which one key may hold much of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than this share of the rows, so there are under 1 / SHARE heavy keys.
SHARE = 0.002
SALTS = 64


def join_heavy(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined (inner or left) with ``small``, in which a key has one row or a few.

    Heavy keys of ``big`` are counted first, with partial sums before the shuffle; there are at most 1 / SHARE. Their
    rows are salted, and the few rows of ``small`` for them are repeated for every salt; so are rows with a null key,
    which match nothing. ``big`` is read twice, so it should be a written table or a plain scan. The result has the
    columns ``on``, then those of ``big``, then those of ``small``.
    """
    named = [*on, *(c for c in big.columns if c not in on), *(c for c in small.columns if c not in on)]
    full = F.lit(True)
    for c in on:
        full = full & F.col(c).isNotNull()
    key = F.xxhash64(*on)
    counts = big.filter(full).groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    least = max(1000.0, big.count() * SHARE)
    heavy = [r.k for r in counts.filter(F.col("n") > least).select("k").limit(int(1 / SHARE) + 1).collect()]
    spread = F.pmod(F.xxhash64(*big.columns, F.lit(1)), F.lit(SALTS)).cast("int")
    is_heavy = key.isin(heavy) if heavy else F.lit(False)
    salt = F.when(~full | is_heavy, spread).otherwise(0)
    every = F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return big.withColumn("salt_of_row", salt).join(small.withColumn("salt_of_row", F.explode(every)), [*on, "salt_of_row"], how).select(*named)
