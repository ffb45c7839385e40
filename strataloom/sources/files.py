"""Scanning of file trees and detection of changes."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import expr

MOST_BYTES = 2 * 1024 * 1024
# What is never scanned.
EXCLUDED = [".git/", "node_modules/", "dist/", "build/", "out/", "coverage/", ".next/", ".turbo/", ".cache/", "*.min.js", "*.map"]
# Files and folders that hold secrets.
SECRET_STARTS = [".env"]
SECRET_ENDINGS = [".pem", ".key", ".p12", ".pfx", ".jks"]
SECRET_NAMES = ["credential", "credentials", "secret", "secrets"]


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether ignore rules (``dir/``, ``*.ext``, ``/rooted``, later ``!kept`` ones win) leave a relative path out."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.lstrip("!")
        body = "(?:[^/]*/)*".join(fnmatch.translate(p)[4:-3].replace(".*", "[^/]*") for p in rule.strip("/").split("**/"))
        start = "^" if "/" in rule.rstrip("/") else "(^|/)"
        end = "/" if rule.endswith("/") else "(/|$)"
        out = F.when(path.rlike(start + body + end), not keep).otherwise(out)
    return out


def secret(path: Column) -> Column:
    """Whether a file or folder of a relative path is named like one that holds secrets."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    env = [(name == s) | name.startswith(s + ".") for s in SECRET_STARTS]
    ending = [name.endswith(e) for e in SECRET_ENDINGS]
    named = F.exists(parts, lambda p: F.split(p, r"\.")[0].isin(SECRET_NAMES))
    return reduce(lambda a, b: a | b, [*env, *ending, named])


def path_key(path: Column, case_sensitive: bool = True) -> Column:
    plain = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")
    return plain if case_sensitive else F.lower(plain)


def scan(spark: SparkSession, root: str, rules: list[str] | None = None, most_bytes: int = MOST_BYTES, content: bool = True) -> DataFrame:
    """(path, language, size, modified, hash, content) of the source files under ``root``; metadata only without content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file:").lstrip("/") + "/"
    full = F.regexp_replace("path", r"^[a-z0-9]+:/*", "")
    path = F.when(full.startswith(base), F.substring(full, F.lit(len(base) + 1), F.length(full))).otherwise(full)
    found = raw.withColumn("path", path_key(path)).withColumn("language", expr.language_of(F.col("path")))
    found = found.filter(F.col("language").isNotNull() & (F.col("length") <= most_bytes) & ~secret(F.col("path")))
    found = found.filter(~ignored(F.col("path"), [*EXCLUDED, *(rules or [])]))
    columns = ["path", "language", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if content:
        columns += [F.sha2("content", 256).alias("hash"), F.col("content").cast("string").alias("content")]
    return found.select(*columns)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of added, deleted and changed paths of two ``(path, hash)`` tables."""
    b, a = before.select("path", F.col("hash").alias("old")), after.select("path", F.col("hash").alias("new"))
    joined = b.join(a, "path", "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    return joined.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("changed").alias("change"))


def snippet(files: DataFrame, wanted: DataFrame, around: int = 2, most: int = 4000) -> DataFrame:
    """(id, snippet) of lines of ``files(path, hash, content)`` for ``wanted(id, path, hash, first, last)``; null if changed."""
    lines = F.split("content", "\r?\n")
    low = F.greatest(F.col("first") - around, F.lit(1))
    cut = F.array_join(F.slice(lines, low, F.col("last") + around - low + 1), "\n")
    return wanted.join(files.select("path", "hash", "content"), ["path", "hash"], "left").select("id", expr.clamp_text(cut, most).alias("snippet"))
