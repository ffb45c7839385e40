"""Matching of endpoints, resolution of names, and containment of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import expr


def unique_match(clients: DataFrame, servers: DataFrame, on: str) -> DataFrame:
    """(client, owners, target, status, confidence) of ``clients(client, side, on)`` and ``servers(owner, side, on)``.

    Only servers of another side count. One owner resolves; several leave the client unresolved with confidence 0.5,
    none with 0.
    """
    owners = servers.groupBy(on, "side").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("least"))
    every = owners.groupBy(on).agg(F.sum("n").alias("all_n"), F.min("least").alias("all_least"), F.collect_list(F.struct("side", "n", "least")).alias("sides"))
    other = F.filter("sides", lambda s: s["side"] != F.col("side"))
    counted = clients.join(every, on, "left").select(
        "client", F.coalesce(F.aggregate(other, F.lit(0).cast("long"), lambda a, s: a + s["n"]), F.lit(0)).cast("long").alias("owners"), F.array_min(F.transform(other, lambda s: s["least"])).alias("least")
    )
    one = F.col("owners") == 1
    return counted.select(
        "client",
        "owners",
        F.when(one, F.col("least")).alias("target"),
        F.when(one, "resolved").otherwise("unresolved").alias("status"),
        F.when(one, 1.0).when(F.col("owners") > 1, 0.5).otherwise(0.0).alias("confidence"),
    )


def fan_out(producers: DataFrame, consumers: DataFrame, on: str) -> DataFrame:
    """Every consumer of another side for each producer; a row with a null consumer where there is none."""
    c = consumers.select(on, F.col("side").alias("other_side"), "consumer")
    return producers.join(c, (producers[on] == c[on]) & (producers["side"] != c["other_side"]), "left").select("producer", producers[on], "consumer")


def innermost(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(point, span): the smallest span of the key that holds the point; later starts, then lesser ids, first."""
    held = points.join(spans, key).filter((F.col("at") >= F.col("first")) & (F.col("at") <= F.col("last")))
    order = Window.partitionBy("point").orderBy(F.col("last") - F.col("first"), F.desc("first"), "span")
    best = held.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return points.select("point").join(best.select("point", "span"), "point", "left")


def unique_names(refs: DataFrame, names: DataFrame) -> DataFrame:
    """(ref, status, target, candidates): a name that one declaration has resolves; else its candidates are listed."""
    known = names.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.array_join(F.array_sort(F.collect_list(F.col("id"))), ",").alias("ids"))
    joined = refs.join(known, "name", "left")
    return joined.select(
        "ref",
        F.when(F.col("n") == 1, "candidate").otherwise("unresolved").alias("status"),
        F.when(F.col("n") == 1, F.col("least")).alias("target"),
        F.when(F.col("n") > 1, F.col("ids")).otherwise("").alias("candidates"),
    )


def resource_nodes(matches: DataFrame) -> DataFrame:
    """Resource nodes with stable ids, one for each distinct (protocol, operation, resource)."""
    key = F.concat_ws(":", F.lit("resource"), "protocol", "operation", "resource")
    return matches.select("protocol", "operation", "resource").distinct().select(F.sha2(key, 256).alias("id"), key.alias("local_key"), "resource")


def longest_prefix(paths: DataFrame, roots: list[str]) -> DataFrame:
    """(id, root): the longest of a short list of roots that the path starts with."""
    fits = F.filter(F.array(*map(F.lit, roots)), lambda r: F.startswith(F.col("path"), r))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))
    return paths.select("id", best["r"].alias("root"))


def relink(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(link, target, confidence): unique content hash 0.95, else unique name 0.85, else unique kind and name 0.65."""
    out = links
    stages = (("hash", ["hash"], 0.95), ("name", ["name"], 0.85), ("kind", ["kind", "name"], 0.65))
    for tag, keys, _ in stages:
        out = out.join(nodes.groupBy(*keys).agg(F.count("*").alias(f"n_{tag}"), F.min("id").alias(f"t_{tag}")), keys, "left")
    target, confidence = F.lit(None).cast("long"), F.lit(0.0)
    for tag, _, c in reversed(stages):
        target = F.when(F.col(f"n_{tag}") == 1, F.col(f"t_{tag}")).otherwise(target)
        confidence = F.when(F.col(f"n_{tag}") == 1, c).otherwise(confidence)
    return out.select("link", target.alias("target"), confidence.alias("confidence"))


def static_paths(pages: DataFrame) -> DataFrame:
    """(page_id, path): literal href paths of ``pages(page_id, html)``."""
    refs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))
    return refs.select("page_id", expr.static_path(F.col("href")).alias("path")).filter("path is not null")


def resolve_aliases(names: DataFrame, aliases: DataFrame, most: int = 8) -> DataFrame:
    """(name, target) of ``names(name)`` through ``aliases(name, target)``, each with one target, in at most ``most`` steps.

    A name that is no alias stands for itself; one that leads into a circle, or further than that, for nothing (null).
    """
    step = aliases.select(F.col("name").alias("now"), F.col("target").alias("next"))
    walk = names.select("name", F.col("name").alias("now"))
    for _ in range(most):
        walk = walk.join(step, "now", "left").select("name", F.coalesce("next", "now").alias("now"))
    return walk.join(step, "now", "left").select("name", F.when(F.col("next").isNull(), F.col("now")).alias("target"))


def resolve_imports(asked: DataFrame, modules: DataFrame, declared: DataFrame, ecosystem: str) -> DataFrame:
    """(specifier, target, how) of ``asked(specifier)``, by the last part of its path.

    The one module of that name (``modules(name, id)``), else the one declaration (``declared(name, id)``), else an external
    module, named by the hash of ecosystem and path. A name that several have decides nothing.
    """
    parts = F.filter(F.split(F.regexp_replace("specifier", r"::\{.*$", ""), "[./:]"), lambda x: x != "")
    path = F.lower(F.regexp_replace(F.regexp_replace("specifier", r"\s+as\s+\w+$", ""), r"::\*$", ""))
    outside = F.sha2(F.concat(F.lit(f"external:{ecosystem}:"), path), 256)
    names = asked.select("specifier").distinct().withColumn("name", F.coalesce(F.get(parts, F.size(parts) - 1), "specifier"))
    sole = lambda t, c: t.groupBy("name").agg(F.min("id").alias(c), F.count("*").alias("n")).filter("n = 1").select("name", F.col(c).cast("string"))
    found = names.join(sole(modules, "m"), "name", "left").join(sole(declared, "d"), "name", "left")
    how = F.when(F.col("m").isNotNull(), "import").when(F.col("d").isNotNull(), "exact").otherwise("external")
    return found.select("specifier", F.coalesce("m", "d", outside).alias("target"), how.alias("how"))
