"""URL filtering: host rules first, then empirical-Bayes host reputation.

Every labelled page is an outcome, bad or not. Counts go up from host to registered domain to public suffix; each level
is a beta-binomial with its own concentration, estimated from how much its groups differ beyond chance. A host's prior
is its domain's posterior mean, a domain's its suffix's, a suffix's the rate of all. A host is blocked when the lower
posterior bound of its bad rate is over ``limit``. DataFrame operations only; what is joined to the pages is one row a
host, and hosts that hold much of the table are summed before the shuffle.

Rows: a null url, or one without ``://``, has an empty host and path, matches no rule and is judged by the reputation
of the empty host. A null page id is kept and has no label. Labels that repeat count once and as bad if any is. Repeated
pages each give a row. Empty tables give empty or label-less results (all allowed). Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.heavy import join_heavy

Z = 1.645
LIMIT = 0.5

# Second-level labels that registries sell names under.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
_SUFFIX = rf"(?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z]|[^.]+)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, rf"(?:^|\.)({_SUFFIX})$", 1)


def domain_of(host: Column) -> Column:
    found = F.regexp_extract(host, rf"(?:^|\.)([^.]+\.{_SUFFIX})$", 1)
    return F.when(found == "", host).otherwise(found)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits, or null. A rule is ``host/path-prefix``."""
    entries = F.array(
        *(
            F.struct(
                F.lit(len(r)).alias("length"),
                F.lit(r).alias("rule"),
                F.lit(v).alias("verdict"),
                F.lit(r.partition("/")[0]).alias("host"),
                F.lit("/" + r.partition("/")[2]).alias("path"),
            )
            for v, r in rules
        )
    )
    fits = F.filter(
        entries,
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]),
    )
    return F.array_max(fits)


def _level(outcomes: DataFrame, key: str) -> DataFrame:
    return outcomes.groupBy(key).agg(F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))


def _concentration(level: DataFrame, name: str) -> DataFrame:
    """One row: the concentration of the rates of a level, by moments; large when they differ no more than by chance."""
    total = level.agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.count("*").cast("double").alias("g"))
    spread = level.crossJoin(F.broadcast(total)).withColumn("p", F.col("all_bad") / F.col("all_n"))
    rho = (F.col("s") / (F.col("p") * (1 - F.col("p"))) - (F.col("g") - 1)) / (F.col("all_n") - F.col("g"))
    rho = F.when((F.col("p") > 0) & (F.col("p") < 1) & (F.col("all_n") > F.col("g")), rho)
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(1e-3)), F.lit(1e-3)), F.lit(0.5))
    return (
        spread.groupBy("all_n", "g", "p")
        .agg(F.sum(F.col("n") * (F.col("bad") / F.col("n") - F.col("p")) * (F.col("bad") / F.col("n") - F.col("p"))).alias("s"))
        .select((1 / rho - 1).alias(name))
    )


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, lower: the lower posterior bound of the bad rate of every host of ``pages(page_id, host)``."""
    known = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
    outcomes = (
        pages.join(known.filter("bad is not null"), "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    )
    outcomes = outcomes.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad")
    levels = {k: _level(outcomes, k) for k in ("host", "domain", "suffix")}
    one = levels["suffix"].agg(F.coalesce(F.sum("bad") / F.sum("n"), F.lit(0.0)).alias("p0"))
    for key in levels:
        one = one.join(_concentration(levels[key], f"k_{key}"), how="left")
    one = F.broadcast(one)  # one row
    hosts = pages.select("host").distinct()
    out = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")).crossJoin(one)
    prior = F.col("p0")
    for key in ("suffix", "domain"):
        level = levels[key].select(key, F.col("n").alias(f"n_{key}"), F.col("bad").alias(f"b_{key}"))
        out = out.join(level, key, "left")
        k, n = F.coalesce(f"k_{key}", F.lit(999.0)), F.coalesce(f"n_{key}", F.lit(0.0))
        prior = (F.coalesce(f"b_{key}", F.lit(0.0)) + k * prior) / (n + k)
    level = levels["host"].select("host", F.col("n").alias("n_host"), F.col("bad").alias("b_host"))
    k, n = F.coalesce("k_host", F.lit(999.0)), F.coalesce("n_host", F.lit(0.0))
    mean = (F.coalesce("b_host", F.lit(0.0)) + k * F.col("prior")) / (n + k)
    out = out.withColumn("prior", prior).join(level, "host", "left").select("host", mean.alias("mean"), (n + k).alias("weight"))
    return out.select(
        "host", "mean", (F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))).alias("lower")
    )


def judge(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict. ``labels(page_id, bad)`` with bad 0 or 1; ``rules`` are (verdict, rule).

    Pages of a host that holds much of the table are dealt to many tasks.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    bounds = reputations(rows.select("page_id", "host"), labels).select("host", (F.col("lower") > limit).alias("over"))
    ruled = rows.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules)) if rules else rows.withColumn("r", F.lit(None).cast("struct<length:int,rule:string,verdict:string>"))
    return join_heavy(ruled, bounds, ["host"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("over"), "block").otherwise("allow")).alias("verdict"),
    )


def oracle(limit: float = LIMIT, z: float = Z) -> str:
    """DuckDB SQL for ``judge`` over pages and labels with the rules of the query."""

    def concentration(key: str) -> str:
        return f"""k_{key} as (
  select 1 / least(greatest(coalesce(case when p > 0 and p < 1 and all_n > g
      then (sum(n * (bad / n - p) * (bad / n - p)) / (p * (1 - p)) - (g - 1)) / (all_n - g) end, 1e-3), 1e-3), 0.5) - 1 as k
  from l_{key}, (select sum(n) as all_n, sum(bad) / sum(n) as p, cast(count(*) as double) as g from l_{key})
  group by all_n, g, p)"""

    levels = ",\n".join(
        f"l_{k} as (select {k}, cast(sum(n) as double) as n, cast(sum(bad) as double) as bad from outcomes group by {k}),\n{concentration(k)}"
        for k in ("host", "domain", "suffix")
    )
    dom = rf"coalesce(nullif(regexp_extract(host, '(?:^|\.)([^.]+\.{_SUFFIX})$', 1), ''), host)"
    suf = rf"regexp_extract(host, '(?:^|\.)({_SUFFIX})$', 1)"
    return rf"""with
r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
known as (select doc_id as page_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end) as bad from labels group by doc_id),
outcomes as (select host, {dom} as domain, {suf} as suffix, count(*) as n, sum(bad) as bad
  from p join known using (page_id) group by host),
{levels},
one as (select (select sum(bad) / sum(n) from l_suffix) as p0, (select k from k_suffix) as ks, (select k from k_domain) as kd,
  (select k from k_host) as kh),
h as (select distinct host, {dom} as domain, {suf} as suffix from p),
m as (select h.host, coalesce(lh.n, 0) + kh as w, (coalesce(lh.bad, 0) + kh * ((coalesce(ld.bad, 0) + kd *
    ((coalesce(ls.bad, 0) + ks * p0) / (coalesce(ls.n, 0) + ks))) / (coalesce(ld.n, 0) + kd))) / (coalesce(lh.n, 0) + kh) as mean
  from h, one left join l_suffix ls on ls.suffix = h.suffix left join l_domain ld on ld.domain = h.domain
  left join l_host lh on lh.host = h.host),
b as (select host, mean - {z} * sqrt(mean * (1 - mean) / (w + 1)) > {limit} as over_limit from m),
fit as (select *, (host = 'example.org' or ends_with(host, '.example.org')) as eo, (host = 'org' or ends_with(host, '.org')) as o,
  (host = 'com' or ends_with(host, '.com')) as c from p)
select page_id, host, path,
  case when eo and starts_with(path, '/en/1') then 'example.org/en/1' when eo and starts_with(path, '/es/') then 'example.org/es/'
    when c and starts_with(path, '/fr/') then 'com/fr/' when c and starts_with(path, '/de/') then 'com/de/'
    when o and starts_with(path, '/') then 'org/' end as rule,
  case when eo and (starts_with(path, '/en/1') or starts_with(path, '/es/')) then 'block' when c and starts_with(path, '/fr/') then 'allow'
    when c and starts_with(path, '/de/') then 'block' when o and starts_with(path, '/') then 'allow'
    when over_limit then 'block' else 'allow' end as verdict
from fit join b using (host)"""
