"""Traversal, closure and impact over the foreign keys as a typed graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.catalog import query
from strataloom.operators import graph

EDGES_SQL = """edges as (select 'nation:' || n_nationkey as src, 'region:' || n_regionkey as dst, 'IN' as kind, 'resolved' as status from nation
 union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN', case when c_custkey % 5 = 0 then 'rejected' else 'resolved' end from customer
 union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN', 'candidate' from supplier
 union all select 'order:' || o_orderkey, 'customer:' || o_custkey, 'BY', 'resolved' from orders)"""


def edges(t):
    def of(df, src, s, dst, d, kind, status):
        return df.select(F.concat(F.lit(src + ":"), F.col(s)).alias("src"), F.concat(F.lit(dst + ":"), F.col(d)).alias("dst"), F.lit(kind).alias("kind"), status.alias("status"))

    c = F.when(F.col("c_custkey") % 5 == 0, "rejected").otherwise("resolved")
    return (
        of(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "IN", F.lit("resolved"))
        .unionByName(of(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "IN", c))
        .unionByName(of(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "IN", F.lit("candidate")))
        .unionByName(of(t("orders"), "order", "o_orderkey", "customer", "o_custkey", "BY", F.lit("resolved")))
    )


def _starts(t, *names):
    return t("nation").sparkSession.createDataFrame([(n,) for n in names], "start string")


def _trace_sql(direction: str, starts: list[str], depth: int, kinds: str = "true") -> str:
    """Levels unrolled: each frontier is what was reached and not visited before."""
    step = {
        "out": "select src as at, dst as nxt, * from k",
        "in": "select dst as at, src as nxt, * from k",
        "both": "select src as at, dst as nxt, * from k union all select dst, src, * from k where src <> dst",
    }[direction]
    values = ", ".join(f"('{s}')" for s in starts)
    parts = [f"with {EDGES_SQL}, k as (select * from edges where {kinds}), steps as ({step}), f0 as (select s as start, s as at from (values {values}) v(s)), v0 as (select * from f0)"]
    for d in range(1, depth + 1):
        parts.append(f"m{d} as (select f.start, {d} as depth, e.src, e.dst, e.kind, e.status, e.nxt from f{d - 1} f join steps e on e.at = f.at)")
        parts.append(f"f{d} as (select distinct start, nxt as at from m{d} m where status <> 'rejected' and not exists (select 1 from v{d - 1} v where v.start = m.start and v.at = m.nxt))")
        parts.append(f"v{d} as (select * from v{d - 1} union all select * from f{d})")
    union = " union all ".join(f"select start, depth, src, dst, kind, status from m{d}" for d in range(1, depth + 1))
    return ", ".join(parts) + " " + union


for _name, _direction, _starts_at, _depth in (
    ("bfs_trace_out", "out", ["order:1", "order:7", "customer:10", "supplier:3"], 3),
    ("bfs_trace_in", "in", ["region:0", "nation:4"], 3),
    ("bfs_trace_both", "both", ["customer:11", "supplier:5"], 2),
):

    @query(_name, _trace_sql(_direction, _starts_at, _depth))
    def bfs(t, direction=_direction, at=tuple(_starts_at), depth=_depth):
        return graph.trace(edges(t), _starts(t, *at), direction, depth)


@query("bfs_limited_kinds", f"""select start, depth, src, dst, kind, status from (select *, row_number() over (partition by start order by depth, kind, src, dst) as place
 from ({_trace_sql('both', ['region:1', 'nation:2'], 3, "kind = 'IN'")})) where place <= 200""")
def bfs_limited_kinds(t):
    return graph.trace(edges(t), _starts(t, "region:1", "nation:2"), "both", 3, kinds=["IN"], limit=200)


@query("reverse_dependency_closure", f"""with recursive {EDGES_SQL}, r(node, depth) as (select 'region:1', 0::bigint union all select e.src, r.depth + 1 from r join edges e on e.dst = r.node and e.src <> e.dst where r.depth < 9)
 select node, min(depth) as depth from r group by node""")
def reverse_dependency_closure(t):
    return graph.closure(edges(t), _starts(t, "region:1").withColumnRenamed("start", "node"))


IMPACT_EDGES_SQL = """e as (select 'o' || l_orderkey as src, 'p' || l_partkey as dst, case when l_returnflag = 'R' then 'rejected' when l_returnflag = 'A' then 'resolved' else 'candidate' end as status, 1 - l_discount as confidence from lineitem
 union all select 'p' || l_partkey, 's' || l_suppkey, 'resolved', 1 - l_tax / 2 from lineitem where l_linenumber = 1)"""


def impact_edges(t):
    li = t("lineitem")
    status = F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "resolved").otherwise("candidate")
    a = li.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), status.alias("status"), (1 - F.col("l_discount")).alias("confidence"))
    b = li.filter("l_linenumber = 1").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("resolved").alias("status"), (1 - F.col("l_tax") / 2).alias("confidence"))
    return a.unionByName(b)


IMPACT_SQL = f"""with {IMPACT_EDGES_SQL}, live as (select *, status = 'resolved' and confidence >= 0.9 as sure from e where status <> 'rejected'),
 m1 as (select v.s as start, l.src as node, l.sure as c, l.confidence as p from (values ('s1'), ('s2')) v(s) join live l on l.dst = v.s),
 b1 as (select start, node, max((c, p)) as path, max(p) as top from m1 group by 1, 2),
 m2 as (select b.start, l.src as node, b.path[1] and l.sure as c, least(b.path[2], l.confidence) as p from b1 b join live l on l.dst = b.node where l.src <> b.start),
 b2 as (select start, node, max((c, p)) as path, max(p) as top from m2 group by 1, 2)
 select start, node, min(depth) as min_depth, max(top) as confidence, bool_or(path[1]) as confirmed from
 (select *, 1::bigint as depth from b1 union all select *, 2::bigint from b2) group by 1, 2"""


@query("impact_confirmed_paths", IMPACT_SQL)
def impact_confirmed_paths(t):
    return graph.impact(impact_edges(t), _starts(t, "s1", "s2"), "in", 2)


@query("impact_summary", f"""select start, count(*) as targets, count(*) filter (where confirmed) as confirmed, count(*) filter (where min_depth = 1) as direct, floor(max(confidence) * 1e6 + 0.5) / 1e6 as best from ({IMPACT_SQL}) group by start""")
def impact_summary(t):
    return graph.impact(impact_edges(t), _starts(t, "s1", "s2"), "in", 2).groupBy("start").agg(
        F.count("*").alias("targets"), F.count(F.when(F.col("confirmed"), 1)).alias("confirmed"), F.count(F.when(F.col("min_depth") == 1, 1)).alias("direct"), (F.floor(F.max("confidence") * 1e6 + 0.5) / 1e6).alias("best")
    )
