"""Nodes, edges, set operations, hashing and paging over the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.catalog import query
from strataloom.functions import expr
from strataloom.operators import overlay

NODES_SQL = """(select n_nationkey::bigint as id, 'nation' as kind, n_name as name from nation
 union all select c_custkey, 'customer', c_name from customer union all select s_suppkey, 'supplier', s_name from supplier)"""


def nodes(t):
    """Nations, customers and suppliers as typed nodes."""
    return (
        t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
        .unionByName(t("customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_name").alias("name")))
        .unionByName(t("supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name")))
    )


@query("filter_nodes_by_kind", f"select * from {NODES_SQL} where kind in ('nation', 'supplier') order by kind, name, id limit 60 offset 5")
def filter_nodes_by_kind(t):
    return nodes(t).filter(F.col("kind").isin("nation", "supplier")).orderBy("kind", "name", "id").offset(5).limit(60)


@query("node_file_left_join", "select c_custkey, c_name, n_name as nation from customer left join (select * from nation where n_regionkey <> 2) n on c_nationkey = n_nationkey")
def node_file_left_join(t):
    n = t("nation").filter("n_regionkey <> 2")
    return t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", F.col("n_name").alias("nation"))


@query("edge_endpoint_join", """select o_orderkey, c_name as source, n_name as target from orders join customer on o_custkey = c_custkey
 join nation on c_nationkey = n_nationkey where o_orderstatus = 'F'""")
def edge_endpoint_join(t):
    o = t("orders").filter("o_orderstatus = 'F'").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", F.col("c_name").alias("source"), F.col("n_name").alias("target"))


@query("keyed_union_last_wins", """select id, name, balance from (select *, row_number() over (partition by id order by batch desc) as place from (
 select s_suppkey as id, s_name as name, s_acctbal as balance, 0 as batch from supplier
 union all select c_custkey, c_name, c_acctbal, 1 from customer where c_custkey % 3 = 0)) where place = 1""")
def keyed_union_last_wins(t):
    a = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = t("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return overlay.keyed_union([a, b], ["id"])


@query("changed_and_deleted_paths", """with a as (select source || '/' || (doc_id // 2) as path, sha256(text) as hash from documents where doc_id % 2 = 0),
 b as (select source || '/' || (doc_id // 2) as path, sha256(text) as hash from documents where doc_id % 2 = 1)
 select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'deleted' else 'changed' end as change
 from a full join b on a.path = b.path where a.path is null or b.path is null or a.hash <> b.hash""")
def changed_and_deleted_paths(t):
    from strataloom.sources.files import changes

    d = t("documents").select(F.concat_ws("/", "source", F.floor(F.col("doc_id") / 2)).alias("path"), F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 2).alias("side"))
    return changes(d.filter("side = 0").drop("side"), d.filter("side = 1").drop("side"))


@query("content_hash", "select doc_id, sha256(text) as digest, strlen(text) as bytes from documents")
def content_hash(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


@query("identifier_tokens", r"""select id, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-.#/\\:]+', ' ', 'g'), '\s+', ' ', 'g'))) as words
 from (select p_partkey as id, p_name || '_' || p_brand as name from part union all select c_custkey, c_name || '/' || c_mktsegment from customer)""")
def identifier_tokens(t):
    rows = t("part").select(F.col("p_partkey").alias("id"), F.concat_ws("_", "p_name", "p_brand").alias("name")).unionByName(
        t("customer").select(F.col("c_custkey").alias("id"), F.concat_ws("/", "c_name", "c_mktsegment").alias("name"))
    )
    return rows.select("id", expr.identifier_tokens(F.col("name")).alias("words"))


@query("token_estimate", "select doc_id, greatest(1, ceil(strlen(text) / 3.0))::bigint as tokens from documents")
def token_estimate(t):
    return t("documents").select("doc_id", expr.estimated_tokens(F.col("text")).alias("tokens"))


_WORDS = r"regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[\p{L}\p{N}]+')"


@query("redundancy_tokens", f"select doc_id, len({_WORDS})::bigint as n, list_distinct({_WORDS}).len()::bigint as n_distinct from documents")
def redundancy_tokens(t):
    d = t("documents").select("doc_id", expr.redundancy_tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("shingle_count", f"""select doc_id, case when len(w) < 5 then 0 else len(list_distinct(list_transform(range(1, len(w) - 3),
 lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]))) end::bigint as n from (select doc_id, {_WORDS} as w from documents)""")
def shingle_count(t):
    toks = t("documents").select("doc_id", expr.redundancy_tokens(F.col("text")).alias("toks"))
    return toks.select("doc_id", F.size(expr.shingles(F.col("toks"))).cast("long").alias("n"))


@query("exact_duplicate_groups", "select sha256(text) as digest, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from documents group by 1 having count(*) > 1")
def exact_duplicate_groups(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


@query("orphan_checks", """select 'orders_without_customer' as name, count(*) as n from orders where not exists (select 1 from customer where c_custkey = o_custkey)
 union all select 'lines_without_part', count(*) from lineitem where not exists (select 1 from part where p_partkey = l_partkey and p_size > 25)
 union all select 'customers_without_order', count(*) from customer where not exists (select 1 from orders where o_custkey = c_custkey)""")
def orphan_checks(t):
    def lost(a, b, key, other, name):
        return a.join(b, F.col(key) == F.col(other), "left_anti").agg(F.lit(name).alias("name"), F.count("*").alias("n"))

    return (
        lost(t("orders"), t("customer"), "o_custkey", "c_custkey", "orders_without_customer")
        .unionByName(lost(t("lineitem"), t("part").filter("p_size > 25"), "l_partkey", "p_partkey", "lines_without_part"))
        .unionByName(lost(t("customer"), t("orders"), "c_custkey", "o_custkey", "customers_without_order"))
    )


@query("status_counts", """select 'nodes' as what, count(*) as n from customer union all select 'edges', count(*) from orders union all
 select 'records', count(*) from events union all select 'vectors', count(*) from embeddings union all select 'texts', count(*) from documents""")
def status_counts(t):
    pairs = (("nodes", "customer"), ("edges", "orders"), ("records", "events"), ("vectors", "embeddings"), ("texts", "documents"))
    out = None
    for name, table in pairs:
        one = t(table).agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("state_histogram", """select s.state, coalesce(n, 0) as n from (values ('F'), ('O'), ('P'), ('X')) s(state)
 left join (select o_orderstatus, count(*) as n from orders group by 1) o on o_orderstatus = s.state""")
def state_histogram(t):
    spark = t("orders").sparkSession
    domain = spark.createDataFrame([(s,) for s in "FOPX"], "state string")
    got = t("orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))
    return domain.join(got, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


@query("keyset_page", "select o_orderkey, o_custkey from orders where o_orderkey > 500 order by o_orderkey limit 101")
def keyset_page(t):
    return t("orders").filter("o_orderkey > 500").orderBy("o_orderkey").limit(101).select("o_orderkey", "o_custkey")


@query("offset_page", "select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority, o_totalprice desc, o_orderkey limit 21 offset 40")
def offset_page(t):
    return t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").offset(40).limit(21)


@query("set_digest", "select sha256(string_agg(k, ',' order by k)) as digest from (select n_nationkey || ':' || n_name as k from nation union all select r_regionkey || ':' || r_name from region)")
def set_digest(t):
    from strataloom.operators.records import set_digest as digest

    rows = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")).unionAll(t("region").select("r_regionkey", "r_name"))
    return digest(rows, "key", "value")


@query("cube_rollup", """select l_returnflag, l_linestatus, grouping(l_returnflag)::bigint as g1, grouping(l_linestatus)::bigint as g2, count(*) as n, sum(l_quantity)::double as quantity
 from lineitem group by cube (l_returnflag, l_linestatus)""")
def cube_rollup(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"), F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query("intersect_except", """select 'both' as part, count(*) as n from (select l_suppkey from lineitem where l_returnflag = 'R' intersect select l_suppkey from lineitem where l_returnflag = 'A' and l_quantity > 45)
 union all select 'only_first', count(*) from (select l_partkey from lineitem where l_returnflag = 'R' except select l_partkey from lineitem where l_returnflag = 'A')""")
def intersect_except(t):
    li = t("lineitem")
    r, a = li.filter("l_returnflag = 'R'"), li.filter("l_returnflag = 'A'")
    both = r.select("l_suppkey").intersect(a.filter("l_quantity > 45").select("l_suppkey"))
    first = r.select("l_partkey").subtract(a.select("l_partkey"))
    return both.agg(F.lit("both").alias("part"), F.count("*").alias("n")).unionByName(first.agg(F.lit("only_first").alias("part"), F.count("*").alias("n")))


@query("approx_distinct")
def approx_distinct(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("effective_edges", """with base as (select l_orderkey as src, l_partkey as dst, 'LINE' as kind, 'candidate' as status, max(l_discount) as confidence from lineitem where l_returnflag = 'N' or l_linenumber <= 2 group by 1, 2),
 o as (select l_orderkey as src, l_partkey as dst, 'LINE' as kind, case when l_returnflag = 'R' then 'rejected' else 'resolved' end as status,
   case when l_returnflag = 'R' then 2 else 3 end as r, l_tax as confidence from lineitem where l_returnflag <> 'N'),
 best as (select *, row_number() over (partition by src, dst, kind order by r desc, confidence desc, status desc) as place from o)
 select coalesce(b.src, o.src) as src, coalesce(b.dst, o.dst) as dst, 'LINE' as kind, coalesce(o.status, b.status) as status, coalesce(o.confidence, b.confidence) as confidence,
   case when o.src is null then 'base' else 'overlay' end as origin
 from base b full join (select * from best where place = 1) o on b.src = o.src and b.dst = o.dst""")
def effective_edges(t):
    li = t("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("LINE").alias("kind"), "l_returnflag", "l_linenumber", "l_discount", "l_tax")
    base = li.filter("l_returnflag = 'N' or l_linenumber <= 2").groupBy("src", "dst", "kind").agg(F.lit("candidate").alias("status"), F.max("l_discount").alias("confidence"))
    over = li.filter("l_returnflag <> 'N'").select("src", "dst", "kind", F.when(F.col("l_returnflag") == "R", "rejected").otherwise("resolved").alias("status"), F.col("l_tax").alias("confidence"))
    return overlay.effective_edges(base, over)


@query("effective_nodes", """select s_suppkey as id, coalesce(o.name, s_name) as name, s_nationkey as nation from supplier left join
 (select id, name from (select n_nationkey::bigint as id, n_name as name, row_number() over (partition by n_nationkey order by case when n_regionkey > 2 then 0 else 1 end, n_regionkey desc, n_name) as place from nation)
  where place = 1) o on o.id = s_suppkey""")
def effective_nodes(t):
    base = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    over = t("nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 2, "typed").otherwise("resolved").alias("level"), F.col("n_regionkey").alias("revision"), F.col("n_name").alias("provider")
    )
    return overlay.effective_nodes(base, over, ["name"])


@query("provider_coverage", """select supp, sum(case when l_returnflag = 'A' then 1 else 0 end)::bigint as resolved, sum(case when l_returnflag <> 'R' then 1 else 0 end)::bigint as eligible,
 floor(case when sum(case when l_returnflag <> 'R' then 1 else 0 end) = 0 then 1.0 else sum(case when l_returnflag = 'A' then 1 else 0 end)::double / sum(case when l_returnflag <> 'R' then 1 else 0 end) end * 1e6 + 0.5) / 1e6 as ratio
 from (select l_suppkey as supp, l_returnflag from lineitem) group by supp""")
def provider_coverage(t):
    status = F.when(F.col("l_returnflag") == "A", "resolved").when(F.col("l_returnflag") == "R", "rejected").otherwise("candidate")
    return overlay.coverage(t("lineitem").select(F.col("l_suppkey").alias("supp"), status.alias("status")), "supp")


@query("merged_edges", """select l_suppkey as src, l_partkey % 50 as dst, l_linestatus as kind, max(l_discount) as confidence, max_by(case l_returnflag when 'A' then 'resolved' when 'R' then 'rejected' else 'candidate' end,
 case l_returnflag when 'A' then 3 when 'R' then 2 else 1 end) as status, string_agg(distinct l_returnflag, ',' order by l_returnflag) as evidence from lineitem group by 1, 2, 3""")
def merged_edges(t):
    status = F.when(F.col("l_returnflag") == "A", "resolved").when(F.col("l_returnflag") == "R", "rejected").otherwise("candidate")
    rows = t("lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.col("l_linestatus").alias("kind"), F.col("l_discount").alias("confidence"), status.alias("status"), F.col("l_returnflag").alias("evidence"))
    return overlay.merge_edges(rows)


@query("edge_precision_recall", """select tp, fp, fn, case when tp + fp = 0 then 1.0 else floor(tp / (tp + fp) * 1e4 + 0.5) / 1e4 end as precision, case when tp + fn = 0 then 1.0 else floor(tp / (tp + fn) * 1e4 + 0.5) / 1e4 end as recall
 from (select count(*) filter (where f and g) as tp, count(*) filter (where f and g is null) as fp, count(*) filter (where f is null and g) as fn from
 (select distinct l_orderkey as a, l_suppkey as b, true as f from lineitem where l_returnflag <> 'N') x full join (select distinct l_orderkey as a, l_suppkey as b, true as g from lineitem where l_discount > 0.03) y using (a, b))""")
def edge_precision_recall(t):
    from strataloom.operators.metrics import edge_scores

    li = t("lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b"), "l_returnflag", "l_discount")
    return edge_scores(li.filter("l_returnflag <> 'N'"), li.filter("l_discount > 0.03"), ["a", "b"])
