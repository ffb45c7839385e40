"""Lifecycle, review, retries, health, lookups and orders over the events, conversations and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.catalog import query
from strataloom.functions import expr
from strataloom.operators import lifecycle, metrics, overlay, resolution, search

NOW = "2024-01-20 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


@query("status_fences", """select user_id, coalesce(max(event_id) filter (where event_type in ('purchase', 'signup')), 0)::bigint as success,
 coalesce(max(event_id) filter (where event_type = 'error'), 0)::bigint as failure,
 coalesce(max(event_id) filter (where event_type = 'error'), 0) > coalesce(max(event_id) filter (where event_type in ('purchase', 'signup')), 0) as stale from events group by user_id""")
def status_fences(t):
    top = lambda c: F.coalesce(F.max(F.when(c, F.col("event_id"))), F.lit(0)).cast("long")
    f = t("events").groupBy("user_id").agg(top(F.col("event_type").isin("purchase", "signup")).alias("success"), top(F.col("event_type") == "error").alias("failure"))
    return f.withColumn("stale", F.col("failure") > F.col("success"))


@query("conditional_counts", """select source, count(l.doc_id)::bigint as active, count(*) filter (where toxic = 0)::bigint as eligible, count(*) filter (where quality = 0)::bigint as review_required
 from documents d left join labels l using (doc_id) group by source""")
def conditional_counts(t):
    n = lambda c: F.count(F.when(c, 1))
    d = t("documents").join(t("labels"), "doc_id", "left")
    return d.groupBy("source").agg(n(F.col("toxic").isNotNull()).alias("active"), n(F.col("toxic") == 0).alias("eligible"), n(F.col("quality") == 0).alias("review_required"))


@query("claims_array", """select conv_id, to_json(list({'turn': turn, 'role': role} order by turn))::varchar as claims from conversations group by conv_id""")
def claims_array(t):
    return t("conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role")))).alias("claims"))


@query("record_projection_join", """select c.conv_id, c.turns, coalesce(case when quality = 1 then 'valid' when quality = 0 then 'needs_review' end, 'unlinked') as validation, case when l.doc_id is null then 1.0 else 0.5 end::double as confidence
 from (select conv_id, count(*)::bigint as turns from conversations group by 1) c join (select distinct doc_id from documents) d on c.conv_id = d.doc_id left join labels l on l.doc_id = c.conv_id""")
def record_projection_join(t):
    c = t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    joined = c.join(t("documents").select(F.col("doc_id").alias("conv_id")).distinct(), "conv_id").join(t("labels").select(F.col("doc_id").alias("conv_id"), "quality"), "conv_id", "left")
    state = F.when(F.col("quality") == 1, "valid").when(F.col("quality") == 0, "needs_review").otherwise("unlinked")
    return joined.select("conv_id", "turns", state.alias("validation"), F.when(F.col("quality").isNull(), 1.0).otherwise(0.5).alias("confidence"))


@query("merged_id_streams", """select coalesce(e.vec_id, d.doc_id) as id, e.vec_id is not null as in_vectors, d.doc_id is not null as in_texts from embeddings e full join documents d on e.vec_id = d.doc_id""")
def merged_id_streams(t):
    e, d = t("embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("v")), t("documents").select(F.col("doc_id").alias("id"), F.lit(True).alias("d"))
    return e.join(d, "id", "full").select("id", F.col("v").isNotNull().alias("in_vectors"), F.col("d").isNotNull().alias("in_texts"))


@query("linked_records", "select doc_id, lang from documents where doc_id in (select doc_id from labels where toxic = 1) order by doc_id limit 30")
def linked_records(t):
    return t("documents").join(t("labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang").orderBy("doc_id").limit(30)


@query("stale_vectors", "select vec_id, label from embeddings where vec_id not in (select doc_id from labels where toxic = 0)")
def stale_vectors(t):
    return t("embeddings").join(t("labels").filter("toxic = 0").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti").select("vec_id", "label")


@query("writer_reader_tables", """with e as (select json_extract_string(props, '$.k') as k, user_id % 3 as lang, event_type from events)
 select w.k as resource, w.lang as writer, r.lang as reader from (select distinct k, lang from e where event_type = 'purchase') w join (select distinct k, lang from e where event_type = 'view') r on w.k = r.k and w.lang <> r.lang""")
def writer_reader_tables(t):
    e = t("events").select(F.get_json_object("props", "$.k").alias("resource"), (F.col("user_id") % 3).alias("lang"), "event_type")
    w = e.filter("event_type = 'purchase'").select("resource", F.col("lang").alias("writer")).distinct()
    r = e.filter("event_type = 'view'").select("resource", F.col("lang").alias("reader")).distinct()
    return w.join(r, "resource").filter("writer <> reader")


_ALIAS = "select p_partkey as name, case when p_partkey = 11 then 13 when p_partkey = 13 then 11 when p_partkey % 3 = 0 then p_partkey // 3 else p_partkey // 2 end as target from part where p_partkey > 0 and (p_partkey in (11, 13) or p_partkey % 3 = 0 or p_partkey % 4 = 0)"


@query("alias_chain", f"""with recursive a as ({_ALIAS}), w as (select p_partkey as name, p_partkey as now, 0 as depth from part
 union all select w.name, a.target, depth + 1 from w join a on a.name = w.now where depth < 8),
 e as (select name, max_by(now, depth) as now from w group by name) select e.name, case when a.name is null then now end as target from e left join a on a.name = e.now""")
def alias_chain(t):
    k = F.col("p_partkey")
    target = F.when(k == 11, 13).when(k == 13, 11).when(k % 3 == 0, F.floor(k / 3)).otherwise(F.floor(k / 2)).cast("long")
    aliases = t("part").filter((k > 0) & (k.isin(11, 13) | (k % 3 == 0) | (k % 4 == 0))).select(k.alias("name"), target.alias("target"))
    return resolution.resolve_aliases(t("part").select(k.alias("name")), aliases)


@query("lookup_in_order", """select w.ord, d.doc_id, d.lang from (values (1, 9), (2, 3), (3, 3), (4, 100000000), (5, 0)) w(ord, id) join documents d on d.doc_id = w.id where d.doc_id not in (select doc_id from labels where toxic = 1)""")
def lookup_in_order(t):
    d = t("documents").join(t("labels").filter("toxic = 1"), "doc_id", "left_anti")
    wanted = d.sparkSession.createDataFrame([(1, 9), (2, 3), (3, 3), (4, 100000000), (5, 0)], "ord int, doc_id long")
    return d.join(F.broadcast(wanted), "doc_id").select("ord", "doc_id", "lang").orderBy("ord")  # five stated ids


@query("type_topic_filter", "select event_id, user_id from events where event_type in ('click', 'view') and lower(event_type) = lower('CLICK')")
def type_topic_filter(t):
    return t("events").filter(F.col("event_type").isin("click", "view") & (F.lower("event_type") == F.lower(F.lit("CLICK")))).select("event_id", "user_id")


_KINDS = "case l_linenumber when 1 then 'CONTAINS' when 2 then 'CALLS' when 3 then 'IMPORTS' when 4 then 'REFERENCES' else 'EXPORTS' end"
_INTENT = "case when l_returnflag = 'A' then 'architecture' when l_returnflag = 'R' then 'debugging' else 'implementation' end"


@query("intent_filter", f"""select intent, kind, count(*)::bigint as n from (select {_INTENT} as intent, {_KINDS} as kind from lineitem)
 where case intent when 'architecture' then kind in ('CONTAINS', 'IMPORTS', 'EXTENDS', 'IMPLEMENTS', 'EXPORTS') when 'debugging' then kind in ('CALLS', 'REFERENCES', 'IMPORTS') else true end group by all""")
def intent_filter(t):
    shown = t("lineitem").select(F.expr(_INTENT).alias("intent"), F.expr(_KINDS).alias("kind"))
    return shown.filter(expr.in_intent(F.col("intent"), F.col("kind"))).groupBy("intent", "kind").agg(F.count("*").alias("n"))


_PART_Q = "q(term) as (values ('cold'), ('widget'))"


@query("lexical_score", r"""with q(term) as (values ('cold'), ('widget')), w as (select p_partkey, p_name, p_brand, regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+') as toks from part),
 stats as (select count(*) as n, avg(len(toks)) as avgdl from w), post as (select p_partkey, len(toks) as dl, unnest(toks) as tok from w),
 tf as (select term, p_partkey, dl, count(*) as tf from post join q on tok = term group by all), df as (select term, count(*) as df from tf group by term),
 bm as (select p_partkey, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)))) as s from tf join df using (term), stats group by 1)
 select p_partkey, floor(case when p_name = 'cold widget' then 1.0 when p_brand || '.' || p_name = 'ECONOMY.small widget' then 0.95 else 1 / (1 + abs(s)) end * 1e6 + 0.5)::bigint as score from bm join part using (p_partkey)""")
def lexical_score(t):
    p = t("part")
    asked = p.sparkSession.createDataFrame([("q", "cold"), ("q", "widget")], "query_id string, term string")
    scored = search.bm25(p.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")), asked)
    joined = scored.join(p, F.col("doc_id") == F.col("p_partkey"))
    score = expr.lexical_score(F.col("p_name") == "cold widget", F.concat_ws(".", "p_brand", "p_name") == "ECONOMY.small widget", F.col("score"))
    return joined.select("p_partkey", F.floor(score * 1e6 + 0.5).alias("score"))


@query("locator_ordinals", "select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn)::bigint as ordinal from conversations")
def locator_ordinals(t):
    return t("conversations").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("long").alias("ordinal"))


@query("window_functions", """select event_id, lag(value) over w as before, lead(value, 2) over w as after, ntile(4) over w::bigint as quarter, floor(percent_rank() over w * 1e6 + 0.5)::bigint as place,
 count(*) over (partition by user_id order by event_id range between 500 preceding and current row)::bigint as recent from events window w as (partition by user_id order by event_id)""")
def window_functions(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t("events").select(
        "event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("after"), F.ntile(4).over(w).cast("long").alias("quarter"),
        F.floor(F.percent_rank().over(w) * 1e6 + 0.5).alias("place"), F.count("*").over(w.rangeBetween(-500, 0)).alias("recent"),
    )


@query("topic_order", "select event_id, user_id from events where lower(event_type) = 'purchase' order by floor(value) desc, (user_id % 5 = 0) desc, user_id % 7 desc, ts desc, event_id limit 80")
def topic_order(t):
    e = t("events").filter(F.lower("event_type") == "purchase")
    return e.orderBy(F.desc(F.floor("value")), F.desc(F.col("user_id") % 5 == 0), F.desc(F.col("user_id") % 7), F.desc("ts"), "event_id").select("event_id", "user_id").limit(80)


_STATE = "case o_orderstatus when 'F' then 'valid' when 'O' then 'stale' else 'contradicted' end"


@query("review_order", f"select o_orderkey, {_STATE} as state, o_orderpriority from orders order by case o_orderstatus when 'F' then 1 when 'O' then 5 else 6 end desc, o_orderpriority, o_orderkey limit 100")
def review_order(t):
    rows = t("orders").select("o_orderkey", F.expr(_STATE).alias("state"), "o_orderpriority")
    return rows.orderBy(F.desc(expr.looked_up(expr.SEVERITY, F.col("state"))), "o_orderpriority", "o_orderkey").limit(100)


@query("impact_order", "select l_orderkey, l_linenumber, l_partkey from lineitem order by l_linenumber, l_returnflag = 'A' desc, l_linestatus = 'O' desc, l_partkey, l_orderkey limit 100")
def impact_order(t):
    rows = t("lineitem").orderBy("l_linenumber", F.desc(F.col("l_returnflag") == "A"), F.desc(F.col("l_linestatus") == "O"), "l_partkey", "l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey").limit(100)


@query("union_of_seeds", "select doc_id as id from labels where toxic = 1 union select conv_id from conversations where role = 'user' union select vec_id from embeddings where label = 3")
def union_of_seeds(t):
    ids = lambda df, c: df.select(F.col(c).alias("id"))
    all_ids = ids(t("labels").filter("toxic = 1"), "doc_id").unionAll(ids(t("conversations").filter("role = 'user'"), "conv_id")).unionAll(ids(t("embeddings").filter("label = 3"), "vec_id"))
    return all_ids.distinct()


@query("redacted_messages", r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('GET ' || url || ' failed 12.5.1 for 00ffee1234 at /srv/app/x.py:7', '[A-Za-z]:[\\/]\S+|/(?:[^\s/]+/)+\S*', '<path>', 'g'),
 '(?i)[0-9a-f]{8}-[0-9a-f-]{27,}', '<uuid>', 'g'), '(?i)\b(?:0x)?[0-9a-f]{8,}\b', '<id>', 'g'), '\b[0-9]+(?:\.[0-9]+){0,3}\b', '<n>', 'g'), '\s+', ' ', 'g')) as message from pages""")
def redacted_messages(t):
    text = F.concat(F.lit("GET "), "url", F.lit(" failed 12.5.1 for 00ffee1234 at /srv/app/x.py:7"))
    return t("pages").select("page_id", expr.redacted_error(text).alias("message"))


@query("json_functions", "select event_id, json_extract_string(props, '$.k')::bigint as k, json_valid(props) as valid, len(json_keys(props))::bigint as keys from events")
def json_functions(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$").isNotNull().alias("valid"), F.size(F.json_object_keys("props")).cast("long").alias("keys"))


@query("text_positions", r"select doc_id, strlen(text)::bigint as utf8, length(text)::bigint as points, (length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')))::bigint as utf16 from documents")
def text_positions(t):
    return t("documents").select("doc_id", F.octet_length("text").cast("long").alias("utf8"), F.length("text").cast("long").alias("points"), expr.utf16_units(F.col("text")).cast("long").alias("utf16"))


@query("path_containment", "select page_id, path from (select page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') as path from pages) where path = '/en' or starts_with(path, '/en/')")
def path_containment(t):
    p = t("pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"))
    return p.filter(expr.within_folder(F.col("path"), "/en/"))


@query("plane_relevance_floor", """select query_id, id from (select q.vec_id as query_id, e.vec_id as id, e.label % 2 as plane, list_inner_product(q.embedding::double[], e.embedding::double[]) as s from embeddings e, embeddings q where q.vec_id in (0, 3))
 where not (plane = 1 and s < 0.35) and s > 0.1""")
def plane_relevance_floor(t):
    e = t("embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("label") % 2).alias("plane"))
    q = e.filter(F.col("id").isin(0, 3)).select(F.col("id").alias("query_id"), F.col("embedding").alias("asked"))
    s = e.join(F.broadcast(q)).select("query_id", "id", "plane", expr.dot(F.col("embedding"), F.col("asked")).alias("s"))  # two stated queries
    return s.filter("not (plane = 1 and s < 0.35) and s > 0.1").select("query_id", "id")


@query("link_relations", "select event_id, case event_type when 'error' then 'error_in' when 'signup' then 'decision_for' when 'purchase' then 'procedure_for' else 'about' end as relation from events")
def link_relations(t):
    kind = F.when(F.col("event_type") == "signup", "decision").when(F.col("event_type") == "purchase", "procedure").otherwise(F.col("event_type"))
    return t("events").select("event_id", lifecycle.relation_of(kind).alias("relation"))


_VALIDITY = f"""select event_id as id, case when event_type = 'error' then 'forgotten' else 'active' end as state, case when user_id % 4 = 0 then ts + interval 10 day end as expires, ts as valid_from,
 case when user_id % 3 = 0 then ts + interval 15 day end as valid_to, case when user_id % 5 = 0 then 'review_required' else 'clean' end as maintenance, timestamp '{NOW}' as now from events"""


@query("lifecycle_transitions", f"""select id, kind, case kind when 'expiry' then state else maintenance end as prior, case kind when 'expiry' then 'expired' else 'review_required' end as next from (select *,
 case when state = 'active' and expires <= now then 'expiry' when state = 'active' and (valid_from > now or valid_to <= now) and maintenance <> 'review_required' then 'validity' end as kind from ({_VALIDITY})) where kind is not null""")
def lifecycle_transitions(t):
    u = F.col("user_id")
    rows = t("events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "forgotten").otherwise("active").alias("state"), F.when(u % 4 == 0, F.col("ts") + F.expr("interval 10 days")).alias("expires"),
        F.col("ts").alias("valid_from"), F.when(u % 3 == 0, F.col("ts") + F.expr("interval 15 days")).alias("valid_to"), F.when(u % 5 == 0, "review_required").otherwise("clean").alias("maintenance"),
    )
    return lifecycle.transitions(rows, _now())


_FOUND = "select distinct 'conflict' as kind, least(l_partkey, l_suppkey) as l, greatest(l_partkey, l_suppkey) as r from lineitem where l_quantity > 45"


@query("new_candidates", f"""select kind, l as "left", r as "right", sha256(kind || '|' || l || '|' || r) as candidate_id from ({_FOUND}) where (l + r) % 4 <> 0""")
def new_candidates(t):
    found = t("lineitem").filter("l_quantity > 45").select(F.lit("conflict").alias("kind"), F.col("l_partkey").alias("left"), F.col("l_suppkey").alias("right"))
    present = found.filter("(left + right) % 4 = 0").select(lifecycle.candidate_id(F.col("kind"), F.col("left"), F.col("right")).alias("candidate_id")).distinct()
    return lifecycle.new_candidates(found, present)


_DECISION = "case event_type when 'click' then 'dismiss' when 'error' then 'reject' when 'purchase' then 'relink' else 'none' end"


@query("review_decisions", f"""with d as (select user_id, {_DECISION} as decision, row_number() over (partition by user_id order by ts, event_id) as place from events where {_DECISION} <> 'none' and value > 100)
 select c.c_custkey as review, coalesce(case decision when 'dismiss' then 'dismissed' when 'reject' then 'rejected' when 'relink' then 'resolved' end, 'pending') as status from customer c left join d on d.user_id = c.c_custkey and place = 1""")
def review_decisions(t):
    d = t("events").filter("value > 100").select(F.col("user_id").alias("review"), F.expr(_DECISION).alias("decision"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return lifecycle.decided(t("customer").select(F.col("c_custkey").alias("review")), d)


@query("maintenance_states", """with u as (select doc_id as id, 1 as p from labels where quality = 0 union all select unnest([doc_id, doc_id + 1]) as id, case when doc_id % 3 = 0 then 2 else 3 end from labels where toxic = 1)
 select d.doc_id as id, case coalesce(min(p), 4) when 1 then 'review_required' when 2 then 'conflict_candidate' when 3 then 'duplicate_candidate' else 'clean' end as maintenance from documents d left join u on u.id = d.doc_id group by d.doc_id""")
def maintenance_states(t):
    labels = t("labels")
    validations = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "stale").otherwise("valid").alias("state"))
    kind = F.when(F.col("doc_id") % 3 == 0, "conflict").otherwise("duplicate")
    candidates = labels.filter("toxic = 1").select(kind.alias("kind"), F.col("doc_id").alias("left"), (F.col("doc_id") + 1).alias("right"))
    return lifecycle.maintenance_states(t("documents").select(F.col("doc_id").alias("id")), validations, candidates)


@query("first_failures", """select user_id as component, arg_min(f, p) as failure from (select user_id, case event_type when 'error' then 'runtime_retryable' when 'click' then 'data_repairable' when 'signup' then 'scale_limit' else 'material_sticky' end as f,
 case event_type when 'error' then 3 when 'click' then 4 when 'signup' then 2 else 1 end as p from events where value > 150) group by 1""")
def first_failures(t):
    f = F.when(F.col("event_type") == "error", "runtime_retryable").when(F.col("event_type") == "click", "data_repairable").when(F.col("event_type") == "signup", "scale_limit").otherwise("material_sticky")
    return lifecycle.first_failures(t("events").filter("value > 150").select(F.col("user_id").alias("component"), f.alias("failure")))


@query("retry_times", """select event_id, epoch(date_trunc('second', ts))::bigint + case least(greatest(n, 1), 3) when 1 then 30 when 2 then 120 else 600 end as retry from (select event_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type = 'error')""")
def retry_times(t):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").filter("event_type = 'error'").select("event_id", "ts", n.alias("n")).select("event_id", F.unix_seconds(lifecycle.retry_at(F.col("ts"), F.col("n"))).alias("retry"))


@query("granted_claims")
def granted_claims(t):
    claims = t("events").select((F.col("user_id") % 50).alias("job"), F.col("user_id").alias("worker"), F.col("ts").alias("at"))
    return lifecycle.granted_claims(claims, 3600)


@query("provider_states", f"""select provider, case when state = 'running' and epoch(timestamp '{NOW}') - floor(epoch(seen)) > 864000 then 'abandoned' else state end as state from (select user_id as provider, arg_max(case when event_type in ('view', 'click') then 'running' when event_type = 'error' then 'failed' else 'ready' end, event_id) as state,
 max(ts) as seen from events where ts < timestamp '{NOW}' group by 1)""")
def provider_states(t):
    state = F.when(F.col("event_type").isin("view", "click"), "running").when(F.col("event_type") == "error", "failed").otherwise("ready")
    log = t("events").filter(F.col("ts") < _now()).select(F.col("user_id").alias("provider"), state.alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return lifecycle.provider_states(log, _now(), 864000)


@query("component_health", """with e as (select user_id, event_type <> 'error' as ok, row_number() over (partition by user_id order by ts desc, event_id desc) as back from events),
 a as (select user_id, min(back) filter (where ok) as good, count(*) as n from e group by 1), s as (select user_id, good, n, coalesce(good, n + 1) - 1 as fails from a)
 select s.user_id as component, case when fails >= 3 then 'failed' when fails > 0 then 'degraded' when exists (select 1 from e where e.user_id = s.user_id and back = 2 and not ok) then 'recovered' else 'healthy' end as health from s""")
def component_health(t):
    return lifecycle.health(t("events").select(F.col("user_id").alias("component"), (F.col("event_type") != "error").alias("ok"), F.col("ts").alias("at"), F.col("event_id").alias("id")))


@query("coalesced_events", """with g as (select user_id as key, ts, event_type as path, case when ts - lag(ts) over (partition by user_id order by ts, event_type) <= interval 2 hour then 0 else 1 end as cut from events),
 b as (select *, sum(cut) over (partition by key order by ts, path rows unbounded preceding)::bigint as batch from g) select key, batch, min(ts) as started, count(distinct path)::bigint as paths, count(*)::bigint as n from b group by key, batch""")
def coalesced_events(t):
    return lifecycle.coalesced(t("events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_type").alias("path")), 7200)


_TAGS = "select 'g' || (doc_id % 20) as query_id, source || '/' || lang || '/' || doc_id as item, doc_id from documents"


@query("macro_micro_recall", """with s as (select source, count(*) filter (where quality = 1 and toxic = 0)::bigint as hits, count(*) filter (where toxic = 0)::bigint as relevant from documents join labels using (doc_id) group by source)
 select floor(avg(case when relevant = 0 then 1.0 else hits / relevant end) * 1e6 + 0.5) / 1e6 as macro, floor(sum(hits) / sum(relevant) * 1e6 + 0.5) / 1e6 as micro from s""")
def macro_micro_recall(t):
    n = lambda c: F.count(F.when(c, 1))
    d = t("documents").join(t("labels"), "doc_id").groupBy(F.col("source").alias("query_id"))
    return metrics.macro_micro(d.agg(n((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("hits"), n(F.col("toxic") == 0).alias("relevant")))


@query("binary_ranking_scores", f"""with r as (select *, row_number() over (partition by query_id order by doc_id) as rank from ({_TAGS})), g as (select distinct query_id, lang from (select query_id, split_part(item, '/', 2) as lang from ({_TAGS}))),
 h as (select r.query_id, split_part(item, '/', 2) as lang, min(rank) as rank from r where rank <= 10 group by 1, 2), n as (select query_id, count(*) as n from g group by 1),
 i as (select query_id, (select sum(1 / log2(x + 1)) from range(1, least(n, 10) + 1) t(x)) as best, n from n)
 select query_id, floor(count(h.lang) / any_value(n) * 1e6 + 0.5) / 1e6 as recall, floor(coalesce(sum(1 / log2(h.rank + 1)), 0) / any_value(best) * 1e6 + 0.5) / 1e6 as ndcg from i left join h using (query_id) group by query_id""")
def binary_ranking_scores(t):
    d = t("documents").select(F.concat(F.lit("g"), F.col("doc_id") % 20).alias("query_id"), F.concat_ws("/", "source", "lang", "doc_id").alias("item"), "doc_id", "lang")
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return metrics.binary_scores(ranked.select("query_id", "item", "rank"), d.select("query_id", F.concat(F.lit("/"), "lang", F.lit("/")).alias("target")).distinct(), 10)


@query("import_resolution", """with a as (select distinct regexp_extract(url, '//([^/?#]+)', 1) as specifier from pages), x as (select specifier, regexp_extract(specifier, '([^./:]+)[./:]*$', 1) as name from a)
 select specifier, case name when 'org' then '1' when 'com' then '7' else sha256('external:web:' || lower(specifier)) end as target, case name when 'org' then 'import' when 'com' then 'exact' else 'external' end as how from x""")
def import_resolution(t):
    """Hosts as paths of modules: one suffix is a module, one a declaration, one has two modules and decides nothing."""
    pages = t("pages").select(F.regexp_extract("url", "//([^/?#]+)", 1).alias("specifier"))
    named = lambda rows: pages.sparkSession.createDataFrame(rows, "name string, id long")
    return resolution.resolve_imports(pages, named([("org", 1), ("net", 2), ("net", 3)]), named([("com", 7), ("org", 8)]), "web")


@query("graph_revisions", """with p as (select c_nationkey as provider, c_mktsegment as s, max(c_acctbal) > 0 as held from customer group by 1, 2)
 select n_nationkey as provider, n_regionkey + coalesce(max(case when not held then 1 end), 0) as revision from nation left join p on provider = n_nationkey group by n_nationkey, n_regionkey""")
def graph_revisions(t):
    """Revisions of nations, moved where a segment has customers, but none with a balance above zero."""
    rows = t("customer").select(F.col("c_nationkey").alias("provider"), "c_mktsegment", "c_acctbal")
    states = t("nation").select(F.col("n_nationkey").alias("provider"), F.col("n_regionkey").alias("revision"))
    return overlay.next_revisions(states, rows.filter("c_acctbal > 0").drop("c_acctbal"), rows.drop("c_acctbal"))
