"""Time-bounded records, links, endpoints and name resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.catalog import query
from strataloom.functions import expr
from strataloom.operators import records as rec
from strataloom.operators import resolution as res

NOW = "2024-01-20 00:00:00"


def _ts(t):
    return t("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("temporal_eligibility", f"""select event_id, case when event_type = 'signup' then 'LIFECYCLE_INACTIVE' when ts + interval 10 day <= timestamp '{NOW}' then 'LIFECYCLE_EXPIRED' when ts > timestamp '{NOW}' then 'NOT_YET_VALID'
 when value > 50 and timestamp '{NOW}' >= ts + interval 5 day then 'VALIDITY_ENDED' when user_id % 11 = 0 then 'ASSERTION_REJECTED' when user_id % 7 = 0 then 'VALIDATION_STALE' when user_id % 5 = 0 then 'MAINTENANCE_REVIEW_REQUIRED' end as reason from events""")
def temporal_eligibility(t):
    e, now = _ts(t), F.lit(NOW).cast("timestamp")
    reason = expr.ineligible_reason(
        F.when(F.col("event_type") == "signup", "archived").otherwise("active"),
        F.col("ts") + F.expr("interval 10 days"),
        F.col("ts"),
        F.when(F.col("value") > 50, F.col("ts") + F.expr("interval 5 days")),
        F.when(F.col("user_id") % 11 == 0, "rejected").otherwise("observed"),
        F.when(F.col("user_id") % 7 == 0, "stale").otherwise("valid"),
        F.when(F.col("user_id") % 5 == 0, "review_required").otherwise("clean"),
        now,
    )
    return e.select("event_id", reason.alias("reason"))


@query("excluded_counts", f"""select reason, count(*) as n from (select case when ts + interval 10 day <= timestamp '{NOW}' then 'LIFECYCLE_EXPIRED' when ts > timestamp '{NOW}' then 'NOT_YET_VALID' end as reason from events) where reason is not null group by 1""")
def excluded_counts(t):
    none, now = F.lit(None).cast("timestamp"), F.lit(NOW).cast("timestamp")
    reason = expr.ineligible_reason(F.lit("active"), F.col("ts") + F.expr("interval 10 days"), F.col("ts"), none, F.lit("observed"), F.lit("valid"), F.lit("clean"), now)
    return _ts(t).select(reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query("interval_overlap_pairs", """with e as (select * from events where value > 60) select l.event_id as "left", r.event_id as "right" from e l join e r on l.user_id = r.user_id and l.event_type = r.event_type and l.event_id < r.event_id
 and r.ts < l.ts + interval 2 day and (r.value > 90 or l.ts < r.ts + interval 2 day) and (l.value <= 90 or true) where l.value <= 90""")
def interval_overlap_pairs(t):
    end = F.when(F.col("value") <= 90, F.col("ts") + F.expr("interval 2 days"))
    e = _ts(t).filter("value > 60").select(F.col("event_id").alias("id"), "user_id", "event_type", F.col("ts").alias("valid_from"), end.alias("valid_to"))
    pairs = rec.interval_pairs(e, ["user_id", "event_type"])
    return pairs.join(e.filter("valid_to is not null").select(F.col("id").alias("left")), "left", "left_semi").select("left", "right")


@query("utility_score", f"""select event_id, case when user_id % 11 = 0 then 0 else greatest(0, least(1000, (1 + user_id % 5) * 120 + case when user_id % 11 = 0 then -1000 when user_id % 3 = 0 then 180 else 100 end
 + case when user_id % 13 = 0 then 160 else 0 end + case event_type when 'purchase' then 100 when 'click' then 60 when 'error' then 30 else 0 end + least(100, (event_id % 40) * 5)
 + case when user_id % 7 = 0 then -350 else 120 end - greatest(0, floor(epoch(timestamp '2024-09-01' - ts) / 2592000))::bigint * case when user_id % 13 = 0 then 5 when event_type = 'purchase' then 10 when event_type = 'click' then 20 else 40 end)) end::bigint as utility from events""")
def utility_score(t):
    kind = F.when(F.col("event_type") == "purchase", "decision").when(F.col("event_type") == "click", "fact").when(F.col("event_type") == "error", "error").otherwise("episode")
    score = expr.utility(
        1 + F.col("user_id") % 5,
        F.when(F.col("user_id") % 11 == 0, "rejected").when(F.col("user_id") % 3 == 0, "verified").otherwise("observed"),
        kind,
        F.when(F.col("user_id") % 7 == 0, "stale").otherwise("valid"),
        F.col("user_id") % 13 == 0,
        F.col("event_id") % 40,
        F.col("ts"),
        F.lit("2024-09-01").cast("timestamp"),
    )
    return _ts(t).select("event_id", score.alias("utility"))


_STATE = "case when l_returnflag = 'R' then 'contradicted' when l_linestatus = 'O' then 'valid' else 'stale' end"


@query("validation_summary", f"""select l_orderkey as record, count(*) as links, max_by({_STATE}, case when l_returnflag = 'R' then 6 when l_linestatus = 'O' then 1 else 5 end) as state, min(1 - l_discount) as confidence from lineitem group by 1""")
def validation_summary(t):
    state = F.when(F.col("l_returnflag") == "R", "contradicted").when(F.col("l_linestatus") == "O", "valid").otherwise("stale")
    return rec.validation_summary(t("lineitem").select(F.col("l_orderkey").alias("record"), state.alias("state"), (1 - F.col("l_discount")).alias("confidence")))


_NODES = "n as (select s_suppkey as id, 'k' || s_suppkey as local_key, 'supplier' as kind, 'n' || s_nationkey as name, 'q' || s_suppkey % 40 as qualified, 'g' || s_nationkey % 3 as signature, 'h' || s_suppkey % 60 as hash from supplier)"
_LINKS = "l as (select s_suppkey as link, case when s_suppkey % 3 = 0 then 'gone' else 'k' || s_suppkey end as local_key, 'supplier' as kind, 'n' || s_nationkey as name, 'q' || s_suppkey % 40 as qualified, 'g' || s_nationkey % 3 as signature, 'h' || s_suppkey % 61 as hash from supplier)"


def _links_nodes(t):
    s = t("supplier")
    c = lambda p, v: F.concat(F.lit(p), v.cast("string"))
    key, nat = F.col("s_suppkey"), F.col("s_nationkey")
    nodes = s.select(key.alias("id"), c("k", key).alias("local_key"), F.lit("supplier").alias("kind"), c("n", nat).alias("name"), c("q", key % 40).alias("qualified"), c("g", nat % 3).alias("signature"), c("h", key % 60).alias("hash"))
    gone = F.when(key % 3 == 0, "gone").otherwise(c("k", key))
    links = s.select(key.alias("link"), gone.alias("local_key"), F.lit("supplier").alias("kind"), c("n", nat).alias("name"), c("q", key % 40).alias("qualified"), c("g", nat % 3).alias("signature"), c("h", key % 61).alias("hash"))
    return links, nodes


def _stage(n: int, on: str) -> str:
    return f"s{n} as (select link, count(*) as c, min(id) as t from l join n on l.kind = n.kind and {on} group by 1)"


@query("link_target_stages", f"""with {_NODES}, {_LINKS}, {_stage(0, 'l.local_key = n.local_key')}, {_stage(1, 'l.name = n.name and l.hash = n.hash')}, {_stage(2, 'l.qualified = n.qualified')}, {_stage(3, 'l.signature = n.signature and l.name = n.name')},
 x as (select l.link, l.hash, case when s0.c = 1 then 'exact' when s0.c > 1 then 'ambiguous' when s1.c = 1 then 'relocated' when s1.c > 1 then 'ambiguous' when s2.c = 1 then 'relocated' when s2.c > 1 then 'ambiguous'
   when s3.c = 1 then 'relocated' when s3.c > 1 then 'ambiguous' else 'missing' end as selection, case when s0.c is not null then case when s0.c = 1 then s0.t end when s1.c is not null then case when s1.c = 1 then s1.t end
   when s2.c is not null then case when s2.c = 1 then s2.t end when s3.c = 1 then s3.t end as target from l left join s0 using (link) left join s1 using (link) left join s2 using (link) left join s3 using (link))
 select link, selection, target, case when selection = 'ambiguous' then 'needs_review' when selection = 'missing' then 'orphaned' when selection = 'relocated' and x.hash = n.hash then 'relocated' when x.hash = n.hash then 'valid' else 'stale' end as state,
  case when selection = 'ambiguous' then 0.5 when selection = 'missing' then 0 when selection = 'relocated' and x.hash = n.hash then 0.95 when x.hash = n.hash then 1 else 0.65 end::double as confidence from x left join n on n.id = target""")
def link_target_stages(t):
    links, nodes = _links_nodes(t)
    found = rec.relocated(links, nodes).join(nodes.select(F.col("id").alias("target"), F.col("hash").alias("observed")), "target", "left")
    state, confidence = rec.link_decision(F.col("selection"), F.col("expected"), F.col("observed"))
    return found.select("link", "selection", "target", state.alias("state"), confidence.alias("confidence"))


@query("relink_cascade", f"""with {_NODES}, {_LINKS}, a as (select hash, count(*) as c, min(id) as t from n group by 1), b as (select name, count(*) as c, min(id) as t from n group by 1), d as (select kind, name, count(*) as c, min(id) as t from n group by 1, 2)
 select link, case when a.c = 1 then a.t when b.c = 1 then b.t when d.c = 1 then d.t end as target, case when a.c = 1 then 0.95 when b.c = 1 then 0.85 when d.c = 1 then 0.65 else 0 end::double as confidence
 from l left join a using (hash) left join b on b.name = l.name left join d on d.kind = l.kind and d.name = l.name""")
def relink_cascade(t):
    links, nodes = _links_nodes(t)
    return res.relink(links, nodes)


@query("conflict_pairs", """with e as (select event_id as id, user_id || ':' || event_type as claim, floor(value / 10)::bigint as value, ts as f, ts + interval 1 day as u from events)
 select l.id as "left", r.id as "right" from e l join e r on l.claim = r.claim and l.id < r.id and l.value <> r.value and r.f < l.u and l.f < r.u""")
def conflict_pairs(t):
    claim = F.concat_ws(":", "user_id", "event_type")
    return rec.conflicts(_ts(t).select(F.col("event_id").alias("id"), claim.alias("claim"), F.floor(F.col("value") / 10).alias("value"), F.col("ts").alias("valid_from"), (F.col("ts") + F.expr("interval 1 day")).alias("valid_to")))


@query("episode_compaction", """select conv_id as session, role as topic, count(*) as n, min(turn) as first_at, max(turn) as last_at, min_by(substr(text, 1, 120), turn) as preview from conversations group by 1, 2 having count(*) >= 2""")
def episode_compaction(t):
    return rec.episodes(t("conversations").select(F.col("conv_id").alias("session"), F.col("role").alias("topic"), F.col("turn").alias("at"), F.col("text").alias("content")))


@query("access_counts", "select user_id, count(*) filter (where event_type = 'view') as views, count(distinct event_type) as kinds, max(ts) as last_ts from events group by 1")
def access_counts(t):
    return t("events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "view", 1)).alias("views"), F.count_distinct("event_type").alias("kinds"), F.max("ts").alias("last_ts"))


_KIND = "case event_type when 'signup' then 'created' when 'purchase' then 'superseded' when 'error' then 'forgotten' else 'accessed' end"


@query("state_fold", f"""select user_id as record, case k when 'created' then 'active' else k end as state, access_count, last_access from (select user_id, arg_max({_KIND}, (ts, event_id)) filter (where event_type in ('signup', 'purchase', 'error')) as k,
 count(*) filter (where event_type in ('click', 'view')) as access_count, max(ts) filter (where event_type in ('click', 'view')) as last_access from events group by 1)""")
def state_fold(t):
    return rec.folded(events_as_log(t("events")))


def events_as_log(events):
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "purchase", "superseded").when(F.col("event_type") == "error", "forgotten").otherwise("accessed")
    return events.select(F.col("user_id").alias("record"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"))


@query("related_neighbours", """with l as (select a.user_id as a, b.user_id as b from events a join events b on a.event_id + 1 = b.event_id and a.user_id <> b.user_id), s as (select distinct user_id as id from events where user_id % 50 = 1)
 select distinct x as id from (select a as y, b as x from l union all select b, a from l) where y in (select id from s) and x not in (select id from s)""")
def related_neighbours(t):
    a, b = t("events").select("event_id", F.col("user_id").alias("a")), t("events").select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("b"))
    links = a.join(b, "event_id").filter("a <> b").select("a", "b")
    return rec.neighbours(links, t("events").filter("user_id % 50 = 1").select(F.col("user_id").alias("id")).distinct())


@query("last_events_per_memory", "select user_id as record, event_id as seq, place from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events) where place <= 5")
def last_events_per_memory(t):
    found = rec.last_events(t("events").select(F.col("user_id").alias("record"), F.col("event_id").alias("seq"), "ts"))
    return found.select("record", "seq", F.col("place").cast("long").alias("place"))


@query("remember_new", """with old as (select distinct sha256(concat_ws(chr(0), role, lower(trim(conv_id::varchar)), trim(text))) as h from conversations where conv_id % 2 = 0),
 d as (select conv_id * 1000 + turn as id, sha256(concat_ws(chr(0), role, lower(trim((conv_id - conv_id % 2)::varchar)), trim(text))) as h from conversations where conv_id % 2 = 1) select min(id) as id, h as content_hash from d where h not in (select h from old) group by h""")
def remember_new(t):
    c = t("conversations")
    old = c.filter("conv_id % 2 = 0").select(rec.content_hash(F.col("role"), F.col("conv_id").cast("string"), F.col("text")).alias("content_hash"), F.lit("active").alias("state"))
    topic = (F.col("conv_id") - F.col("conv_id") % 2).cast("string")
    drafts = c.filter("conv_id % 2 = 1").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), rec.content_hash(F.col("role"), topic, F.col("text")).alias("content_hash"))
    return rec.remember(old, drafts).select("id", "content_hash")


# pages: links and paths

_PATH = r"""case when h = '' or starts_with(h, '//') or regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') or contains(h, '\') or regexp_matches(h, '\$\{|[{}<>*]') or not starts_with(b, '/') or regexp_matches(b, '(^|/):[^/]+') then null
 when s = '' then '/' else s end"""
_HREFS = r"""hrefs as (select page_id, {path} as path from (select *, case when length(z) > 1 then regexp_replace(z, '/+$', '') else z end as s from (select *, regexp_replace(b, '/{{2,}}', '/', 'g') as z from
 (select *, regexp_extract(h, '^[^?#]*') as b from (select page_id, trim(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1))) as h from pages)))))""".format(path=_PATH)


@query("endpoint_extract", f"with {_HREFS} select page_id, path from hrefs where path is not null")
def endpoint_extract(t):
    return res.static_paths(t("pages").select("page_id", "html"))


_SIDES = f"""{_HREFS}, c as (select page_id as client, page_id % 3 as side, path from hrefs where path is not null), s as (select distinct page_id as owner, page_id % 3 as side, path from hrefs where path is not null and page_id % 4 = 0)"""


@query("endpoint_match_unique", f"""with {_SIDES} select client, path, owners, case when owners = 1 then least end as target, case when owners = 1 then 'resolved' else 'unresolved' end as status, case when owners = 1 then 1 when owners > 1 then 0.5 else 0 end::double as confidence from
 (select c.client, c.path, count(distinct s.owner) as owners, min(s.owner) as least from (select distinct * from c) c left join s on s.path = c.path and s.side <> c.side group by 1, 2)""")
def endpoint_match_unique(t):
    paths = res.static_paths(t("pages").select("page_id", "html"))
    side = (F.col("page_id") % 3).alias("side")
    clients = paths.select(F.struct("page_id", "path").alias("client"), side, "path").distinct()
    servers = paths.filter("page_id % 4 = 0").select(F.col("page_id").alias("owner"), side, "path").distinct()
    return res.unique_match(clients, servers, "path").select(F.col("client.page_id").alias("client"), F.col("client.path").alias("path"), "owners", "target", "status", "confidence")


@query("queue_fanout", """with p as (select distinct user_id as producer, user_id % 2 as side, event_type as topic from events where user_id % 10 < 2), c as (select distinct user_id as consumer, user_id % 2 as side, event_type as topic from events where user_id % 25 = 3)
 select producer, p.topic, consumer from p left join c on p.topic = c.topic and p.side <> c.side""")
def queue_fanout(t):
    side = (F.col("user_id") % 2).alias("side")
    p = t("events").filter("user_id % 10 < 2").select(F.col("user_id").alias("producer"), side, F.col("event_type").alias("topic")).distinct()
    c = t("events").filter("user_id % 25 = 3").select(F.col("user_id").alias("consumer"), side, F.col("event_type").alias("topic")).distinct()
    return res.fan_out(p, c, "topic")


STATEMENTS = ["SELECT a FROM S.T", "select * from  Orders where x = 1;", "DELETE FROM t", "INSERT  INTO logs.Events (a) VALUES (1)", "UPDATE users SET a = 1", "select 1; select 2", "drop table x", "SELECT 1"]
_STATEMENTS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(STATEMENTS))


@query("sql_classify", rf"""with s as (select i::bigint as id, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) as x from (values {_STATEMENTS}) v(i, x)), one as (select id, trim(list_filter(string_split(x, ';'), lambda p: trim(p) <> '')[1]) as x from s where len(list_filter(string_split(x, ';'), lambda p: trim(p) <> '')) = 1),
 m as (select id, case when starts_with(x, 'select') then 'reader' else 'writer' end as role, case when starts_with(x, 'select') then 'read' else split_part(x, ' ', 1) end as operation,
  coalesce(nullif(regexp_extract(x, '^select\b.*?\bfrom ([a-z_][a-z0-9_$]*(?:\.[a-z_][a-z0-9_$]*)?)', 1), ''), nullif(regexp_extract(x, '^(?:insert into|update|delete from) ([a-z_][a-z0-9_$]*(?:\.[a-z_][a-z0-9_$]*)?)', 1), '')) as resource from one)
 select s.id, case when resource is null then null else role end as role, case when resource is null then null else operation end as operation, resource from s left join m using (id)""")
def sql_classify(t):
    rows = t("region").sparkSession.createDataFrame(list(enumerate(STATEMENTS)), "id long, x string")
    return rows.select("id", expr.classified_sql(F.col("x")).alias("c")).select("id", "c.role", "c.operation", "c.resource")


@query("resource_nodes", f"""with {_HREFS} select distinct sha256('resource:http:get:' || path) as id, 'resource:http:get:' || path as local_key, path as resource from hrefs where path is not null""")
def resource_nodes(t):
    paths = res.static_paths(t("pages").select("page_id", "html"))
    return res.resource_nodes(paths.select(F.lit("http").alias("protocol"), F.lit("get").alias("operation"), F.col("path").alias("resource")))


@query("unique_name_resolution", """with n as (select p_brand || p_size as name, count(*) as c, min(p_partkey) as least, string_agg(p_partkey::varchar, ',' order by p_partkey) as ids from part group by 1)
 select p_partkey as ref, case when c = 1 then 'candidate' else 'unresolved' end as status, case when c = 1 then least end as target, case when c > 1 then ids else '' end as candidates
 from (select p_partkey, p_brand || (p_size + p_partkey % 2) as name from part) r left join n using (name)""")
def unique_name_resolution(t):
    names = t("part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", "p_size").alias("name"))
    refs = t("part").select(F.col("p_partkey").alias("ref"), F.concat(F.col("p_brand"), F.col("p_size") + F.col("p_partkey") % 2).alias("name"))
    return res.unique_names(refs, names)


@query("longest_prefix_root", """select page_id as id, case when starts_with(url, 'https://www.') then 'https://www.' when starts_with(url, 'https://') then 'https://' when starts_with(url, 'http://m') then 'http://m' when starts_with(url, 'http') then 'http' end as root from pages""")
def longest_prefix_root(t):
    return res.longest_prefix(t("pages").select(F.col("page_id").alias("id"), F.col("url").alias("path")), ["http", "https://", "https://www.", "http://m"])


@query("innermost_container", """with s as (select event_id as span, user_id, epoch_ms(ts) as first, epoch_ms(ts) + (1 + event_id % 7) * 86400000 as last from events where event_type = 'purchase'), p as (select event_id as point, user_id, epoch_ms(ts) as at from events where event_type = 'click')
 select point, span from (select point, span, row_number() over (partition by point order by last - first, first desc, span) as place from p left join s on s.user_id = p.user_id and p.at between s.first and s.last) where place = 1""")
def innermost_container(t):
    ms = F.unix_millis("ts")
    e = _ts(t)
    spans = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("span"), "user_id", ms.alias("first"), (ms + (1 + F.col("event_id") % 7) * 86400000).alias("last"))
    return res.innermost(e.filter("event_type = 'click'").select(F.col("event_id").alias("point"), "user_id", ms.alias("at")), spans, "user_id")
