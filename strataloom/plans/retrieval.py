"""Text and vector search, fusion, diverse selection, metrics, packing and context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.catalog import query
from strataloom.functions import expr
from strataloom.operators import metrics, search

TERMS = [("q1", "the"), ("q1", "ononer"), ("q2", "than"), ("q2", "ertion"), ("q3", "der"), ("q3", "worthless")]
_VALUES = ", ".join(f"('{q}', '{w}')" for q, w in TERMS)
_TOKS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

BM25_SQL = f"""q(query_id, term) as (values {_VALUES}), w as (select doc_id, {_TOKS} as toks from documents),
 stats as (select count(*) as n, avg(len(toks)) as avgdl from w), post as (select doc_id, len(toks) as dl, unnest(toks) as tok from w),
 tf as (select term, doc_id, dl, count(*) as tf from post join (select distinct term from q) t on @HIT@ group by all),
 df as (select term, count(*) as df from tf group by term),
 wt as (select term, doc_id, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) as w from tf join df using (term), stats),
 bm as (select query_id, doc_id, sum(w) as score from wt join q using (term) group by all)"""


def _ranked_sql(k: int, hit: str = "tok = term") -> str:
    return BM25_SQL.replace("@HIT@", hit) + f""", ranked as (select *, row_number() over (partition by query_id order by floor(score * 1e6 + 0.5) desc, doc_id) as rank from bm qualify rank <= {k})"""


def terms(t):
    return t("documents").sparkSession.createDataFrame(TERMS, "query_id string, term string")


def _ranked(t, k, prefix=False):
    scored = search.bm25(t("documents").select("doc_id", "text"), terms(t), prefix)
    return search.top_k(scored, k, order=[F.desc(F.floor(F.col("score") * 1e6 + 0.5)), F.asc("doc_id")])


@query("bm25_search", f"with {_ranked_sql(50)} select query_id, doc_id, rank, floor(score * 1e4 + 0.5)::bigint as s from ranked")
def bm25_search(t):
    return _ranked(t, 50).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.floor(F.col("score") * 1e4 + 0.5).alias("s"))


@query("prefix_search", f"with {_ranked_sql(50, 'starts_with(tok, term)')} select query_id, doc_id, rank, floor(score * 1e4 + 0.5)::bigint as s from ranked")
def prefix_search(t):
    return _ranked(t, 50, True).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.floor(F.col("score") * 1e4 + 0.5).alias("s"))


@query("exact_pin_search", """select p_partkey, p_name, pinned from (select p_partkey, p_name, lower(p_name) = lower((select min(p_name) from part)) or lower(p_brand) = 'brand#12' as pinned from part)
 order by pinned desc, p_name, p_partkey limit 80""")
def exact_pin_search(t):
    wanted = t("part").agg(F.min("p_name").alias("wanted"))
    rows = t("part").join(F.broadcast(wanted)).select("p_partkey", "p_name", ((F.lower("p_name") == F.lower("wanted")) | (F.lower("p_brand") == "brand#12")).alias("pinned"))
    return rows.orderBy(F.desc("pinned"), "p_name", "p_partkey").limit(80)


@query("like_fallback_search", "select p_partkey, p_name from part where p_name like '%anv%' or p_type like '%STAN%'")
def like_fallback_search(t):
    return t("part").filter(F.col("p_name").like("%anv%") | F.col("p_type").like("%STAN%")).select("p_partkey", "p_name")


@query("vector_validate", """select vec_id, case when abs(sqrt(list_inner_product(embedding::double[], embedding::double[])) - 1) > 0.001 then 'norm' else 'ok' end as state from embeddings""")
def vector_validate(t):
    return t("embeddings").select("vec_id", expr.vector_state(F.col("embedding"), 64).alias("state"))


_TOPK = """s as (select q.vec_id as query_id, e.vec_id as id, floor(list_inner_product(q.embedding::double[], e.embedding::double[]) * 1e6 + 0.5) / 1e6 as score
 from embeddings e, embeddings q where q.vec_id in (0, 3, 7, 11, 19) and {mask}),
 r as (select *, row_number() over (partition by query_id order by floor(score * 1000 + 0.5) desc, id) as rank from s qualify rank <= {k})"""


def _vectors(t, k, mask=None):
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.filter(F.col("id").isin(0, 3, 7, 11, 19)).select(F.col("id").alias("query_id"), "vector")
    return search.vector_top_k(e, q, k, mask)


@query("vector_topk", f"with {_TOPK.format(mask='true', k=25)} select query_id, id, rank, floor(score * 1e5 + 0.5)::bigint as s from r")
def vector_topk(t):
    return _vectors(t, 25).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.floor(F.col("score") * 1e5 + 0.5).alias("s"))


@query("vector_topk_masked", f"with {_TOPK.format(mask='e.vec_id in (select doc_id from labels where toxic = 0)', k=25)} select query_id, id, rank from r")
def vector_topk_masked(t):
    mask = t("labels").filter("toxic = 0").select(F.col("doc_id").alias("id"))
    return _vectors(t, 25, mask).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


def _sources(t, rows):
    return t("documents").sparkSession.createDataFrame(rows, "query_id string, grp string, source string, weight double")


def _both_rankings(t):
    """Lexical and vector rankings of three requests under one id space."""
    lexical = _ranked(t, 100).select("query_id", F.lit("lexical").alias("source"), F.col("doc_id").alias("id"), "rank")
    name = F.when(F.col("query_id") == 0, "q1").when(F.col("query_id") == 3, "q2").otherwise("q3")
    vector = _vectors(t, 100).filter("query_id in (0, 3, 7)").select(name.alias("query_id"), F.lit("vector").alias("source"), "id", "rank")
    return lexical.unionByName(vector)


_RRF_SQL = f"""with {_ranked_sql(100)}, {_TOPK.format(mask='true', k=100)},
 src as (select query_id, 'lexical' as source, doc_id as id, rank from ranked union all
  select case query_id when 0 then 'q1' when 3 then 'q2' else 'q3' end, 'vector', id, rank from r where query_id in (0, 3, 7)),
 f as (select query_id, id, least(1.0, sum(1.0::double / (60 + rank)) / (2.0::double / 61)) as x from src group by all)"""


@query("rrf_fusion", _RRF_SQL + " select query_id, id, floor(x * 1e6 + 0.5)::bigint as relevance from f")
def rrf_fusion(t):
    """Reciprocal-rank fusion of BM25 and vector rankings."""
    sources = _sources(t, [(q, "all", s, 1.0) for q in ("q1", "q2", "q3") for s in ("lexical", "vector")])
    fused = search.rrf(_both_rankings(t).withColumn("grp", F.lit("all")), sources)
    return fused.select("query_id", "id", F.floor(F.col("relevance") * 1e6 + 0.5).alias("relevance"))


@query("rrf_per_plane", f"""with {_ranked_sql(100)}, src as (select query_id, case when doc_id % 2 = 0 then 'even' else 'odd' end as grp, doc_id as id, rank from ranked),
 f as (select query_id, grp, id, least(1.0, (1.0::double / (60 + rank)) / (1.0::double / 61)) as x from src) select query_id, grp, id, floor(x * 1e6 + 0.5)::bigint as relevance from f""")
def rrf_per_plane(t):
    grp = F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")
    ranked = _ranked(t, 100).select("query_id", grp.alias("grp"), F.lit("lexical").alias("source"), F.col("doc_id").alias("id"), "rank")
    sources = _sources(t, [(q, g, "lexical", 1.0) for q in ("q1", "q2", "q3") for g in ("even", "odd")])
    return search.rrf(ranked, sources).select("query_id", "grp", "id", F.floor(F.col("relevance") * 1e6 + 0.5).alias("relevance"))


@query("representatives", f"""with {_ranked_sql(100)}, src as (select query_id, case when doc_id % 2 = 0 then 'even' else 'odd' end as grp, doc_id as id, rank from ranked),
 f as (select query_id, grp, id, floor(least(1.0, (1.0::double / (60 + rank)) / (1.0::double / 61)) * 1e6 + 0.5)::bigint as relevance from src)
 select query_id, grp, id, row_number() over (partition by query_id, grp order by relevance desc, id) as place from f where relevance >= 350000 qualify place <= 2""")
def representatives(t):
    """The first two of each request and plane with a relevance of 0.35 or more."""
    order = Window.partitionBy("query_id", "grp").orderBy(F.desc("relevance"), "id")
    placed = rrf_per_plane.plan(t).filter("relevance >= 350000").withColumn("place", F.row_number().over(order).cast("long"))
    return placed.filter("place <= 2").select("query_id", "grp", "id", "place")


def _candidates(t):
    sources = _sources(t, [(q, "all", s, 1.0) for q in ("q1", "q2", "q3") for s in ("lexical", "vector")])
    fused = search.rrf(_both_rankings(t).withColumn("grp", F.lit("all")), sources)
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    texts = t("documents").select(F.col("doc_id").alias("id"), expr.redundancy_tokens(F.col("text")).alias("toks"))
    return fused.join(vectors, "id", "left").join(texts, "id", "left").select("query_id", "id", "relevance", "vector", "toks")


@query("mmr_select")
def mmr_select(t):
    return search.mmr(_candidates(t), 20)


@query("context_assembly")
def context_assembly(t):
    """Diverse candidates of each request, packed under a token budget in order of selection."""
    chosen = search.mmr(_candidates(t), 30)
    sized = chosen.join(t("documents").select(F.col("doc_id").alias("id"), expr.estimated_tokens(F.col("text")).alias("tokens")), "id")
    order = Window.partitionBy("query_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("used", F.sum("tokens").over(order)).filter("used <= 4000")


@query("pack_prefix", """select source, doc_id, tokens, used from (select *, sum(tokens) over (partition by source order by doc_id rows unbounded preceding)::bigint as used
 from (select source, doc_id, greatest(1, ceil(strlen(text) / 3.0))::bigint as tokens from documents)) where used <= 20000""")
def pack_prefix(t):
    d = t("documents").select("source", "doc_id", expr.estimated_tokens(F.col("text")).alias("tokens"))
    order = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("used", F.sum("tokens").over(order)).filter("used <= 20000")


_GOLD = "gold as (select q.query_id, doc_id as id, case when quality = 1 and toxic = 0 then 3 when quality = 1 then 2 when toxic = 0 then 1 else 0 end as grade from labels, (select distinct query_id from q) q)"


@query("retrieval_metrics", f"""with {_ranked_sql(50)}, {_GOLD},
 top as (select r.query_id, r.rank, coalesce(g.grade, 0) as grade from ranked r left join gold g on g.query_id = r.query_id and g.id = r.doc_id where rank <= 20),
 got as (select query_id, count(*) filter (where grade >= 2) as hits, min(rank) filter (where grade >= 2) as first, sum((pow(2.0, grade) - 1) / log2(rank + 1)) as dcg from top group by 1),
 ideal as (select query_id, count(*) filter (where grade >= 2) as relevant, sum((pow(2.0, grade) - 1) / log2(rank + 1)) filter (where rank <= 20) as best from
  (select *, row_number() over (partition by query_id order by grade desc, id) as rank from gold) group by 1)
 select query_id, floor(case when relevant = 0 then 1.0 else coalesce(hits, 0) / relevant end * 1e6 + 0.5) / 1e6 as recall, floor(coalesce(1.0 / first, 0) * 1e6 + 0.5) / 1e6 as rr,
  floor(case when best = 0 then 1.0 else coalesce(dcg, 0) / best end * 1e6 + 0.5) / 1e6 as ndcg from ideal left join got using (query_id)""")
def retrieval_metrics(t):
    grade = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 3).when(F.col("quality") == 1, 2).when(F.col("toxic") == 0, 1).otherwise(0)
    gold = t("labels").select(F.col("doc_id").alias("id"), grade.alias("grade")).join(F.broadcast(terms(t).select("query_id").distinct()))
    return metrics.ranking_scores(_ranked(t, 50).withColumnRenamed("doc_id", "id"), gold, 20)


@query("latency_p95", """select event_type, v[least(floor(n * 0.5), n - 1)::bigint + 1] as p50, v[least(floor(n * 0.95), n - 1)::bigint + 1] as p95 from
 (select event_type, list(value order by value) as v, count(value) as n from events group by 1)""")
def latency_p95(t):
    v = t("events").groupBy("event_type").agg(F.collect_list("value").alias("v"))
    return v.select("event_type", expr.nearest_rank(F.col("v"), 0.5).alias("p50"), expr.nearest_rank(F.col("v"), 0.95).alias("p95"))


_W = r"regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[\p{L}\p{N}]+')"
_GRAMS = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]))"


@query("benchmark_contamination", f"""with d as (select doc_id, unnest({_GRAMS}) as g from (select doc_id, {_W} as w from documents) where len(w) >= 5),
 b as (select item_id, unnest({_GRAMS}) as g from (select item_id, {_W} as w from benchmark) where len(w) >= 5), n as (select item_id, count(*) as total from b group by 1)
 select doc_id, item_id, count(*) as shared, floor(count(*) / any_value(total) * 1e6 + 0.5) / 1e6 as share from d join b using (g) join n using (item_id) group by doc_id, item_id""")
def benchmark_contamination(t):
    """Five-word shingles of each benchmark item found in each document."""
    def grams(df, key):
        toks = df.select(key, expr.redundancy_tokens(F.col("text")).alias("toks"))  # once a row, not once a use
        return toks.select(key, F.explode(expr.shingles(F.col("toks"))).alias("g"))

    b = grams(t("benchmark"), "item_id")
    total = b.groupBy("item_id").agg(F.count("*").alias("total"))
    hits = grams(t("documents"), "doc_id").join(b, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    return hits.join(total, "item_id").select("doc_id", "item_id", "shared", (F.floor(F.col("shared") / F.col("total") * 1e6 + 0.5) / 1e6).alias("share"))


@query("near_duplicate_pairs", f"""with f as (select doc_id, lang, w, len(w) as n, case when len(w) >= 5 then {_GRAMS} else list_distinct(w) end as g, list_distinct(w) as u from (select doc_id, lang, {_W} as w from documents) where len(w) > 0),
 x as (select doc_id, lang, n >= 5 as long, unnest(g) as e, len(g) as size from f), p as (select a.doc_id as l, b.doc_id as r, count(*) as c, any_value(a.size) as sa, any_value(b.size) as sb
  from x a join x b on a.lang = b.lang and a.e = b.e and a.long = b.long and a.doc_id < b.doc_id group by 1, 2),
 mixed as (select a.doc_id as l, b.doc_id as r, len(list_intersect(a.u, b.u)) as c, len(a.u) as sa, len(b.u) as sb from f a join f b on a.lang = b.lang and a.doc_id < b.doc_id and (a.n >= 5) <> (b.n >= 5) where greatest(len(a.u), len(b.u)) <= 5)
 select l as "left", r as "right", floor(c / (sa + sb - c) * 1e6 + 0.5)::bigint as micros from (select * from p union all select * from mixed) where c / (sa + sb - c) >= 0.85 and c / (sa + sb - c) < 1""")
def near_duplicate_pairs(t):
    from strataloom.operators.records import similar_pairs

    return similar_pairs(t("documents").select(F.col("doc_id").alias("id"), "lang", "text"), ["lang"])


@query("duplicate_waste", """with d as (select doc_id, source, regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[\\p{L}\\p{N}]+') as tk from documents),
 w as (select doc_id, len(tk) as n, unnest(tk) as w, generate_subscripts(tk, 1) as i from d),
 long as (select doc_id, concat_ws(' ', w, lead(w, 1) over o, lead(w, 2) over o, lead(w, 3) over o, lead(w, 4) over o) as e from w where n >= 5 window o as (partition by doc_id order by i) qualify i <= n - 4),
 g as (select distinct doc_id, e from (select * from long union all select doc_id, array_to_string(tk, ' ') from d where len(tk) between 1 and 4)),
 s as (select doc_id, e, count(*) over (partition by doc_id) as size from g),
 p as (select a.doc_id as later, b.doc_id as earlier from s a join s b on a.e = b.e and b.doc_id < a.doc_id and a.size >= b.size * 0.8 and b.size >= a.size * 0.8
  group by all having count(*) / (any_value(a.size) + any_value(b.size) - count(*)) >= 0.8),
 f as (select later, min(earlier) as earlier from p group by 1), u as (select distinct doc_id, w from w),
 x as (select later, count(*) as shared from f join w on w.doc_id = later join u on u.doc_id = earlier and u.w = w.w group by 1)
 select source, sum(len(tk))::bigint as tokens, coalesce(sum(shared), 0)::bigint as wasted from d left join x on later = doc_id group by source""")
def duplicate_waste(t):
    """Tokens, and those that a text shares with its first earlier near copy in any source."""
    from strataloom.operators.records import duplicate_waste as waste

    return waste(t("documents").select(F.col("doc_id").alias("id"), "source", "text"), ["source"])


@query("recall_ranked", f"""with {BM25_SQL.replace("@HIT@", "tok = term")}, p as (select query_id, doc_id, quality, floor(score * 1e6 + 0.5) as s from bm join labels using (doc_id) where toxic = 0)
 select query_id, doc_id, row_number() over (partition by query_id order by quality desc, s desc, doc_id) as place from p qualify place <= 200""")
def recall_ranked(t):
    """The first records of those that pass the gate (labelled, not toxic), better ones first; the gate comes before the cut."""
    scored = search.bm25(t("documents").select("doc_id", "text"), terms(t))
    passed = scored.join(t("labels").filter("toxic = 0"), "doc_id")
    best = search.top_k(passed, 200, order=[F.desc("quality"), F.desc(F.floor(F.col("score") * 1e6 + 0.5)), F.asc("doc_id")])
    return best.select("query_id", "doc_id", F.col("rank").cast("long").alias("place"))
