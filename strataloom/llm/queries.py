"""The registered queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.urlfilter import oracle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.simhash import simhash_groups

    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.toxicity import score, train, training_row

    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    held_out = F.coalesce(~training_row(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    scorer, *_ = train(docs)
    return score(docs, scorer).withColumnRenamed("id", "doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strataloom.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumnRenamed("id", "doc_id")


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.graphdedup import vector_groups

    return vector_groups(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: Rules of the URL query, as (verdict, rule).
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.urlfilter import judge

    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.suffixdedup import remove_repeats

    # beside what 400 bytes remove: how many runs of over 50 words of the document occur again, which are mostly shorter
    found = remove_repeats(table(spark, sf_dir, "documents"), words=51, cut_words=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages")


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strataloom.llm.mergedropout import encode

    found = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), seed=42, dropout=0.1)
    return found.withColumnRenamed("id", "doc_id")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.multiindex import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_merge_dropout": op8_merge_dropout,
    "op9_personal_data": op9_personal_data,
    "op10_neighbours": op10_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op5_vector_dedup": """with recursive
v as (select vec_id, label, embedding::double[] as x from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  and len(a.x) = len(b.x) where list_inner_product(a.x, b.x)
    / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links, c.root as component_id,
  e.vec_id = c.root as kept
from embeddings e join (select a, min(b) as root from reach group by a) c on c.a = e.vec_id""",
    "op6_url_filter": oracle(),
}
