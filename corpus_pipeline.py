"""A training corpus from raw documents: toxic ones go, near-duplicates go, repeated passages go, personal data is
masked, and what is left is packed.

Each stage reads what the stage before it wrote. The stages before the last keep the columns of ``documents``; ``n_chars``
follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.nearcopies import near_copy_groups
from strataloom.llm.packing import pack
from strataloom.llm.pii import redact
from strataloom.llm.suffixdedup import remove_repeats
from strataloom.llm.toxicity import score, train
from strataloom.runtime import Scratch

#: Words of the shortest passage that may not repeat.
PASSAGE = 51
#: Rows that go to Python at once where the session does not say: texts are long, and each task holds a few such batches.
BATCH = 1000


def _bounded(spark: SparkSession) -> None:
    """Set the size of Arrow batches for the stages, unless the session already differs from Spark's own default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH))


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents in their order, with n_chars of the text as it is now (a null text has none)."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity classifier rejects, with a score of 0.5 or more.

    Null and empty texts are scored as texts without words. Rows that repeat are each judged, alike. Other columns pass.
    """
    _bounded(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = _free(docs, "toxicity")
    return score(docs, model, keep=True, name=name).filter(F.col(name) < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the least id, of each group of near copies: by SimHash, or 0.8 of five-word shingles.

    A null text counts as empty, and all texts without words are one group. A null id comes after all others. Of rows that
    share the least id, that with the least hash of id and text stays, once. Other columns pass.
    """
    _bounded(spark)
    groups = near_copy_groups(docs)
    name = _free(docs, "row_hash")
    first = groups.filter("is_first").select(F.col("id").alias("first_id"), F.col("row_hash").alias("first_hash")).distinct()
    keyed = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    same = (F.col(name) == F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    return keyed.join(first, same, "left_semi").dropDuplicates(["doc_id", name]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every run of over 50 words, and every byte string of 400 bytes or more, that occurs more than once.

    Every occurrence goes, the first one too, as in the operator. Characters that a cut splits go whole; all others stay.
    A null text stays null. Rows that repeat are different places, so what they share goes. Other columns pass.
    """
    _bounded(spark)
    found = remove_repeats(docs, words=PASSAGE, whole=True, keep=True)
    kept = F.when(F.col("n_removed") > 0, F.make_valid_utf8(F.col("kept").cast("string")))
    text = f"c{docs.columns.index('text')}"
    cut = found.withColumn(text, F.coalesce(kept, F.col(text))).select(*(f"c{k}" for k in range(len(docs.columns))))
    return _with_text(cut.toDF(*docs.columns), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in the place of each piece of personal data. A null text stays null; other columns pass."""
    _bounded(spark)
    return _with_text(redact(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 2048 tokens; one row a piece. A null text is the end id alone."""
    _bounded(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL can't express a trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
