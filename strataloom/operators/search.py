"""Full-text search with BM25, masked exact vector search, rank fusion and diverse selection.

Queries come as tables, so any number of requests is one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import expr
from strataloom.runtime import Scratch

K1, B = 1.2, 0.75
#: Terms or query vectors are broadcast up to this many; beyond, they are shuffled.
MOST_BROADCAST = 10_000
#: Terms are part of an expression up to this many.
MOST_TERMS = 1000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A broadcast hint, but only for a table that is seen to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def heads(toks: Column, n: int) -> Column:
    """The first ``n`` characters of the tokens that have so many."""
    return F.transform(F.filter(toks, lambda t: F.length(t) >= n), lambda t: F.substring(t, 1, n))


def asked(toks: Column, terms: list[str], prefix: bool) -> Column:
    """The tokens that are asked for, as the terms they stand for; with ``prefix``, once for each term they begin with."""
    if not prefix:
        return F.filter(toks, lambda t: t.isin(terms))
    by_length: dict[int, list[str]] = {}
    for term in terms:
        by_length.setdefault(len(term), []).append(term)
    return F.flatten(F.array(*(F.filter(heads(toks, n), lambda t: t.isin(by_length[n])) for n in by_length)))  # noqa: B023  called at once


def bm25(docs: DataFrame, queries: DataFrame, prefix: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, doc_id, score) for ``docs(doc_id, text)`` and ``queries(query_id, term)``; higher is better.

    With ``prefix`` a term stands for every token that begins with it: its frequencies count as one phrase's. Texts are
    read and tokenised once: what is written is each text's length and those of its tokens that are asked for. Up to
    MOST_TERMS terms are part of the expression; more meet the tokens (or their heads of the asked lengths) in a join.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    distinct = queries.select("term").filter(F.length("term") > 0).distinct()
    terms = sorted(r.term for r in distinct.limit(MOST_TERMS + 1).collect())
    words = docs.select("doc_id", tokens(F.col("text")).alias("toks"))
    if len(terms) <= MOST_TERMS:
        found = scratch.cut(words.select("doc_id", F.size("toks").alias("dl"), asked(F.col("toks"), terms, prefix).alias("hits")), "hits")
        postings = found.select("doc_id", "dl", F.explode("hits").alias("term"))
    else:
        found = scratch.cut(words.select("doc_id", F.size("toks").alias("dl"), F.col("toks").alias("hits")), "hits")
        lengths = [r.n for r in distinct.select(F.length("term").alias("n")).distinct().collect()] if prefix else []
        units = F.flatten(F.array(*(heads(F.col("hits"), n) for n in lengths))) if prefix else F.col("hits")
        postings = found.select("doc_id", "dl", F.explode(units).alias("term")).join(distinct, "term", "left_semi")
    stats = found.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = scratch.cut(postings.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf")), "frequencies")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(df, "term").join(F.broadcast(stats)).select("term", "doc_id", (idf * weight).alias("w"))  # one row of statistics
    return scored.join(queries, "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", order: list | None = None) -> DataFrame:
    """Rank within ``by``; what can't be among the first k of a partition goes before the shuffle."""
    window = Window.partitionBy(by).orderBy(*(order or [F.desc("score"), F.asc("doc_id")]))
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def vector_top_k(rows: DataFrame, queries: DataFrame, k: int, mask: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) of ``rows(id, vector)`` for ``queries(query_id, vector)`` by dot product.

    ``mask(id)`` says which rows may be found; it applies before the ranking. Scores are rounded to 1e-6 and ordered by
    thousandths, then id. The stated queries are held against all rows.
    """
    if mask is not None:
        rows = rows.join(mask.select("id").distinct(), "id", "left_semi")
    asked = small(queries.select("query_id", F.col("vector").alias("query_vector")), 2000)
    score = expr.quantised(expr.dot(F.col("vector"), F.col("query_vector")))
    scored = rows.join(asked).select("query_id", "id", score.alias("score"))
    return top_k(scored, k, order=[F.desc(expr.rank_bucket(F.col("score"))), F.asc("id")])


def rrf(ranked: DataFrame, sources: DataFrame, constant: int = 60) -> DataFrame:
    """(query_id, grp, id, relevance): reciprocal ranks of ``ranked(query_id, grp, source, id, rank)``, normalised.

    ``sources(query_id, grp, source, weight)`` lists what was asked, also sources without hits; relevance is 1 for what
    all of them rank first.
    """
    most = sources.groupBy("query_id", "grp").agg(F.sum(F.col("weight") / (constant + 1)).alias("most"))
    gained = ranked.join(F.broadcast(sources) if sources.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else sources, ["query_id", "grp", "source"])
    total = gained.groupBy("query_id", "grp", "id").agg(F.sum(F.col("weight") / (constant + F.col("rank"))).alias("sum"))
    return total.join(small(most), ["query_id", "grp"]).select(
        "query_id", "grp", "id", expr.quantised(F.least(F.lit(1.0), F.col("sum") / F.col("most"))).alias("relevance")
    )


def _bucket(v: float) -> float:
    return np.floor(v * 1000 + 0.5)


def text_likeness(a: list[str], b: list[str]) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if len(a) >= 5 and len(b) >= 5:
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    else:
        x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x or y else 0.0


def select_diverse(
    ids: list, relevance: list[float], vectors: list, texts: list[list[str]], k: int, trade: float = 0.75, drop: float = 0.8, pinned: list = ()
) -> list[tuple[int, float]]:
    """Greedy picks (index, mmr): relevance against the greatest likeness to what is picked, by thousandths.

    Pinned ids come first in the order given. Two items with vectors are as alike as their vectors; else as their texts.
    A candidate without a vector that is ``drop`` alike to a picked item is left out.
    """
    order = sorted(range(len(ids)), key=lambda i: (-_bucket(relevance[i]), ids[i]))
    first = [i for p in pinned for i in order if ids[i] == p]
    out, like = [], dict.fromkeys(order, 0.0)
    left = [i for i in order if i not in first]

    def take(i: int, score: float) -> None:
        out.append((i, score))
        gone = []
        for j in left:
            if vectors[i] is not None and vectors[j] is not None:
                same = min(1.0, max(0.0, (float(np.dot(vectors[i], vectors[j])) + 1) / 2))
            else:
                same = text_likeness(texts[i], texts[j])
                if vectors[j] is None and same >= drop:
                    gone.append(j)
            like[j] = max(like[j], same)
        for j in gone:
            left.remove(j)

    for i in first[:k]:
        take(i, 1.0)
    while left and len(out) < k:
        score = {i: trade * relevance[i] - (1 - trade) * like[i] for i in left}
        best = min(left, key=lambda i: (-_bucket(score[i]), -_bucket(relevance[i]), ids[i]))
        left.remove(best)
        take(best, float(np.floor(score[best] * 1e6 + 0.5) / 1e6))
    return out


def mmr(candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, id, ordinal, mmr) from ``candidates(query_id, id, relevance, vector, toks)``; a query's candidates are few."""

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        vectors = [None if v is None else np.asarray(v, np.float64) for v in group["vector"]]
        texts = [list(t) if t is not None else [] for t in group["toks"]]
        got = select_diverse(group["id"].tolist(), group["relevance"].tolist(), vectors, texts, k)
        rows = [i for i, _ in got]
        return pd.DataFrame({"query_id": group["query_id"].iloc[rows].tolist(), "id": group["id"].iloc[rows].tolist(), "ordinal": range(1, len(rows) + 1), "mmr": [s for _, s in got]})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id string, id long, ordinal long, mmr double")


def fast_vector_scores(rows: DataFrame, queries: np.ndarray, names: list[str]) -> DataFrame:
    """(query_id, id, score) by one matrix product a batch; for many queries at once, a bounded number of them."""
    if len(queries) > MOST_BROADCAST:
        raise ValueError("deal the queries in blocks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = np.stack(b["vector"].to_numpy()).astype(np.float64) @ queries.T
                yield pd.DataFrame({"query_id": np.tile(names, len(b)), "id": np.repeat(b["id"].to_numpy(), len(names)), "score": s.ravel()})

    return rows.select("id", "vector").mapInPandas(run, "query_id string, id long, score double")
