"""Quality without gold labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed scorer.

Ten labellers look at a text's shape and say good, bad, or nothing. How often each is right, for good and for bad texts,
and how many texts are good, is estimated by expectation-maximisation over the patterns of votes of all texts: the
patterns are counted in Spark (3 ** 10 at most, whatever the corpus), and the driver iterates over the counts. Each text's
posterior then labels a sample, on which a linear scorer over hashed words and shape marks is trained. The scorer also
judges texts on which the labellers are silent.

Rows: a null text is an empty one. A null id is kept. Rows that repeat give equal rows. Texts are read whole. On an empty
table there is nothing to fit, and the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SYMBOL = re.compile(r"[#$%&*|~^=<>{}\\\[\]@_]")
DOUBLED = re.compile(r"([^\w\s])\1+")
BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
STOP = re.compile(r"[.!?](?=\s|$)")
BUCKETS = 1 << 15
#: The scorer is fitted on at most so many texts, of at most so many bytes each.
TRAIN_ROWS, TRAIN_BYTES = 4000, 32_000
CACHED = 300_000
GOOD, BAD, NOTHING = 1, 0, 2
#: Prior mass of (bad, good) votes as a share of all texts: a labeller seldom calls a good text bad, while bad texts are of
#: several sorts, and a labeller knows one or two of them.
PRIOR_GOOD, PRIOR_BAD = np.array([0.01, 0.99]), np.array([0.01, 0.01])

# Short frequent words of several languages.
FUNCTION_WORDS = frozenset(
    "a and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du en et la le les par pas pour que qui sur un une "
    "auf das dem den der die ein eine für ist mit nicht sich und von zu "
    "con el las lo los no para por se su una y".split()
)


@dataclass
class Shape:
    words: int
    length: float  # of words
    symbols: float  # a character
    upper: float  # of letters
    again: float  # share of lines that repeat
    lines: int
    function: float  # share of words
    stops: float  # a word
    distinct: float  # share of distinct words, in texts of a comparable length
    doubled: float  # doubled punctuation, a word
    bare: float  # pieces between blanks without letters or digits, a word


def shape_of(text: str, words: list[str]) -> Shape:
    n = len(words)
    letters = sum(map(len, words))
    lines = [x for x in text.split("\n") if x]
    known = Counter(words)
    return Shape(
        n,
        letters / n if n else 0.0,
        len(SYMBOL.findall(text)) / max(1, len(text)),
        len(UPPER.findall(text)) / max(1, letters),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        len(lines),
        sum(known[w] for w in known.keys() & FUNCTION_WORDS) / max(1, n),
        len(STOP.findall(text)) / max(1, n),
        len(known) / max(1, n) if n < 2000 else min(1.0, len(known) / n * (n / 2000) ** 0.3),
        len(DOUBLED.findall(text)) / max(1, n),
        len(BARE.findall(text)) / max(1, n),
    )


LABELLERS = (
    lambda s: BAD if s.words < 15 else GOOD if 40 <= s.words <= 5000 else NOTHING,
    lambda s: NOTHING if s.words < 5 else GOOD if 3 <= s.length <= 9 else BAD if not 2.5 <= s.length <= 11 else NOTHING,
    lambda s: BAD if s.symbols > 0.08 else GOOD if s.symbols < 0.01 and s.words > 5 else NOTHING,
    lambda s: BAD if s.upper > 0.4 else GOOD if s.upper < 0.15 and s.words > 5 else NOTHING,
    lambda s: BAD if s.again > 0.25 else GOOD if s.again < 0.02 and s.lines > 1 else NOTHING,
    lambda s: NOTHING if s.words < 10 else GOOD if s.function >= 0.12 else BAD if s.function < 0.03 else NOTHING,
    lambda s: NOTHING if s.words < 20 else GOOD if 0.02 <= s.stops <= 0.3 else BAD,
    lambda s: NOTHING if s.words < 20 else BAD if s.distinct < 0.2 else GOOD if s.distinct > 0.4 else NOTHING,
    lambda s: NOTHING if s.words < 5 else BAD if s.doubled > 0.1 else GOOD if s.doubled < 0.02 else NOTHING,
    lambda s: NOTHING if s.words < 5 else BAD if s.bare > 0.15 else GOOD if s.bare < 0.03 else NOTHING,
)


def votes_of(text: str | None) -> str:
    text = text or ""
    s = shape_of(text, WORD.findall(text.lower()))
    return "".join(str(f(s)) for f in LABELLERS)


def marks_of(s: Shape) -> list[str]:
    """Shape marks for the hashed scorer."""
    step = lambda v, *cuts: sum(v >= c for c in cuts)
    return [
        f"#n{step(s.words, 5, 15, 40, 100, 400, 1500, 5000)}",
        f"#l{step(s.length, 2.5, 3, 4, 5, 6, 7, 9, 11)}",
        f"#s{step(s.symbols, 0.001, 0.005, 0.01, 0.03, 0.08)}",
        f"#u{step(s.upper, 0.01, 0.05, 0.15, 0.4)}",
        f"#a{step(s.again, 0.001, 0.02, 0.1, 0.25, 0.5)}",
        f"#f{step(s.function, 0.01, 0.03, 0.07, 0.12, 0.2)}",
        f"#e{step(s.stops, 0.005, 0.02, 0.05, 0.1, 0.3)}",
        f"#d{step(s.distinct, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8)}",
        f"#p{step(s.doubled, 0.005, 0.02, 0.1, 0.5)}",
        f"#b{step(s.bare, 0.005, 0.03, 0.15, 0.5)}",
    ]


def estimate(patterns: dict[str, int], rounds: int = 200, prior_good=PRIOR_GOOD, prior_bad=PRIOR_BAD) -> tuple[dict[str, float], np.ndarray, float]:
    """(posterior of good by pattern, vote probabilities [labeller, truth, vote], share of good)."""
    if not patterns:
        return {}, np.empty((0, 2, 3)), 0.5
    names = sorted(patterns)
    votes = np.array([[int(c) for c in p] for p in names])
    weight = np.array([patterns[p] for p in names], np.float64)
    voted = np.maximum((votes != NOTHING).sum(axis=1), 1)
    post = 0.05 + 0.9 * ((votes == GOOD).sum(axis=1) + 0.5 * ((votes != NOTHING).sum(axis=1) == 0)) / voted
    one_hot = np.stack([votes == v for v in (BAD, GOOD, NOTHING)], axis=2).astype(np.float64)
    table, share = np.empty((votes.shape[1], 2, 3)), 0.5
    prior = {0: prior_bad, 1: prior_good}
    for _ in range(rounds):
        for truth, p in ((0, 1 - post), (1, post)):
            mass = np.einsum("pkv,p->kv", one_hot, weight * p) + 1.0
            mass[:, :2] += prior[truth] * weight.sum()
            table[:, truth] = mass / mass.sum(axis=1, keepdims=True)
        share = float((weight @ post + 1) / (weight.sum() + 2))
        # what a labeller says when it speaks; that it is silent says nothing
        spoken = table[:, :, :2] / table[:, :, :2].sum(axis=2, keepdims=True)
        gain = np.log(spoken[:, 1] / spoken[:, 0])
        odds = np.log(share / (1 - share)) + np.einsum("pkv,kv->p", one_hot[:, :, :2], gain)
        after = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(after - post).max() < 1e-9:
            break
        post = after
    return dict(zip(names, post.tolist(), strict=True)), table, share


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias}

    def score(self, text: str | None) -> float:
        text = text or ""
        words = WORD.findall(text.lower())
        known = self.__dict__.setdefault("_known", {})
        if len(known) > CACHED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = float(self.weights[zlib.crc32(w.encode()) % BUCKETS])
        total = sum(map(known.__getitem__, words)) / max(1, len(words))
        total += sum(self.weights[zlib.crc32(m.encode()) % BUCKETS] for m in marks_of(shape_of(text, words)))
        return round(float(1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))), 6)


def fit(texts: list[str | None], targets: list[float], rounds: int = 150, rate: float = 0.5, shrink: float = 1e-4) -> Scorer:
    """Logistic regression on soft targets by AdaGrad over the whole sample."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not texts:
        return Scorer(weights, bias)
    row, col, val = [], [], []
    for i, t in enumerate(texts):
        words = WORD.findall((t or "").lower())
        counts = Counter(zlib.crc32(w.encode()) % BUCKETS for w in words)
        items = {b: c / len(words) for b, c in counts.items()}
        for m in marks_of(shape_of(t or "", words)):
            b = zlib.crc32(m.encode()) % BUCKETS
            items[b] = items.get(b, 0) + 1
        row += [i] * len(items)
        col += items.keys()
        val += items.values()
    row, col, val, y = np.array(row), np.array(col), np.array(val), np.array(targets)
    seen, seen_bias = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[col] * val, len(y)) + bias, -30, 30)))
        err = (p - y) / len(y)
        g = np.bincount(col, err[row] * val, BUCKETS) + shrink * weights
        seen += g * g
        weights -= rate * g / np.sqrt(seen)
        seen_bias += err.sum() ** 2
        bias -= rate * err.sum() / seen_bias**0.5
    return Scorer(weights, bias)


def _map_text(docs: DataFrame, make, name: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """The last column, a text, replaced by ``make()(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            got = pa.array([f(t.as_py()) for t in batch.columns[-1]], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], names=[*batch.schema.names[:-1], name])

    fields = [f"`{n}` {t}" for n, t in docs.dtypes[:-1]]
    return docs.mapInArrow(run, ", ".join([*fields, f"{name} {kind}"]))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES):
    """(scorer, posterior by pattern, vote table). Votes of all texts; the scorer on at most ``rows`` of them."""
    voted = _map_text(docs.select(F.col(text_col).cast("string").alias("text")), lambda: votes_of, "votes", "string", pa.string())
    patterns = {r.votes: r.n for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior, table, _ = estimate(patterns)
    place = F.xxhash64(id_col, text_col)
    texts = docs.select(F.col(text_col).cast("string").alias("text"), place.alias("place")).filter(F.octet_length("text") <= most_bytes)
    # about twice as many as are wanted reach the driver, however many partitions there are
    some = texts.filter(F.pmod("place", F.lit(max(1, sum(patterns.values()) // (2 * rows)))) == 0)
    sample = [r.text for r in some.orderBy("place", "text").limit(rows).collect()]
    return fit(sample, [posterior[votes_of(t)] for t in sample]), posterior, table


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1, higher: better), kept (score at least one half)."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # BUCKETS numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _map_text(rows, lambda: shared.value.score, "score", "double", pa.float64()).withColumn("kept", F.col("score") >= 0.5)
