"""Toxicity: a convolutional text classifier, trained in numpy on hashed word embeddings.

A word's embedding is the mean of hashed vectors for the word and its prefixes, so inflected and compound forms share
what is learnt. Filters one, two and three words wide run over the whole text; each filter's maximum feeds a logistic
output. Training is AdaGrad on the positions that won the maxima. On a part of the training rows held out of the fit,
one threshold is set for all texts and, where there are enough rows of both kinds, one for each language; the language
is guessed from function words of the text itself. A score is the logistic of the distance to the text's threshold, so
0.5 is the threshold everywhere.

Scoring keeps, for each known word, what it adds to every filter at every offset: a text is a sum of gathered rows.

Rows: a null or empty text is scored as one without words. A null id is kept, and counts as held out of nothing. Rows
that repeat each give a row. Texts are read whole, whatever their length. With no usable labels (an empty table, or one
class only) every score is the share of toxic labels, or 0 without any. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
PREFIXES = (4, 5, 6, 7, 8)
LEAST_TEXTS = 4
PADS = max(WIDTHS) - 1
SLOTS = sum(WIDTHS) * FILTERS
POOLED = len(WIDTHS) * FILTERS
#: At most so many labelled rows, of at most so many bytes each, are fitted on.
TRAIN_ROWS, TRAIN_BYTES = 6000, 32_000
CACHED = 300_000

# Frequent function words.
FUNCTION_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat".split(),
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou".split(),
}


_LISTED = frozenset(w for listed in FUNCTION_WORDS.values() for w in listed)


def features(word: str) -> list[int]:
    """Hash buckets of a word and its prefixes."""
    raw = ["w" + word] + [word[:k] for k in PREFIXES if len(word) > k]
    return [zlib.crc32(r.encode()) % BUCKETS for r in raw]


def feature_grid(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word, filled up with BUCKETS, and one over their number."""
    listed = [features(w) if w else [] for w in words]
    grid = np.full((len(words), 1 + len(PREFIXES)), BUCKETS)
    for k, f in enumerate(listed):
        grid[k, : len(f)] = f
    return grid, 1 / np.maximum(np.fromiter(map(len, listed), np.float64, len(listed)), 1)


def language(words: list[str]) -> str:
    """The language with the most function words in the text; empty if none has any."""
    best, most = "", 0
    seen = Counter(filter(_LISTED.__contains__, words))
    for name, listed in FUNCTION_WORDS.items():
        hits = sum(seen[w] for w in listed)
        if hits > most:
            best, most = name, hits
    return best


def _slots(width_at: int) -> list[tuple[int, slice, slice]]:
    """(offset, slots, pooled) of the filters of one width."""
    before = sum(WIDTHS[:width_at])
    pooled = slice(width_at * FILTERS, (width_at + 1) * FILTERS)
    return [(k, slice((before + k) * FILTERS, (before + k + 1) * FILTERS), pooled) for k in range(WIDTHS[width_at])]


def convolve(gathered: np.ndarray) -> np.ndarray:
    """Filter responses at each position, from rows of what each word adds at each offset."""
    n = len(gathered)
    out = np.zeros((n, POOLED), np.float32)
    for at in range(len(WIDTHS)):
        for k, slots, pooled in _slots(at):
            out[: n - k, pooled] += gathered[k:, slots]
    return out


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIM
    weights: np.ndarray  # DIM x SLOTS
    bias: np.ndarray  # POOLED
    out: np.ndarray  # POOLED
    out_bias: float
    threshold: float = 0.0
    by_language: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_rows", "_ids")}

    def _index(self, words: list[str]) -> list[int]:
        """Numbers of the words' rows; row 0 is that of words without any learnt feature."""
        ids, rows = self.__dict__.setdefault("_ids", {}), self.__dict__.setdefault("_rows", [np.zeros((1, SLOTS), np.float32)])
        new = list(set(words).difference(ids))
        if new:
            grid, share = feature_grid(new)
            known = self.table.any(axis=1)
            table = np.vstack([self.table, np.zeros((1, DIM), np.float32)])
            some = np.flatnonzero(np.append(known, False)[grid].any(axis=1))
            at = sum(map(len, rows))
            ids.update(dict.fromkeys(new, 0))
            ids.update({new[i]: at + k for k, i in enumerate(some.tolist())})
            rows.append(((table[grid[some]].sum(axis=1) * share[some, None]) @ self.weights).astype(np.float32))
        return list(map(ids.__getitem__, words))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if len(self.__dict__.get("_ids", ())) > CACHED:
            del self._ids, self._rows
        limits, together, starts = [], [], []
        for t in texts:
            words = WORD.findall((t or "").lower())
            starts.append(len(together))
            together += [""] * PADS  # a text's last windows end in the next one's pads
            together += words
            limits.append(self.by_language.get(language(words), self.threshold))
        index = self._index([*together, *[""] * PADS])
        rows = np.concatenate(self._rows)
        self._rows[:] = [rows]
        pooled = self._pool(rows, np.array(index, np.int64), np.array(starts))
        return np.round(1 / (1 + np.exp(np.clip(np.array(limits) - self.logits(pooled), -50, 50))), 6)

    def _pool(self, rows: np.ndarray, index: np.ndarray, starts: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """Maxima of each text, over pieces of bounded length."""
        out = np.full((len(starts), POOLED), -np.inf, np.float32)
        n = len(index) - PADS
        for a in range(0, n, step):
            z = convolve(rows[index[a : a + step + PADS]])[: min(step, n - a)]
            first = np.searchsorted(starts, a, side="right") - 1
            last = np.searchsorted(starts, a + len(z), side="left")
            at = np.maximum(starts[first:last] - a, 0)
            out[first:last] = np.maximum(out[first:last], np.maximum.reduceat(z, at, axis=0))
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias


def summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``at`` and the sums of their rows."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], np.add.reduceat(rows[order], first, axis=0)


def fit(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    """Train on whole texts; a fifth of them is kept for the thresholds."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        none = np.zeros(0, np.float32)
        return Model(none, none, none, none, 0.0, constant=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    words = [WORD.findall((t or "").lower()) for t in texts]
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in ws], np.int64) for ws in words]
    grid, share = feature_grid([*vocab, ""])
    share = share.astype(np.float32)
    held = rng.permutation(len(y)) % 5 == 0
    if len({*y[held]}) < 2 or len({*y[~held]}) < 2:
        held[:] = False
    seen = np.zeros(BUCKETS + 1, np.int64)
    for i in np.flatnonzero(~held):
        seen[np.unique(grid[np.unique(ids[i])])] += 1
    used = seen >= LEAST_TEXTS
    used[BUCKETS] = False
    table = np.where(used[:, None], rng.normal(0, 0.3, (BUCKETS + 1, DIM)), 0.0).astype(np.float32)
    weights = rng.normal(0, 0.3, (DIM, SLOTS)).astype(np.float32)
    bias, out, out_bias = np.zeros(POOLED), rng.normal(0, 0.3, POOLED), float(np.log(y.mean() / (1 - y.mean())))
    sums = [np.full_like(x, 1e-6) for x in (table, weights, bias, out)] + [1e-6]
    rate, batch = 0.08, 16
    train = np.flatnonzero(~held)
    heavy = np.where(y == 1, 0.5 / y[train].mean(), 0.5 / (1 - y[train].mean())) ** 0.5
    pad = len(vocab)
    for _ in range(int(np.clip(20_000 // len(train), 5, 40))):
        for some in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            index = np.concatenate([*(np.append([pad] * PADS, ids[i]) for i in some), [pad] * PADS])
            starts = np.cumsum([0, *(len(ids[i]) + PADS for i in some)])
            unique, inverse = np.unique(index, return_inverse=True)
            vectors = table[grid[unique]].sum(axis=1) * share[unique, None]
            z = convolve((vectors @ weights).astype(np.float32)[inverse])
            won = np.stack([z[a:b].argmax(axis=0) + a for a, b in zip(starts, starts[1:], strict=False)])
            pooled = z[won, np.arange(POOLED)] + bias
            kept = rng.random(POOLED) < 0.8
            hidden = np.maximum(pooled, 0) * kept / 0.8
            p = 1 / (1 + np.exp(-np.clip(hidden @ out + out_bias, -30, 30)))
            err = (p - y[some]) * heavy[some] / len(some)
            g_out, g_bias_out = hidden.T @ err + 1e-4 * out, err.sum()
            delta = err[:, None] * out * (pooled > 0) * kept / 0.8
            g_weights, at_word, at_grad = np.zeros_like(weights), [], []
            for at in range(len(WIDTHS)):
                for k, slots, cols in _slots(at):
                    where = inverse[won[:, cols] + k].ravel()
                    d = delta[:, cols]
                    rest = vectors[where].reshape(*d.shape, DIM)
                    g_weights[:, slots] += np.einsum("bfd,bf->df", rest, d)
                    at_word.append(where)
                    at_grad.append((d[:, :, None] * weights[:, slots].T[None]).reshape(-1, DIM))
            moved, g_words = summed(np.concatenate(at_word), np.concatenate(at_grad))
            of = unique[moved]
            g_rows = np.repeat(g_words * share[of, None], grid.shape[1], axis=0)
            buckets, g_table = summed(grid[of].ravel(), g_rows)
            g_table[~used[buckets]] = 0
            sums[0][buckets] += g_table**2
            table[buckets] -= rate * g_table / np.sqrt(sums[0][buckets])
            for k, (x, g) in enumerate(((weights, g_weights + 1e-4 * weights), (bias, delta.sum(axis=0)), (out, g_out)), 1):
                sums[k] += g**2
                x -= rate * g / np.sqrt(sums[k])
            sums[4] += g_bias_out**2
            out_bias -= rate * g_bias_out / sums[4] ** 0.5
    model = Model(table[:BUCKETS].astype(np.float32), weights.astype(np.float32), bias, out, out_bias)
    judged = np.flatnonzero(held) if held.any() else train
    raw = model.scores([texts[i] for i in judged])
    raw = np.log(np.maximum(raw, 1e-12) / np.maximum(1 - raw, 1e-12))
    spoken = np.array([language(words[i]) for i in judged])
    model.threshold = _threshold(raw, y[judged], 0.0)
    for name in sorted({*spoken.tolist()} - {""}):
        of = spoken == name
        if y[judged][of].sum() >= 8 and (1 - y[judged][of]).sum() >= 8:
            model.by_language[name] = _threshold(raw[of], y[judged][of], model.threshold)
    return model


def _threshold(logits: np.ndarray, y: np.ndarray, default: float) -> float:
    """The middle of the gap with the best F1; among equals, the one nearest to ``default``."""
    order = np.argsort(logits)
    at, truth = logits[order], y[order]
    hits = truth[::-1].cumsum()[::-1]
    f1 = 2 * hits / (np.arange(len(at), 0, -1) + truth.sum())
    cuts = np.concatenate(([at[0] - 1], (at[1:] + at[:-1]) / 2))
    cuts[f1 < f1.max() - 1e-9] = np.inf
    if not np.isfinite(cuts).any():
        return default
    return float(cuts[np.abs(cuts - default).argmin()])


def training_row(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from: crc32 of the id as text is no multiple of five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``rows`` labelled rows of at most ``most_bytes`` bytes, chosen by hash of the id."""
    known = labels.filter(F.col(label_col).isin(0, 1) & training_row(F.col(id_col)))
    known = known.groupBy(id_col).agg(F.max(label_col).alias("label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(2 * rows)  # some are too long, or have no text
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text")).filter(F.octet_length("text") <= most_bytes)
    sample = texts.join(F.broadcast(chosen), id_col)  # 2 * rows ids and labels at most
    got = sample.orderBy(F.xxhash64(id_col), id_col, "text").limit(rows).select("text", "label").collect()
    return fit([r.text for r in got], [r.label for r in got])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, name: str = "toxicity") -> DataFrame:
    """One row per input row: id and score, or with ``keep`` all columns and one called ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: BUCKETS x DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            values: list[np.ndarray] = []
            part: list[str | None] = []
            size = 0
            for t in texts:
                part.append(t.as_py())
                size += len(part[-1] or "")
                if size > 1 << 20:
                    values.append(use.scores(part))
                    part, size = [], 0
            if part:
                values.append(use.scores(part))
            got = pa.array(np.concatenate(values) if values else np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], names=[*batch.schema.names[:-1], "score"])

    if keep:
        names = [f"c{k}" for k in range(len(docs.columns))]
        rows = docs.toDF(*names).withColumn("scored", F.col(names[docs.columns.index(text_col)]))
        schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1]) + ", score double"
        return rows.mapInArrow(run, schema).toDF(*docs.columns, name)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, score double")
