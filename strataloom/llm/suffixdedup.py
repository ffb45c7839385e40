"""Removal of byte strings that occur more than once, by sorting suffixes.

A byte goes if some ``length``-byte string over it also starts anywhere else in the corpus.

1. Anchors. In every window of ``length`` bytes the ``gram``-byte string with the least hash is its anchor, so equal
   windows have equal anchors at equal offsets. Neighbouring windows mostly share one: about two anchors per ``length``
   bytes stand for all windows. An anchor's context is the bytes of all its windows. (One narrow row an anchor.)
2. Anchors whose hash occurs once have no repeated window. Where all contexts of an anchor are equal, all their windows
   repeat. Equal contexts count as one from here on, so copies of a text, however many, cost one.
3. For anchors with differing contexts, the suffixes from the anchor on are sorted (deep-shallow: multikey quicksort,
   then blind tries), and so are the reversed prefixes. A window x bytes before the anchor repeats exactly if another
   context of the anchor agrees with it on x bytes to the left and ``length - x`` to the right: both are read off the
   neighbours' common prefixes in the two orders. An anchor with over ``most_contexts`` different contexts (a passage
   shared by very many texts) is not sorted in one task: its windows are counted by 128-bit digest over all tasks.
4. The windows found are merged for each document and cut out.

With ``words``, every run of that many words that occurs again goes too, however few bytes it has: each word becomes a
code of CODE bytes, the same steps find the runs of codes that repeat, and these are led back to the bytes of the words.
They may also be counted only (``n_passages``).

Texts meet their anchors in a join on a hash of the row; rows that repeat both id and text share it and get equal results.

Rows: a null text is an empty one. A null id is kept. Rows that repeat are different places, so their repeats go. A text
under ``length`` bytes is kept whole. Long texts are worked through in overlapping pieces. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.deepshallow import deep_shallow_order, neighbour_prefixes
from strataloom.llm.heavy import join_heavy
from strataloom.runtime import Scratch, shuffle_partitions

LENGTH, GRAM = 400, 32
BUFFER = 1 << 18
LONGEST_PIECE = 1 << 20
CODE = 5  # bytes that stand for a word
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\f\v"))
_POS = np.uint64((1 << 26) - 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of each byte, powers of an odd base, and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    table = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
    steps = [np.full(n, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
    for s in steps:
        s[0] = 1
    return table, *(np.multiply.accumulate(s) for s in steps)


def _room(n: int) -> int:
    size = BUFFER * 2
    while size < n:
        size *= 2
    return size


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on."""
    table, power, inverse = _powers(_room(len(data)))
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * power[:n], out=sums[1:])
    return _mix((sums[gram:] - sums[: n - gram + 1]) * inverse[: n - gram + 1])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, in two passes over blocks."""
    n = len(x)
    pad = -n % width
    blocks = np.append(x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    to_here = np.minimum.accumulate(blocks, axis=1).ravel()
    from_here = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_here[: n - width + 1], to_here[width - 1 : n])


def anchors_of(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(piece, key, digest, anchor, first window, last window), arrays over the anchors of pieces data[start:end]."""
    empty = tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < length:
        return empty
    hashes = gram_hashes(np.frombuffer(data, np.uint8), gram)
    packed = (hashes & ~_POS) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least(packed, length - gram + 1)
    valid = np.zeros(len(least), bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= length:
            valid[a : b - length + 1] = True
    windows = np.flatnonzero(valid)
    if not len(windows):
        return empty
    chosen = least[windows]
    new = np.concatenate(([True], (np.diff(windows) != 1) | (chosen[1:] != chosen[:-1])))
    begins = np.zeros(len(least), bool)
    begins[starts[starts < len(least)]] = True
    new |= begins[windows]  # pieces of one text may touch: a window that starts a piece starts a run
    first = np.flatnonzero(new)
    low = windows[first]
    high = windows[np.append(first[1:], len(windows)) - 1]
    at = (chosen[first] & _POS).astype(np.int64)
    view = memoryview(data)
    digest = np.fromiter(
        (xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(low.tolist(), (high + length).tolist(), strict=True)), np.uint64, len(low)
    )
    digest = _mix(digest ^ ((at - low).astype(np.uint64) << np.uint64(32)) ^ (high - low).astype(np.uint64))
    return np.searchsorted(starts, low, side="right") - 1, hashes[at], digest, at, low, high


def _anchors(length: int, gram: int, coded: bool = False):
    names = ["row_hash", "key", "digest", "low", "left", "more"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            starts = np.cumsum([0, *(len(p) for *_, p in held)])
            found = anchors_of(b"".join(p for *_, p in held), starts[:-1], starts[1:], length, gram)
            piece, key, digest, at, low, high = found
            rows = np.array([r for r, *_ in held], np.int64)[piece] if held else piece
            shift = (np.array([o for _, o, _ in held], np.int64) - starts[:-1])[piece] if held else piece
            values = [rows, key.view(np.int64), digest.view(np.int64), low + shift, at - low, high - low]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            for row, text in zip(batch.column("row_hash").to_pylist(), batch.column("text"), strict=True):
                data = text.as_py() or b""
                if coded:
                    data = word_codes(data)
                for at in range(0, max(1, len(data) - length + 1), LONGEST_PIECE):
                    piece = data[at : at + LONGEST_PIECE + length - 1]
                    if len(piece) < length:
                        continue
                    held.append((row, at, piece))
                    size += len(piece)
                    if size >= BUFFER:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return run


def _contexts(length: int, coded: bool = False):
    """Rows (text, wanted anchors) to one row an anchor, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                data = word_codes(text.as_py()) if coded else text.as_py()
                for w in wanted.as_py():
                    low, more = w["low"], w["more"]
                    out.append((w["key"], w["digest"], w["many"], w["left"], more, data[low : low + more + length], w["hot"]))
            names = ["key", "digest", "many", "left", "more", "bytes", "hot"]
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def repeated_windows(left: np.ndarray, more: np.ndarray, contexts: list[bytes], length: int) -> np.ndarray:
    """For contexts (bytes, anchor's offset, windows less one): a matrix, true where a window occurs in another context.

    Contexts of several anchors may come together; anchors differ within their gram, so they never agree.
    """
    n = len(contexts)
    out = np.zeros((n, int(more.max()) + 1 if n else 0), bool)
    cuts = left.tolist()
    right = [c[k:] for c, k in zip(contexts, cuts, strict=True)]
    back = [c[:k][::-1] for c, k in zip(contexts, cuts, strict=True)]
    sorted_by = []
    for strings in (right, back):
        order = deep_shallow_order(strings)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        sorted_by.append((rank, neighbour_prefixes(strings, order)))
    (rank_r, lcp_r), (rank_l, lcp_l) = sorted_by
    least, most = left - more, left
    for x in range(int(least.min()), int(most.max()) + 1) if n else ():
        rows = np.flatnonzero((least <= x) & (x <= most))
        if len(rows) < 2:
            continue
        same_r = np.cumsum(lcp_r < length - x)[rank_r[rows]]
        same_l = np.cumsum(lcp_l < x)[rank_l[rows]]
        both = same_r * (n + 1) + same_l
        order = np.argsort(both, kind="stable")
        equal = both[order[1:]] == both[order[:-1]]
        hit = np.zeros(len(rows), bool)
        hit[order[1:][equal]] = True
        hit[order[:-1][equal]] = True
        rows = rows[hit]
        out[rows, left[rows] - x] = True
    return out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of each run of true values in the rows of a matrix."""
    edge = np.zeros((flags.shape[0], 1), np.int8)
    step = np.diff(np.concatenate([edge, flags.astype(np.int8), edge], axis=1), axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


def _sorted_windows(length: int, at_once: int):
    """Contexts in order of key to rows (key, digest, first, last): runs of repeated windows."""
    names = ["key", "digest", "first", "last"]

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        left, more = (t.column(c).to_numpy().astype(np.int64) for c in ("left", "more"))
        flags = repeated_windows(left, more, t.column("bytes").to_pylist(), length)
        many = t.column("many").to_numpy()
        flags[many] = np.arange(flags.shape[1]) <= more[many, None]
        row, first, last = runs_of(flags)
        key, digest = (t.column(c).to_numpy()[row] for c in ("key", "digest"))
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(digest), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                keys = batch.column("key").to_numpy()
                if size >= at_once:  # close at the next change of key
                    last = held[-1].column("key")[held[-1].num_rows - 1].as_py()
                    other = np.flatnonzero(keys[at:] != last)
                    end = at + int(other[0]) if len(other) else batch.num_rows
                    if end > at:
                        held.append(batch.slice(at, end - at))
                    if len(other):
                        yield solve(held)
                        held, size = [], 0
                    at = end
                else:
                    part = batch.slice(at, at_once - size)
                    held.append(part)
                    size += part.num_rows
                    at += part.num_rows
        if held:
            yield solve(held)

    return run


def _window_digests(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = memoryview(row["bytes"])
                n = row["more"] + 1
                digests = [xxhash.xxh3_128_digest(data[k : k + length]) for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["key"]] * n, pa.int64()),
                        pa.array([row["digest"]] * n, pa.int64()),
                        pa.array([row["many"]] * n, pa.bool_()),
                        pa.array(range(n), pa.int32()),
                        pa.array(digests, pa.binary()),
                    ],
                    names=["key", "digest", "many", "k", "window"],
                )

    return run


def repeated_spans(texts: DataFrame, scratch: Scratch, length: int, gram: int, most_contexts: int, at_once: int, coded: bool = False) -> DataFrame:
    """``texts(row_hash, text)`` to ``(row_hash, spans)``: packed ``start << 32 | end``, unordered and overlapping; ``coded``, of word codes."""
    n = shuffle_partitions(texts.sparkSession)
    schema = "row_hash long, key long, digest long, low int, left int, more int"
    anchors = scratch.cut(texts.mapInArrow(_anchors(length, gram, coded), schema), "anchors")
    keys = (
        anchors.groupBy("key")
        .agg(F.count("*").alias("c"), F.min("digest").alias("d0"), F.max("digest").alias("d1"))
        .filter("c > 1")
        .select("key", (F.col("d0") != F.col("d1")).alias("differ"))
    )
    keys = scratch.cut(keys, "keys")
    again = scratch.cut(join_heavy(anchors, keys, ["key"]), "repeated")
    scratch.drop(anchors)
    contexts = (
        again.filter("differ")
        .groupBy("key", "digest")
        .agg(F.count("*").alias("c"), F.min(F.struct("row_hash", "low", "left", "more")).alias("r"))
        .select("key", "digest", (F.col("c") > 1).alias("many"), "r.*")
    )
    contexts = scratch.cut(contexts, "contexts")
    hot = contexts.groupBy("key").agg(F.count("*").alias("n")).select("key", (F.col("n") > most_contexts).alias("hot"))
    wanted = (
        contexts.join(hot, "key")
        .groupBy("row_hash")
        .agg(F.collect_list(F.struct("key", "digest", "many", "low", "left", "more", "hot")).alias("wanted"))
    )
    # rows that repeat id and text bring their contexts twice, which are then marked as many anyway
    named = texts.join(wanted, "row_hash").select("text", "wanted")
    ctx_schema = "key long, digest long, many boolean, left int, more int, bytes binary, hot boolean"
    cut = scratch.cut(named.mapInArrow(_contexts(length, coded), ctx_schema), "context-bytes", "zstd")
    found_schema = "key long, digest long, first int, last int"
    dealt = cut.filter("not hot").repartition(n, "key").sortWithinPartitions("key", "digest")
    found = dealt.mapInArrow(_sorted_windows(length, at_once), found_schema)
    windows = cut.filter("hot").mapInArrow(
        _window_digests(length), "key long, digest long, many boolean, k int, window binary"
    ).distinct()
    counted = windows.groupBy("key", "window").agg(F.count("*").alias("c"), F.max("many").alias("m")).filter("c > 1 or m")
    hot_found = windows.join(counted, ["key", "window"]).select("key", "digest", F.col("k").alias("first"), F.col("k").alias("last"))
    found = scratch.cut(found.unionAll(hot_found), "windows")
    scratch.drop(cut)
    span = lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))
    equal = again.filter("not differ").select("row_hash", span(F.col("low"), F.col("low") + F.col("more") + length).alias("span"))
    sorted_out = (
        join_heavy(again.filter("differ").select("row_hash", "key", "digest", "low"), found, ["key", "digest"])
        .select("row_hash", span(F.col("low") + F.col("first"), F.col("low") + F.col("last") + length).alias("span"))
    )
    return equal.unionAll(sorted_out).groupBy("row_hash").agg(F.collect_set("span").alias("spans"))


def merged(spans: np.ndarray, touching: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that packed spans cover; if not ``touching``, runs that only touch stay apart."""
    spans = np.sort(spans)
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.concatenate(([True], start[1:] > end[:-1] if touching else start[1:] >= end[:-1]))
    return start[new], end[np.append(np.flatnonzero(new)[1:], len(spans)) - 1]


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data``."""
    inside = np.concatenate(([False], ~_BLANK[np.frombuffer(data, np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_codes(data: bytes) -> bytes:
    """The words of ``data``, CODE bytes of hash each."""
    out = []
    at, size = 0, LONGEST_PIECE
    while at < len(data):
        end = at + size
        if end < len(data):
            blanks = np.flatnonzero(_BLANK[np.frombuffer(data[at:end], np.uint8)])
            if not len(blanks):
                size *= 2
                continue
            end = at + int(blanks[-1]) + 1
        piece = data[at:end]
        at, size = end, LONGEST_PIECE
        start, stop = word_places(piece)
        table, power, inverse = _powers(_room(len(piece)))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(table[np.frombuffer(piece, np.uint8)] * power[: len(piece)], out=sums[1:])
        hashes = _mix((sums[stop] - sums[start]) * inverse[start])
        out.append(hashes.view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes())
    return b"".join(out)


def bytes_of_words(data: bytes, spans: np.ndarray, words: int) -> np.ndarray:
    """Packed spans of codes to packed spans of the bytes from their first word to their last."""
    start, end = merged(spans, touching=False)
    first, after = -(-start // CODE), end // CODE
    long = after - first >= words
    at, to = word_places(data)
    return at[first[long]] << 32 | to[after[long] - 1]


def whole_characters(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans, widened to the borders of the characters they split."""
    inside = (np.append(np.frombuffer(data, np.uint8), 0) & 0xC0) == 0x80
    for _ in range(3):
        start = start - (inside[start] & (start > 0))
        end = end + inside[end]
    return start, end


def _cut_out(at: int, text_at: int, words: int = 0, whole: bool = False, cut_words: bool = True):
    """Adds the counts, the digest and the kept bytes. With ``words``, spans of codes follow the spans of bytes."""
    drop = (at, text_at, at + 1) if words else (at, text_at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, digests, kept, passages = [], [], [], [], [], []
            coded = batch.column(at + 1) if words else repeat(None, batch.num_rows)
            for text, spans, codes in zip(batch.column(text_at), batch.column(at), coded, strict=True):
                data = text.as_py() or b""
                sizes.append(len(data))
                values = spans.values.to_numpy() if spans.values is not None else np.empty(0, np.int64)
                passages.append(0)
                if codes is not None and codes.values is not None and len(codes.values):
                    more = bytes_of_words(data, codes.values.to_numpy(), words)
                    passages[-1] = len(more)
                    if cut_words:
                        values = np.append(values, more)
                if not len(values):
                    removed.append(0)
                    runs.append(0)
                else:
                    start, end = merged(values)
                    if whole:
                        start, end = whole_characters(data, start, end)
                        start, end = merged(start << 32 | end)
                    parts = [data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True)]
                    data = b"".join(parts)
                    removed.append(sizes[-1] - len(data))
                    runs.append(len(start))
                digests.append(hashlib.sha256(data).hexdigest())
                kept.append(data)
            yield pa.RecordBatch.from_arrays(
                [
                    *(c for k, c in enumerate(batch.columns) if k not in drop),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(runs, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(kept, pa.binary()),
                    *([pa.array(passages, pa.int64())] if words else []),
                ],
                names=[
                    *(c for k, c in enumerate(batch.schema.names) if k not in drop),
                    *("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"),
                    *(["n_passages"] if words else []),
                ],
            )

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    most_contexts: int = 1 << 14,
    at_once: int = 1 << 13,
    scratch: Scratch | None = None,
    words: int = 0,
    whole: bool = False,
    cut_words: bool = True,
    keep: bool = False,
) -> DataFrame:
    """One row per input row: id, row_hash (or, with ``keep``, all its columns as c0, c1, ...), n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    With ``words`` also n_passages, the maximal runs of that many words or more that occur again; they are cut unless
    ``cut_words`` is false. With ``whole``, characters that a cut would split go with it.
    """
    if not 1 <= gram < length:
        raise ValueError("gram must be shorter than length")
    scratch = scratch or Scratch(docs.sparkSession)
    own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    id_at, text_at = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    shown = own.columns if keep else ["id", "row_hash"]
    rows = own.select(*(own.columns if keep else [id_at.alias("id")]), F.xxhash64(id_at, text_at).alias("row_hash"), text_at.cast("binary").alias("text"))
    spans = scratch.cut(repeated_spans(rows.select("row_hash", "text"), scratch, length, gram, most_contexts, at_once), "spans")
    found = ["spans"]
    joined = rows.join(spans, "row_hash", "left")
    if words:
        more = Scratch(docs.sparkSession)
        runs = repeated_spans(rows.select("row_hash", "text"), more, words * CODE, gram, most_contexts, at_once, coded=True)
        runs = scratch.cut(runs.withColumnRenamed("spans", "codes"), "codes")
        more.close()
        joined = joined.join(runs, "row_hash", "left")
        found.append("codes")
    joined = joined.select(*shown, *found, "text")
    fields = [f"{n} {joined.schema[n].dataType.simpleString()}" for n in shown]
    fields += ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", "kept binary", *(["n_passages long"] if words else [])]
    return joined.mapInArrow(_cut_out(len(shown), len(shown) + len(found), words, whole, cut_words), ", ".join(fields))
