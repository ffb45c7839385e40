"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, exact Hamming check, components.

The 64 bits are cut into six blocks. Two fingerprints that differ in at most four bits agree on at least two whole
blocks, so they meet in one of the fifteen tables keyed by a pair of blocks (about 21 bits, so the buckets stay small
up to millions of distinct fingerprints). Equal fingerprints are merged before the tables are built, so copies of one
text cost one row. A bucket never yields all its pairs: it yields links that connect exactly what its close pairs
connect. Buckets over ``tile`` fingerprints are dealt out as pairs of tiles over many tasks.

Rows: null or word-less texts get fingerprint zero and link like any other. A null id takes no part in the least id of
its group. Repeated rows each give a row. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.components import connected_components
from strataloom.llm.heavy import join_heavy
from strataloom.runtime import Scratch, shuffle_partitions

SEED = 42
BLOCKS = (11, 11, 11, 11, 10, 10)
PIECE = 1 << 16

_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """SimHash of the word shingles of ``text``; bit k is set if over half of the shingle hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), PIECE):
        cut = zip(starts[at : at + PIECE].tolist(), ends[at : at + PIECE].tolist(), strict=True)
        n = min(PIECE, len(starts) - at)
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in cut], repeat(SEED)), np.uint64, n
        )
        lanes = hashes.view(np.uint8).reshape(n, 8)
        for k in range(0, n, 255):
            sums = _LANES[lanes[k : k + 255]].sum(axis=0, dtype=np.uint64)
            ones += sums.view(np.uint8)
    bits = np.packbits(ones * 2 > len(starts), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            out = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row_hash"), pa.array(out)], names=["id", "row_hash", "fp"]
            )

    return run


def _keys(blocks: tuple[int, ...], keep: int) -> list[int]:
    """Signed masks, one for each choice of ``keep`` blocks."""
    edges = np.concatenate(([0], np.cumsum(blocks)))
    masks = [((1 << n) - 1) << int(e) for n, e in zip(blocks, edges[:-1], strict=True)]
    sums = [sum(masks[i] for i in which) for which in combinations(range(len(blocks)), keep)]
    return [m - (1 << 64) if m >> 63 else m for m in sums]


def links_within(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, all of them between close fingerprints, that connect what all close pairs of ``fps`` connect.

    Leaders take every fingerprint near them, then members of the smaller groups are held against all the rest; in a
    dense group this is far from quadratic, and in a sparse one the leader pass has already seen every pair.
    """
    n = len(fps)
    group = np.full(n, -1)
    parent: list[int] = []
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(i: int, near: np.ndarray) -> None:
        """Link i with the first of ``near`` from each group that is not yet its own."""
        for g, first in zip(*np.unique(group[near], return_index=True), strict=True):
            a, b = find(int(g)), find(int(group[i]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(np.array([i]))
                right.append(near[first : first + 1])

    leaders = np.zeros(n, bool)
    for i in range(n):
        if group[i] >= 0:
            continue
        leaders[i] = True
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= most)
        group[i] = len(parent)
        parent.append(len(parent))
        fresh = near[(group[near] < 0)]
        group[fresh] = group[i]
        left.append(np.full(len(fresh), i))
        right.append(fresh)
        join(i, near)
    roots = np.array([find(g) for g in range(len(parent))])[group]
    names, counts = np.unique(roots, return_counts=True)
    if len(names) > 1:
        largest = names[counts.argmax()]
        for i in np.flatnonzero((roots != largest) & ~leaders):
            join(int(i), np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= most))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _bucket_links(most: int, tile: int, key_names: list[str]):
    """Over rows sorted by key: the links of each bucket, or its rows again (b null) if it holds over ``tile``."""
    small = 8

    def emit(a: np.ndarray, b: np.ndarray | None, keys: list[np.ndarray] | None) -> pa.RecordBatch:
        n = len(a)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(a), none if b is None else pa.array(b), *([none] * 2 if keys is None else map(pa.array, keys))],
            names=["a", "b", "k0", "k1"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held_n, spilling = 0, False

        def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            return tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*key_names, "fp"))

        def whole(t: np.ndarray, k: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Links of complete buckets."""
            n = len(fp)
            if n < 2:
                return
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])))
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, n))
            of = np.cumsum(new) - 1
            few = (size <= small)[of]
            for s in range(1, small):
                i = np.flatnonzero(few[:-s] & (of[s:] == of[:-s])) if n > s else np.empty(0, np.int64)
                i = i[np.bitwise_count(fp[i].view(np.uint64) ^ fp[i + s].view(np.uint64)) <= most]
                if len(i):
                    yield emit(fp[i], fp[i + s], None)
            for g in np.flatnonzero(size > small):
                part = fp[first[g] : first[g] + size[g]]
                a, b = links_within(part.view(np.uint64), most)
                if len(a):
                    yield emit(part[a], part[b], None)

        last = None
        for batch in batches:
            t, k, fp = columns(batch)
            if not len(fp):
                continue
            same = (t == t[-1]) & (k == k[-1])
            cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            if last == (t[0], k[0]):
                end = len(fp) if cut == 0 else int(np.flatnonzero((t != t[0]) | (k != k[0]))[0])
                held.append((t[:end], k[:end], fp[:end]))
                held_n += end
                if spilling or held_n > tile:
                    for x in held:
                        yield emit(x[2], None, [x[0], x[1]])
                    held, held_n, spilling = [], 0, True
                if cut == 0:
                    continue
            else:
                end = 0
            if held:
                yield from whole(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield from whole(t[end:cut], k[end:cut], fp[end:cut])
            held, held_n, spilling = [(t[cut:], k[cut:], fp[cut:])], len(fp) - cut, False
            last = (t[-1], k[-1])
        if held:
            yield from whole(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def fingerprint_links(distinct: DataFrame, most: int, scratch: Scratch, tile: int = 1 << 14) -> DataFrame:
    """``distinct(fp)`` without repeats to links ``(a, b)`` that connect all fingerprints within ``most`` bits."""
    if most != 4:
        raise ValueError("the six blocks in pairs are laid out for four differing bits")
    spark, n = distinct.sparkSession, shuffle_partitions(distinct.sparkSession)
    schema = "a long, b long, k0 long, k1 long"
    tables = F.array(
        *(F.struct(F.lit(t).cast("long").alias("k0"), F.col("fp").bitwiseAND(F.lit(m)).alias("k1")) for t, m in enumerate(_keys(BLOCKS, 2)))
    )
    rows = distinct.select("fp", F.explode(tables).alias("k")).select("fp", "k.k0", "k.k1")
    dealt = rows.repartition(n, "k0", "k1").sortWithinPartitions("k0", "k1", "fp")
    found = scratch.cut(dealt.mapInArrow(_bucket_links(most, tile, ["k0", "k1"]), schema), "buckets")
    large = found.filter("b is null").select("k0", "k1", F.col("a").alias("fp"))
    links = found.filter("b is not null").select("a", "b")
    sizes = large.groupBy("k0", "k1").agg(F.count("*").alias("n")).filter(F.col("n") > 0)
    if not sizes.head(1):
        return links
    parts = large.join(sizes, ["k0", "k1"]).select(
        "k0", "k1", "fp", F.ceil(F.col("n") * 2 / tile).cast("int").alias("g")
    ).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    tiled = parts.select(
        "fp",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("g") - 1),
                lambda j: F.xxhash64("k0", "k1", F.least("i", j), F.greatest("i", j)),
            )
        ).alias("k1"),
        F.lit(0).cast("long").alias("k0"),
    )
    dealt = tiled.repartition(n, "k1").sortWithinPartitions("k1", "fp")
    more = dealt.mapInArrow(_bucket_links(most, 1 << 62, ["k0", "k1"]), schema).select("a", "b")
    return links.unionAll(scratch.cut(more, "tiles"))


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    most: int = 4,
    scratch: Scratch | None = None,
    tile: int = 1 << 14,
) -> DataFrame:
    """One row per input row: id, row_hash, fingerprint (hex), component_id, is_first.

    component_id is the least id among the rows linked to this one through any chain of fingerprints within ``most``
    bits; is_first marks one row of each component (rows that repeat both id and text are marked together).
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_hash"),
        F.col(text_col).cast("binary").alias("text"),
    )
    fps = scratch.cut(rows.mapInArrow(_fingerprints(width), "id long, row_hash long, fp long"), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row_hash")
    nodes = scratch.cut(fps.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    cc = connected_components(fingerprint_links(nodes.select("fp"), most, scratch, tile), scratch)
    rooted = nodes.join(cc, nodes.fp == cc.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("group_first"))
    by_fp = rooted.join(firsts, "root").select("fp", "group_first")
    return join_heavy(fps, scratch.cut(by_fp, "by-fp"), ["fp"]).select(
        "id",
        "row_hash",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("group_first.id").alias("component_id"),
        (F.col("group_first.id").eqNullSafe(F.col("id")) & (F.col("group_first.row_hash") == F.col("row_hash"))).alias(
            "is_first"
        ),
    )
