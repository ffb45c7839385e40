"""Groups of near copies: SimHash links as in ``simhash``, and texts whose five-word shingle sets are alike.

Each text's distinct shingles give BANDS x ROWS least hashes. Texts that agree on a whole band meet; at a similarity of 0.8
a pair misses every band once in 2,900 times, above that less often. Of those that meet, pairs whose least hashes agree
often enough are held against each other by their whole shingle sets, so a link is never a guess. Equal shingle sets are
merged first. Large buckets first hold each text against a few leaders only, those in the middle of the bucket; all pairs
that this leaves in different groups are compared in a second round, with their shingle sets at hand, and only the links
that bring groups together leave it: dense groups cost few rows, and a chain is not broken.

Rows: texts without words have no shingles and link by their fingerprint only. Nulls, repeats and ids as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.components import connected_components
from strataloom.llm.heavy import join_heavy
from strataloom.llm.simhash import fingerprint, fingerprint_links
from strataloom.runtime import Scratch, shuffle_partitions

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 20, 5
#: Least hashes that may disagree beyond what ``least`` lets expect: over three standard deviations of an estimate.
MARGIN = 0.13
SMALL, LEADERS = 8, 4
#: Shingle sets of up to so many travel whole with the texts of dense buckets.
WHOLE = 512
_TIMES = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct word shingles, in order; of a shorter text its words as one."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams)))


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        out = np.minimum(out, (shingles[at : at + 1024, None] * _TIMES).min(axis=0))
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, sets, sigs, bands = [], [], [], []
        for text in batch.column("text"):
            data = text.as_py()
            fps.append(fingerprint(data))
            s = shingle_set(data)
            if not len(s):
                sets.append(None)
                sigs.append(None)
                bands.append(None)
                continue
            least = least_hashes(s)
            sets.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
            sigs.append((least >> np.uint64(20)).astype(np.uint8).tobytes())
            bands.append([xxhash.xxh3_64_intdigest(least[k * ROWS : k * ROWS + ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("row_hash"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sets, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["id", "row_hash", "fp", "shingled", "sig", "bands"],
        )


def _meeting(least: float):
    """Over rows in order of band: the pairs to verify. Rows of one root (second round) are not compared again."""
    enough = least - MARGIN

    def led(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leader, other) places: the row nearest to what most rows have leads, then that among the rows left, and so on.

        A row is led by at most LEADERS others, and by none after one that it is ``least`` like by the estimate.
        """
        n = len(sig)
        free, times = np.ones(n, bool), np.zeros(n, np.int64)
        left, right = [], []
        while free.sum() > 1:
            rows = np.flatnonzero(free)
            some = sig[rows]
            usual = np.array([np.bincount(c, minlength=256).argmax() for c in some.T], np.uint8)
            leader = rows[(some == usual).mean(axis=1).argmax()]
            free[leader] = False
            other = rows[rows != leader]
            like = (sig[other] == sig[leader]).mean(axis=1)
            near = other[like >= enough]
            times[near] += 1
            free[other[like >= least]] = False
            free[times >= LEADERS] = False
            left.append(np.full(len(near), leader))
            right.append(near)
        return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2

    def pairs(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(node) > SMALL:
            a, b = led(sig)
        else:
            a, b = np.triu_indices(len(node), 1)
            near = (sig[a] == sig[b]).mean(axis=1) >= enough
            a, b = a[near], b[near]
        return node[a], node[b]

    def joined(t: pa.Table, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, sure) of a bucket whose rows have several roots: every pair of rows of different roots is looked at.

        Where both shingle sets are whole, ``sure`` links are found here, and only those that bring groups together are
        given. Other pairs that the estimate allows are to be verified.
        """
        node, size = t.column("shingled").to_numpy(), t.column("size").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("feats")]
        root = np.unique(t.column("root").to_numpy(), return_inverse=True)[1]
        common = np.bincount(root).argmax()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(root != common):
            other = np.flatnonzero(root != root[i])
            near = other[(sig[other] == sig[i]).mean(axis=1) >= enough]
            if not len(near):
                continue
            whole = near[(size[near] <= WHOLE) & (size[i] <= WHOLE)]
            if len(whole):
                hits = np.isin(np.concatenate([sets[j] for j in whole]), sets[i])
                shared = np.add.reduceat(hits, np.concatenate(([0], np.cumsum(size[whole])[:-1])), dtype=np.int64)
                for j in whole[shared / (size[whole] + size[i] - shared) >= least].tolist():
                    if root[j] != root[i]:
                        out.append((node[[i]], node[[j]], np.array([True])))
                        root[root == root[i]] = root[j]
            part = near[(size[near] > WHOLE) | (size[i] > WHOLE)]
            part = part[(root[part] != root[i])]
            out.append((np.full(len(part), node[i]), node[part], np.zeros(len(part), bool)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))

    def solve(parts: list[pa.RecordBatch], second: bool) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        a, b, sure = joined(t, sig) if second else (*pairs(t.column("shingled").to_numpy(), sig), None)
        sure = np.zeros(len(a), bool) if sure is None else sure
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure)], names=["a", "b", "sure"])

    def rounds(second: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            size, last = 0, None
            for batch in batches:
                band = batch.column("band").to_numpy()
                cuts = [0, *(np.flatnonzero(band[1:] != band[:-1]) + 1).tolist(), len(band)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b == a:
                        continue
                    if held and band[a] != last:
                        if size > 1:
                            yield solve(held, second)
                        held, size = [], 0
                    held.append(batch.slice(a, b - a))
                    size, last = size + b - a, band[a]
            if size > 1:
                yield solve(held, second)

        return run

    return rounds


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("of_a", "of_b")]
            ok = pa.array([jaccard(x, y) >= least for x, y in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(ok)

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("shingled"), pa.array(sets, pa.binary())], names=["shingled", "feats"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column("text")]
        kept = [x.tobytes() if len(x) <= WHOLE else b"" for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column("shingled"), pa.array([len(x) for x in sets], pa.int64()), pa.array(kept, pa.binary())], names=["shingled", "size", "feats"])


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: id, row_hash, component_id (least id of the group), is_first."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_hash"), F.col(text_col).cast("binary").alias("text")
    )
    schema = "id long, row_hash long, fp long, shingled long, sig binary, bands array<long>"
    described = scratch.cut(rows.mapInArrow(_described, schema), "described")
    sets = described.filter("shingled is not null").groupBy("shingled").agg(F.min_by(F.struct("row_hash", "sig", "bands"), "row_hash").alias("r"))
    sets = scratch.cut(sets.select("shingled", "r.*"), "sets")
    banded = sets.select("shingled", "sig", F.explode("bands").alias("band"))
    meet = _meeting(least)

    def texts_of(some: DataFrame) -> DataFrame:
        chosen = sets.select("shingled", "row_hash").join(some.select("shingled").distinct(), "shingled", "left_semi")
        return rows.join(chosen, "row_hash").select("shingled", "text").dropDuplicates(["shingled"])

    def met(bucketed: DataFrame, second: bool) -> DataFrame:
        """The links among the rows of each band's bucket."""
        dealt = bucketed.repartition(shuffle_partitions(spark), "band").sortWithinPartitions("band", "shingled")
        found = scratch.cut(dealt.mapInArrow(meet(second), "a long, b long, sure boolean").distinct(), "candidates")
        open_ = found.filter("not sure").select("a", "b")
        feats = texts_of(open_.select(F.explode(F.array("a", "b")).alias("shingled"))).mapInArrow(_shingled, "shingled long, feats binary")
        feats = scratch.cut(feats, "shingles", "zstd")
        with_a = join_heavy(open_.withColumnRenamed("a", "shingled"), feats, ["shingled"]).select(F.col("shingled").alias("a"), "b", F.col("feats").alias("of_a"))
        both = with_a.join(feats.select(F.col("shingled").alias("b"), F.col("feats").alias("of_b")), "b")
        links = scratch.cut(found.filter("sure").select("a", "b").unionAll(both.mapInArrow(_alike(least), "a long, b long")), "alike")
        scratch.drop(found, feats)
        return links

    first = met(banded, False)
    so_far = scratch.cut(connected_components(first, scratch), "so-far")
    rooted = banded.join(so_far, banded.shingled == so_far.node, "left").select("shingled", "sig", "band", F.coalesce("root", "shingled").alias("root"))
    # small buckets were compared in full, and where all have one root nothing is left to find
    dense = rooted.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter(f"n > {SMALL} and low <> high")
    rooted = scratch.cut(join_heavy(scratch.cut(rooted, "rooted"), dense.select("band"), ["band"]), "dense")
    whole = scratch.cut(texts_of(rooted).mapInArrow(_whole_sets, "shingled long, size long, feats binary"), "whole-sets", "zstd")
    links = first.unionAll(met(rooted.join(whole, "shingled"), True))

    name = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c))
    by_bits = fingerprint_links(described.select("fp").distinct(), 4, scratch)
    of_row = described.filter("shingled is not null").select("fp", "shingled").distinct()
    graph = (
        links.select(name("s", "a").alias("a"), name("s", "b").alias("b"))
        .unionAll(by_bits.select(name("f", "a").alias("a"), name("f", "b").alias("b")))
        .unionAll(of_row.select(name("s", "shingled").alias("a"), name("f", "fp").alias("b")))
    )
    cc = connected_components(graph, scratch)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row_hash")
    nodes = scratch.cut(described.groupBy("fp").agg(F.min(order).alias("first")), "firsts")
    rooted = nodes.withColumn("node", name("f", "fp")).join(cc, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("group_first"))
    by_fp = scratch.cut(rooted.join(firsts, "root").select("fp", "group_first"), "by-fp")
    return join_heavy(described.select("id", "row_hash", "fp"), by_fp, ["fp"]).select(
        "id",
        "row_hash",
        F.col("group_first.id").alias("component_id"),
        (F.col("group_first.id").eqNullSafe(F.col("id")) & (F.col("group_first.row_hash") == F.col("row_hash"))).alias("is_first"),
    )
