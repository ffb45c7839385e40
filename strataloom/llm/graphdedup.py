"""Near-duplicate vectors by robust-pruned graphs.

Vectors that may be compared (same label, same dimension) are dealt to their two nearest of the label's clusters, so the
clusters overlap. Each cluster is one task's work: its members are dealt again to small overlapping shards; in every
shard each vector's nearest are pruned robustly (a candidate goes if one already chosen is nearer to it, by a factor,
than the vector itself); the shards' adjacency lists are united. Then every member is looked for in that graph: a greedy
search with a beam starts from the shards' medoids, and from what it meets within range the search expands through the
graph for as long as new vectors within range turn up. What it finds is verified in double precision. A link found in
both clusters of two vectors counts in the first of them only. Tasks return counts and, for each vector, one linked
vector of its group, never pairs; groups join up as connected components.

A bounded audit holds a sample of vectors against all rows; if it finds under ``recall`` of their links, the search is
done again with a beam twice as wide, and at last exactly: each vector is also held against every other cluster that its
angle to the centroid, the cluster's radius and ``least`` allow to hold a linked vector. Less than ``recall`` is an error.

Equal vectors of a label are merged first and weighed by their number, so copies, however many, cost one.

Clusters are fitted on at most SAMPLE vectors of all labels together, and there are at most MOST_CLUSTERS of them, so
what is broadcast is bounded. Beyond that clusters grow.

Rows: null, zero or non-finite vectors, and those with a null label, link with nothing. A null id takes no part in the
least id of its group; alone it has a null component and is kept. Rows that repeat an id are vectors of their own. An empty
table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.components import connected_components
from strataloom.llm.heavy import join_heavy
from strataloom.llm.vectors import k_means, matrix, nearest_centroids, usable
from strataloom.runtime import Scratch, shuffle_partitions

log = logging.getLogger(__name__)

SAMPLE, MOST_CLUSTERS, CLUSTER, SHARD = 40_000, 4096, 1024, 512
DEGREE, CANDIDATES, ALPHA, BEAM = 14, 40, 1.2, 24
FAR_DEGREE, FAR_CANDIDATES = 8, 32
AUDIT = 600
CHUNK = 4096


def robust_prune(
    x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA, far: int = FAR_DEGREE
) -> np.ndarray:
    """Neighbours of each row of unit vectors, filled up with -1.

    Nearest rows are pruned to ``degree``, and as many random rows as FAR_CANDIDATES to ``far``: in a tight group the
    nearest alone would leave no way in.
    """
    n = len(x)
    if n < 2:
        return np.full((n, degree + far), -1, np.int64)
    apart = np.sqrt(np.maximum(2 - 2 * (x @ x.T), 0))
    np.fill_diagonal(apart, np.inf)
    take = min(candidates, n - 1)
    near = np.argpartition(apart, take - 1, axis=1)[:, :take]
    some = np.random.default_rng(n).integers(0, n, (n, min(FAR_CANDIDATES, n)))
    return np.concatenate([_pruned(apart, near, degree, alpha), _pruned(apart, some, far, alpha)], axis=1)


def _pruned(apart: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    gap = np.take_along_axis(apart, near, axis=1)
    order = gap.argsort(axis=1, kind="stable")
    near, gap = np.take_along_axis(near, order, axis=1), np.take_along_axis(gap, order, axis=1)
    alive = np.isfinite(gap)
    rows = np.arange(len(near))
    out = np.full((len(near), degree), -1, np.int64)
    for k in range(min(degree, near.shape[1])):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        chosen = near[rows, first]
        out[some, k] = chosen[some]
        between = apart[chosen[:, None], near]
        between[chosen[:, None] == near] = 0
        alive &= ~((alpha * between <= gap) & some[:, None])
    return out


def united_graph(x: np.ndarray, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(adjacency filled up with -1, medoids) of rows of unit vectors, from overlapping shards."""
    n = len(x)
    cells = -(-n // shard)
    centroids = k_means(x, cells) if cells > 1 else x.mean(axis=0, keepdims=True)
    of = nearest_centroids(x, centroids, 2)
    heads, tails, medoids = [], [], []
    for c in range(len(centroids)):
        whole = np.flatnonzero((of == c).any(axis=1))
        for members in np.array_split(whole, max(1, -(-len(whole) // (4 * shard)))):
            if not len(members):
                continue
            part = x[members]
            medoids.append(int(members[(part @ part.mean(axis=0)).argmax()]))
            near = robust_prune(part)
            a, k = np.nonzero(near >= 0)
            heads.append(members[a])
            tails.append(members[near[a, k]])
    head, tail = np.concatenate(heads), np.concatenate(tails)
    both = np.unique(np.concatenate([head * n + tail, tail * n + head]))  # edges run both ways
    head, tail = both // n, both % n
    place = np.arange(len(head)) - np.searchsorted(head, head)
    adjacency = np.full((n, int(place.max(initial=-1)) + 1), -1, np.int32)
    adjacency[head, place] = tail
    return adjacency, np.array(sorted(set(medoids)))


def in_range(x: np.ndarray, queries: np.ndarray, adjacency: np.ndarray, medoids: np.ndarray, beam: int, least: float):
    """(query, row) pairs with a dot product of about ``least`` or more that greedy search and expansion meet."""
    b, n = len(queries), len(x)
    seen = np.zeros((b, n), bool)
    rows = np.arange(b)
    start = medoids[:: max(1, len(medoids) // beam)][: 4 * beam]
    seen[:, start] = True
    ids = np.tile(start, (b, 1))
    sim = queries @ x[start].T
    done = np.zeros_like(ids, bool)
    found_q, found_r = [], []

    def note(q: np.ndarray, r: np.ndarray, s: np.ndarray) -> None:
        hit = s >= least
        found_q.append(q[hit])
        found_r.append(r[hit])

    note(np.repeat(rows, len(start)), ids.ravel(), sim.ravel())
    while adjacency.shape[1]:
        best = np.where(done, -np.inf, sim).argmax(axis=1)
        live = rows[~done[rows, best] & (sim[rows, best] > -np.inf)]
        if not len(live):
            break
        done[live, best[live]] = True
        near = adjacency[ids[live, best[live]]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        q, k = np.nonzero(fresh)
        r, q = near[q, k], live[q]
        seen[q, r] = True
        s = np.einsum("ij,ij->i", queries[q], x[r])
        note(q, r, s)
        new_ids = np.zeros((b, near.shape[1]), ids.dtype)
        new_sim = np.full((b, near.shape[1]), -np.inf)
        new_ids[q, k], new_sim[q, k] = r, s
        ids, sim = np.concatenate([ids, new_ids], axis=1), np.concatenate([sim, new_sim], axis=1)
        done = np.concatenate([done, np.zeros_like(new_ids, bool)], axis=1)
        if sim.shape[1] > beam:
            top = np.argpartition(-sim, beam - 1, axis=1)[:, :beam]
            ids, sim, done = (np.take_along_axis(a, top, axis=1) for a in (ids, sim, done))
    q, r = np.concatenate(found_q), np.concatenate(found_r)
    frontier_q, frontier_r = q, r
    while len(frontier_q) and adjacency.shape[1]:
        near = adjacency[frontier_r]
        a, k = np.nonzero(near >= 0)
        pair = np.unique(frontier_q[a] * np.int64(n) + near[a, k])
        nq, nr = pair // n, pair % n
        fresh = ~seen[nq, nr]
        nq, nr = nq[fresh], nr[fresh]
        seen[nq, nr] = True
        hit = np.einsum("ij,ij->i", queries[nq], x[nr]) >= least
        frontier_q, frontier_r = nq[hit], nr[hit]
        q, r = np.concatenate([q, frontier_q]), np.concatenate([r, frontier_r])
    return q, r


def linked(vectors: np.ndarray, cells: np.ndarray, here: np.ndarray, weight: np.ndarray, least: float, beam: int | None, home: np.ndarray | None = None):
    """(links counted here, a linked row of the same group) for the members of one cluster. No beam: scan.

    With ``home``, all links of the rows at home count, and no others.
    """
    x = vectors.astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    n = len(x)
    counts, root = np.zeros(n, np.int64), np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    adjacency, medoids = united_graph(x) if beam else (None, None)
    rows = np.arange(n) if home is None else np.flatnonzero(home)
    for a in range(0, len(rows), 256):
        of = rows[a : a + 256]
        part = x[of]
        if beam:
            q, r = in_range(x, part, adjacency, medoids, beam, least - 1e-9)
            s = np.einsum("ij,ij->i", part[q], x[r])
        else:
            s = part @ x.T
            q, r = np.nonzero(s >= least - 1e-9)
            s = np.einsum("ij,ij->i", part[q], x[r])
        ok = (s >= least) & (of[q] != r)
        q, r = of[q[ok]], r[ok]
        # of two clusters that both hold both vectors, the lesser number counts
        low = np.full(len(q), np.iinfo(np.int64).max) if home is None else here[q]
        for i in range(cells.shape[1] if home is None else 0):
            for j in range(cells.shape[1]):
                low = np.where((cells[q, i] == cells[r, j]) & (cells[q, i] >= 0), np.minimum(low, cells[q, i]), low)
        mine = low == here[q]
        np.add.at(counts, q[mine], weight[r[mine]])
        first = np.unique(q, return_index=True)[1] if len(q) else np.empty(0, np.int64)
        fewer = np.zeros(len(q), bool)
        fewer[first] = True
        roots = root[r]
        fewer |= roots != root[q]
        for i, j in zip(q[fewer].tolist(), r[fewer].tolist(), strict=True):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
        root = np.array([find(i) for i in range(n)]) if fewer.any() else root
    return counts, np.array([find(i) for i in range(n)])


def _assign(centroids: dict[tuple[int, int], tuple[int, np.ndarray]]):
    """Adds the numbers of the two nearest clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            cells = np.full((batch.num_rows, 2), -1, np.int64)
            groups: dict[tuple[int, int], list[int]] = {}
            for i, key in enumerate(zip(label, dim, strict=True)):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                base, c = centroids[key]
                x = matrix(batch.column("vector").take(pa.array(rows))).astype(np.float64)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                near = nearest_centroids(x, c, 2) + base
                cells[rows, : near.shape[1]] = near
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(cells), pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"]
            )

    return run


def _angles(vectors: pa.ChunkedArray | pa.Array, c: np.ndarray) -> np.ndarray:
    x = matrix(vectors).astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    c = c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-300)
    return np.arccos(np.clip(x @ c.T, -1, 1))


def _keyed(batch: pa.RecordBatch, centroids) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, first cell, angles to the centroids) for each label and dimension of a batch."""
    label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
    for lab, d in sorted(set(zip(label.tolist(), dim.tolist(), strict=True))):
        rows = np.flatnonzero((label == lab) & (dim == d))
        base, c = centroids[lab, d]
        yield rows, base, _angles(batch.column("vector").take(pa.array(rows)), c)


def _radii(centroids):
    """Of each batch, (cell, members nearest to it, the largest angle of one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, base, angles in _keyed(batch, centroids):
                own = angles.argmin(axis=1)
                cells, counts = np.unique(own, return_counts=True)
                far = np.zeros(angles.shape[1])
                np.maximum.at(far, own, angles[np.arange(len(own)), own])
                yield pa.RecordBatch.from_arrays([pa.array(cells + base), pa.array(counts), pa.array(far[cells])], names=["cell", "n", "radius"])

    return run


def _visits(centroids, radii: np.ndarray, chunks: np.ndarray, least: float):
    """One row for each cell and chunk that may hold vectors linked with a vector; at home in one of them."""
    reach = np.arccos(min(1.0, least)) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            for rows, base, angles in _keyed(batch, centroids):
                own, k = angles.argmin(axis=1), angles.shape[1]
                for at in range(int(chunks[base : base + k].max())):
                    i, c = np.nonzero((angles <= radii[base : base + k] + reach) & (chunks[base : base + k] > at))
                    cell = c + base
                    home = (own[i] == c) & (node[rows[i]] % chunks[cell] == at)
                    for a in range(0, len(i), 10_000):
                        part = slice(a, a + 10_000)
                        taken = pa.array(rows[i[part]])
                        columns = [batch.column(n).take(taken) for n in ("node", "vector", "weight")]
                        place = cell[part] << 32 | at
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(place), pa.array(home[part])], names=["node", "vector", "weight", "cell", "home"])

    return run


def every_link(nodes: DataFrame, centroids, least: float) -> DataFrame:
    """(node, n, peer) of all links: nothing within ``least`` of a vector lies in a cell that it does not visit."""
    n_cells = sum(len(c) for _, c in centroids.values())
    radii, counts = np.full(n_cells, -np.inf), np.zeros(n_cells, np.int64)
    found = nodes.mapInArrow(_radii(centroids), "cell long, n long, radius double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    for r in found.collect():
        radii[r.cell], counts[r.cell] = r.radius, r.n
    chunks = -(-counts // CHUNK)
    placed = nodes.mapInArrow(_visits(centroids, radii, chunks, least), "node long, vector array<float>, weight long, cell long, home boolean")
    dealt = placed.repartition(shuffle_partitions(nodes.sparkSession), "cell").sortWithinPartitions("cell", "node")
    return dealt.mapInArrow(_search(least, None), "node long, n long, peer long")


def _search(least: float, beam: int | None):
    names = ["node", "n", "peer"]

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        node = t.column("node").to_numpy()
        here = t.column("cell").to_numpy()
        home = None if beam else t.column("home").to_numpy()
        cells = matrix(t.column("cells")) if beam else here[:, None]
        counts, root = linked(matrix(t.column("vector")), cells, here, t.column("weight").to_numpy(), least, beam, home)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(counts), pa.array(node[root])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b == a:
                    continue
                if held and cell[a] != last:
                    yield solve(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = cell[a]
        if held:
            yield solve(held)

    return run


def _audit(sample: list[tuple[int, int, np.ndarray]], least: float):
    """For each audited vector, how many vectors of these rows it links with, by weight."""
    by: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for node, label, v in sample:
        by.setdefault((label, len(v)), []).append((node, v / np.sqrt(v @ v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            nodes, counts = [], []
            for (lab, d), listed in by.items():
                rows = np.flatnonzero((label == lab) & (dim == d))
                if not len(rows):
                    continue
                x = matrix(batch.column("vector").take(pa.array(rows))).astype(np.float64)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                weight = batch.column("weight").to_numpy()[rows]
                own = batch.column("node").to_numpy()[rows]
                names = np.array([node for node, _ in listed])
                hits = (x @ np.stack([v for _, v in listed]).T >= least) & (own[:, None] != names)
                nodes += names.tolist()
                counts += (weight @ hits).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(counts, pa.int64())], names=["node", "n"])

    return run


def vector_groups(
    rows: DataFrame,
    least: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    recall: float = 0.97,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark)
    all_rows = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<float>").alias("vector")
    ).withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull())
    key = F.xxhash64("label", "vector")
    good = all_rows.filter("ok").groupBy("label", "vector").agg(F.count("*").alias("weight"), F.min("id").alias("least_id"))
    nodes = scratch.cut(good.select(key.alias("node"), "label", F.size("vector").alias("dim"), "vector", "weight", "least_id"), "nodes")
    counts = {(r.label, r.dim): r.n for r in nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).orderBy("label").limit(MOST_CLUSTERS + 1).collect()}
    if len(counts) > MOST_CLUSTERS:
        raise ValueError(f"over {MOST_CLUSTERS} labels: compare them by hashing the label instead")
    n_all = sum(counts.values())
    if not n_all:
        return all_rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    fitted = nodes.filter(F.pmod(F.col("node"), F.lit(max(1, n_all // SAMPLE))) == 0).select("label", "dim", "vector").orderBy(F.xxhash64("vector")).limit(2 * SAMPLE)
    got = fitted.toArrow()
    centroids: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    labels, dims = got.column("label").to_numpy(), got.column("dim").to_numpy()
    base = 0
    for (label, dim), n in sorted(counts.items()):
        of = np.flatnonzero((labels == label) & (dims == dim))
        k = max(1, min(-(-n // CLUSTER), MOST_CLUSTERS * n // n_all, len(of)))
        if len(of):
            x = matrix(got.column("vector").take(pa.array(of))).astype(np.float64)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            c = k_means(x, k, seed=1)
        else:
            c = np.zeros((1, dim))
        centroids[label, dim] = (base, c)
        base += len(c)
    schema = "node long, label long, dim int, vector array<float>, weight long, least_id long, cells array<long>"
    dealt = nodes.mapInArrow(_assign(centroids), schema)
    members = dealt.select("node", "vector", "weight", "cells", F.explode(F.array_distinct("cells")).alias("cell")).filter("cell >= 0")
    members = scratch.cut(members.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell", "node"), "members")
    audited = nodes.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(AUDIT).collect()
    sample = [(r.node, r.label, np.array(r.vector, np.float64)) for r in audited]
    truth = {r.node: r.n for r in nodes.mapInArrow(_audit(sample, least), "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}
    for beam in (BEAM, 2 * BEAM, 4 * BEAM, None):
        by_cell = members.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell", "node")
        links = by_cell.mapInArrow(_search(least, beam), "node long, n long, peer long") if beam else every_link(nodes, centroids, least)
        found = scratch.cut(links, "found")
        total = found.groupBy("node").agg(F.sum("n").alias("n"))
        seen = {r.node: r.n for r in total.join(F.broadcast(spark.createDataFrame([(n,) for n, *_ in sample], "node long")), "node").collect()}
        hits = sum(min(seen.get(k, 0), n) for k, n in truth.items())
        reached = hits / sum(truth.values()) if sum(truth.values()) else 1.0
        log.info("beam %s: recall %.4f of the links of %d audited vectors", beam, reached, len(sample))
        if reached >= recall:
            break
        if beam is None:
            raise RuntimeError(f"recall {reached:.4f} of the audited links, under {recall}")
        scratch.drop(found)
    cc = connected_components(found.filter("node <> peer").select(F.col("node").alias("a"), F.col("peer").alias("b")), scratch)
    rooted = nodes.select("node", "weight", "least_id").join(cc, "node", "left").select("node", "weight", "least_id", F.coalesce("root", "node").alias("root"))
    leasts = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_node = rooted.join(leasts, "root").join(total, "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    by_node = scratch.cut(by_node, "by-node")
    keyed = all_rows.select("id", F.when(F.col("ok"), key).alias("node"))
    joined = join_heavy(keyed, by_node, ["node"], "left")
    return joined.select(
        "id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
