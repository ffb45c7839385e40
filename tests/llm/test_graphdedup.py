import duckdb
import numpy as np

from strataloom.llm import graphdedup
from strataloom.llm.graphdedup import in_range, linked, robust_prune, united_graph, vector_groups
from strataloom.llm.queries import ORACLE_SQL, op5_vector_dedup


def clustered(rng, n, groups, dim=32, noise=0.05):
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_pruned_graph_keeps_the_nearest():
    x = clustered(np.random.default_rng(1), 200, 40)
    near = robust_prune(x)
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    assert (near[:, 0] == sim.argmax(axis=1)).all()


def test_search_finds_what_is_in_range():
    rng = np.random.default_rng(2)
    x = clustered(rng, 3000, 900)
    adjacency, medoids = united_graph(x)
    q, r = in_range(x, x[:300], adjacency, medoids, 24, 0.9)
    want = {(i, j) for i, j in zip(*np.nonzero(x[:300] @ x.T >= 0.9), strict=True)}
    got = set(zip(q.tolist(), r.tolist(), strict=True))
    assert got <= want and len(got) >= 0.97 * len(want)


def test_scan_and_graph_agree():
    rng = np.random.default_rng(3)
    x = clustered(rng, 900, 60).astype(np.float32)
    cells, here, weight = np.zeros((900, 1), np.int64), np.zeros(900, np.int64), np.ones(900, np.int64)
    a, _ = linked(x, cells, here, weight, 0.9, 24)
    b, root = linked(x, cells, here, weight, 0.9, None)
    assert (a <= b).all() and a.sum() >= 0.98 * b.sum()
    sim = x.astype(float) @ x.T.astype(float)
    assert abs(int((sim >= 0.9).sum()) - 900 - int(b.sum())) <= 2


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op5_vector_dedup"]).fetchall())
    assert sorted(tuple(r) for r in op5_vector_dedup(spark, sf).collect()) == want


def test_several_clusters_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(graphdedup, "CLUSTER", 150)
    rng = np.random.default_rng(4)
    x = clustered(rng, 1200, 300, noise=0.03).astype(np.float32)
    label = rng.integers(0, 2, 1200)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {r.id: r for r in vector_groups(df).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    m = (y @ y.T >= 0.98) & (label[:, None] == label)
    want = m.sum(axis=1) - 1
    have = np.array([got[i].n_links for i in range(1200)])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()


def test_odd_rows(spark):
    e = [0.0] * 63
    a, b = [1.0, *e], [1.0, 0.01, *e[1:]]
    rows = [(1, a, 1), (2, b, 1), (2, b, 1), (3, b, None), (4, None, 1), (5, [0.0, *e], 1), (6, [float("nan"), *e], 1), (7, [None, *e], 1), (None, a, 1), (8, a, 2), (9, a[:5], 1), (10, [], 1)]
    df = spark.createDataFrame([(i, v, k, "x") for i, v, k in rows], "vec_id long, embedding array<float>, label int, node string")
    got = sorted(((r.id or 0), r.n_links, r.component_id, r.kept) for r in vector_groups(df).collect())
    assert got == [(0, 3, 1, False), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False)] + [(k, 0, k, True) for k in range(3, 11)]
    assert vector_groups(df.limit(0)).count() == 0
