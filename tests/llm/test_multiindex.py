import numpy as np
from pyspark.sql import functions as F

from strataloom.llm import multiindex
from strataloom.llm.multiindex import MultiIndex, fit_codes, hamming, nearest
from strataloom.llm.queries import op10_neighbours


def brute(ids, x, asks, k=10):
    out = {}
    for i in np.flatnonzero(asks):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_probing_meets_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 60))
    codes = fit_codes(x).of(x)
    assert codes.shape == (700, 4)
    index = MultiIndex(codes)
    for radius in (0, 3, 11, 22, 30):
        for i in range(0, 700, 90):
            want = np.flatnonzero(hamming(codes, codes[i]) <= radius)
            assert index.within(codes[i], radius).tolist() == want.tolist()


def check(spark, got, ids, x, asks, k=10, least=0.95):
    want = brute(ids, x, asks, k)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(want)
    hits = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(want[q]) + 1))
        assert [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
        exact = dict(want[q])
        hits += sum(r.vec_id in exact for r in rows)
        where = {int(i): v for i, v in zip(ids, x, strict=True)}
        assert all(abs(r.score - np.sqrt(((where[q] - where[r.vec_id]) ** 2).sum())) < 1e-12 for r in rows)
    assert hits >= least * sum(map(len, want.values()))


def test_recall_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "SHARD", 300)
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    check(spark, op10_neighbours(spark, sf).collect(), ids, x, ids % 100 == 0)


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 7)
    monkeypatch.setattr(multiindex, "SHARD", 40)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.integers(-2, 3, (50, 8)).astype(np.float64), 3, axis=0) * 5
    x[(x == 0).all(axis=1)] = 1
    ids = rng.permutation(150)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    check(spark, nearest(df, F.col("vec_id") % 4 == 0, k=5).collect(), ids, x, ids % 4 == 0, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (100, [2.0, 0.0]), (100, [2.0, 0.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100, 1.0), (0, 2, 100, 1.0), (0, 3, 7, 2**0.5), (100, 1, 0, 1.0), (100, 2, 7, 5**0.5)]
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
