import random

import numpy as np
import xxhash

from strataloom.llm.simhash import fingerprint, fingerprint_links, links_within, simhash_groups
from strataloom.runtime import Scratch


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_groups(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_slow():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("Aa bÉ c\t dd\n e".split(" ")) for _ in range(rng.randrange(700))) for _ in range(60)]
    for t in [*texts, "", " \n", "one", "one two three", None, "é " * 40]:
        assert fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)


def test_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    for n, centres in ((40, 3), (300, 2), (120, 100)):
        base = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
        fps = base[rng.integers(0, centres, n)]
        for _ in range(5):
            fps = fps ^ (np.uint64(1) << rng.integers(0, 63, n).astype(np.uint64))
        a, b = links_within(fps, 4)
        assert (np.bitwise_count(fps[a] ^ fps[b]) <= 4).all()
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
        assert [find(i) for i in range(n)] == slow_groups([int(x) for x in fps])


def test_groups_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.id: r for r in simhash_groups(docs).collect()}
    fps = [slow_fingerprint(t) for _, t in rows]
    for (i, _), fp, root in zip(rows, fps, slow_groups(fps), strict=True):
        assert got[i].fingerprint == f"{fp:016x}"
        assert got[i].component_id == rows[root][0]


def test_large_buckets_are_tiled(spark):
    rng = np.random.default_rng(5)
    fps = np.unique(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 40, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = fingerprint_links(df, 4, Scratch(spark), tile=16).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        p, q = find(at[r.a]), find(at[r.b])
        root[max(p, q)] = min(p, q)
    assert [find(i) for i in range(len(fps))] == slow_groups([int(x) for x in fps])


def test_odd_rows(spark):
    schema = "doc_id long, text string, id long, fp string, component_id long, lang string"
    rows = [(7, None), (3, ""), (5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, None), (9, "z " * 30000)]
    df = spark.createDataFrame([(i, t, 1, "x", 2, None) for i, t in rows], schema)
    got = simhash_groups(df).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {3}
    assert sorted((r.id or -1) for r in got if r.component_id == 5) == [-1, 5, 5]
    assert simhash_groups(df.limit(0)).count() == 0
