import random

import corpus_pipeline
from strataloom.llm.nearcopies import jaccard, near_copy_groups, shingle_set
from strataloom.llm.simhash import fingerprint


def components(texts):
    """Least place of each text's group, by every pair."""
    sets, fps = [shingle_set(t.encode()) for t in texts], [fingerprint(t.encode()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 or jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def made(rng):
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        for _ in range(rng.choice([1, 2, 4, 14])):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(9999)}"
    rng.shuffle(texts)
    return [*texts, "one", "one", "", "one two three"]


def test_groups_are_those_of_all_pairs(spark):
    texts = made(random.Random(1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in near_copy_groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)


def test_stage_keeps_one_of_two_far_fingerprints(spark, sf):
    rng = random.Random(2)
    rows, n = [], 0
    while n < 20:
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        other = list(words)
        other[30], other[70] = "x", "y"
        a, b = " ".join(words), " ".join(other)
        if (fingerprint(a.encode()) ^ fingerprint(b.encode())).bit_count() > 4:
            assert jaccard(shingle_set(a.encode()), shingle_set(b.encode())) >= 0.8
            rows += [(2 * n, a, "en", "s", len(a)), (2 * n + 1, b, "en", "s", len(b))]
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())
    assert kept == list(range(0, 40, 2))
