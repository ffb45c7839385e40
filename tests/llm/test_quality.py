import numpy as np

from strataloom.llm.quality import BAD, GOOD, NOTHING, estimate, fit, score, train, votes_of
from strataloom.llm.queries import op3_quality


def test_accuracies_are_recovered():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    right = [0.95, 0.9, 0.8, 0.7, 0.65]
    patterns = {}
    for t in truth:
        p = "".join(str(NOTHING) if rng.random() < 0.3 else str(int(t if rng.random() < r else not t)) for r in right)
        patterns[p] = patterns.get(p, 0) + 1
    post, table, share = estimate(patterns, prior_good=np.zeros(2), prior_bad=np.zeros(2))
    spoken = table[:, :, :2] / table[:, :, :2].sum(axis=2, keepdims=True)
    assert abs(share - 0.7) < 0.03
    for k, r in enumerate(right):
        assert abs(spoken[k, 1, GOOD] - r) < 0.04 and abs(spoken[k, 0, BAD] - r) < 0.06
    assert post["11111"] > 0.99 > 0.01 > post["00000"]


def test_kept_documents_are_those_labelled_good(spark):
    sf = "/root/testdata/sf0.01"
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op3_quality(spark, sf).collect()
    assert len(rows) == 1000
    pairs = np.array([(good[r.doc_id], r.kept, r.score) for r in rows if r.doc_id in good])
    kept_good = pairs[pairs[:, 0] == 1][:, 1].mean()
    kept_bad = pairs[pairs[:, 0] == 0][:, 1].mean()
    assert kept_good > 0.9 and kept_bad < 0.4


def test_odd_rows(spark):
    rows = [(None, None, 0.5), (1, "", 0.1), (1, "", 0.1), (2, "The cat sat on the mat and it was good. " * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    scorer, *_ = train(df)
    got = score(df, scorer).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    none, posterior, _ = train(df.limit(0))
    assert posterior == {} and score(df.limit(0), none).count() == 0
    assert fit([], []).score("x") == 0.5
    assert len(votes_of(None)) == 10
