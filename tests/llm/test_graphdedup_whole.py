import numpy as np

from strataloom.llm import graphdedup
from strataloom.llm.graphdedup import vector_groups


def test_links_between_vectors_of_no_common_cluster_count(spark, monkeypatch):
    monkeypatch.setattr(graphdedup, "CLUSTER", 20)
    monkeypatch.setattr(graphdedup, "CHUNK", 16, raising=False)
    rng = np.random.default_rng(1)
    tight = rng.normal(size=(1, 32)) + 0.08 * rng.normal(size=(500, 32))
    x = np.concatenate([tight, rng.normal(size=(300, 32))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (y @ y.T >= 0.98).sum(axis=1) - 1
    assert want.sum() > 100_000
    got = {r.id: r.n_links for r in vector_groups(df).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()
