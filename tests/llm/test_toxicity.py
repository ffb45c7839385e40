import random
import zlib

import numpy as np

from strataloom.llm.queries import op2_toxicity
from strataloom.llm.toxicity import fit, language, score, train


def made(rng, n):
    good = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(80)]
    texts, labels = [], []
    for k in range(n):
        words = [rng.choice(good) for _ in range(rng.randrange(5, 60))]
        if k % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["zzawful", "zzawfully", "qqhorrid"]))
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    return texts, labels


def test_learns_words_in_long_texts():
    rng = random.Random(1)
    model = fit(*made(rng, 400))
    texts, labels = made(rng, 200)
    got = model.scores(texts) >= 0.5
    assert (got == np.array(labels)).mean() > 0.97
    tail = " ".join(texts[1] for _ in range(3000)) + " zzawful"
    assert model.scores([tail, texts[1], "", None]).round().tolist() == [1, 0, 0, 0]
    # one text at a time, or together, or in pieces: the same
    np.testing.assert_allclose(np.concatenate([model.scores([t]) for t in texts[:40]]), model.scores(texts[:40]), atol=2e-6)


def test_language_of_function_words():
    assert language("the cat of that".split()) == "en" and language("der hund und das".split()) == "de" and language([]) == ""


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op2_toxicity(spark, sf).collect()
    assert len(rows) == 1000
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_odd_rows(spark):
    rows = [(1, None, "x", 0.1), (1, None, "x", 0.1), (None, "", "y", 0.2), (3, "bad " * 50000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = train(docs, none)
    assert [r.score for r in score(docs, model).collect()] == [0.0] * 4
    assert score(docs, model, keep=True).columns == ["doc_id", "text", "lang", "score", "toxicity"]
    assert score(docs.limit(0), model).count() == 0
    fitted = fit(*made(random.Random(2), 80))
    assert len(score(docs, fitted).collect()) == 4
