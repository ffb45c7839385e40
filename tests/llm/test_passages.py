import random
from collections import Counter

import corpus_pipeline
from strataloom.llm.suffixdedup import remove_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)


def staged(spark, texts, sf):
    return {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, frame(spark, texts), sf).collect()}


def test_short_words_of_a_repeated_passage_go(spark, sf):
    rng = random.Random(1)
    own = [[f"w{k}x{i}" for i in range(90)] for k in range(6)]
    passages = {n: [rng.choice("abcdefgh") + rng.choice("ijklm") for _ in range(n)] for n in (50, 51, 80)}
    assert len(" ".join(passages[80])) < 400
    texts, want = [], []
    for k, n in enumerate((51, 51, 80, 80, 50, 50)):
        gap = " " if k % 2 else "\n"  # words count, not what lies between them
        texts.append(" ".join(own[k][:40]) + " " + gap.join(passages[n]) + " " + " ".join(own[k][40:]))
        want.append(own[k] if n > 50 else texts[-1].split())
    got = staged(spark, texts, sf)
    assert [got[k].split() for k in range(6)] == want


def test_words_kept_are_those_in_no_repeated_run(spark):
    rng = random.Random(2)
    bits = [[rng.choice("aé中bc") * rng.randrange(1, 3) for _ in range(rng.randrange(20, 70))] for _ in range(8)]
    lists = [[w for _ in range(rng.randrange(1, 6)) for w in (rng.choice(bits) if rng.random() < 0.6 else [f"{rng.random()}" for _ in range(9)])] for _ in range(40)]
    counts = Counter(tuple(t[p : p + 51]) for t in lists for p in range(len(t) - 50))
    rows = spark.createDataFrame(list(enumerate(" ".join(t) for t in lists)), "doc_id long, text string")
    got = {r.id: bytes(r.kept).decode().split() for r in remove_repeats(rows, length=1 << 20, words=51).collect()}
    changed = 0
    for i, t in enumerate(lists):
        gone = {q for p in range(len(t) - 50) if counts[tuple(t[p : p + 51])] > 1 for q in range(p, p + 51)}
        changed += bool(gone)
        assert got[i] == [w for q, w in enumerate(t) if q not in gone]
    assert changed > 5


def test_characters_of_the_input_stay(spark, sf):
    shared = "".join(f"{i:03d}-" for i in range(110))
    texts = ["own \ufffd one é" + shared + "é\ufffd end", "other \ufffd two ĩ" + shared + "ê rest", "\ufffd"]
    got = staged(spark, texts, sf)
    assert got == {0: "own \ufffd one \ufffd end", 1: "other \ufffd two  rest", 2: "\ufffd"}


def test_runs_are_counted_without_being_cut(spark):
    rng = random.Random(3)
    shared = [rng.choice("abcdefgh") + rng.choice("ijklm") for _ in range(51)]
    lists = [[f"x{k}y{i}" for i in range(30)] + shared[: 51 - (k == 2)] + [f"z{k}"] for k in range(3)]
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(lists)] + [(9, None)], "doc_id long, text string")
    got = {r.id: r for r in remove_repeats(rows, words=51, cut_words=False).collect()}
    assert [got[k].n_passages for k in (0, 1, 2, 9)] == [1, 1, 0, 0]
    assert all(r.n_removed == 0 and bytes(r.kept).decode() == (" ".join(lists[k]) if k < 9 else "") for k, r in got.items())
