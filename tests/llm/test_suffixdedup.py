import hashlib
import random
from collections import Counter

import numpy as np

from strataloom.llm import suffixdedup
from strataloom.llm.deepshallow import blind_trie_order, common_prefix, deep_shallow_order, neighbour_prefixes
from strataloom.llm.suffixdedup import anchors_of, remove_repeats, repeated_windows


def slow(texts, length):
    """(n_bytes, n_removed, n_spans, sha256) of each text, by counting every window."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - length + 1):
            if counts[d[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(d), len(d) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def made_texts(rng, n=60):
    passages = ["".join(rng.choice("ab c") for _ in range(rng.randrange(5, 90))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdé\0") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6))]
        texts.append("".join(parts))
    return texts + texts[:5] + ["a" * 100, "a" * 41, "", None]


def test_order_is_byte_order():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.randrange(90))) for _ in range(700)]
    strings += [s + b"x" for s in strings[:99]] + strings[:50] + [b"q" * 70 + bytes([k % 7]) for k in range(3000)]
    want = sorted(strings)
    assert [strings[i] for i in blind_trie_order(strings, list(range(len(strings))))] == want
    order = deep_shallow_order(strings)
    assert sorted(order.tolist()) == list(range(len(strings)))
    assert [strings[i] for i in order] == want
    lcp = neighbour_prefixes(strings, order)
    assert all(common_prefix(want[k - 1], want[k]) == lcp[k] for k in range(1, len(want)))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(6)
    data = b"".join(rng.choice([b"abcabc", b"xyzzy", b"q"]) for _ in range(3000))
    cuts = np.array([0, 100, 4000, len(data)])
    piece, key, digest, at, low, high = anchors_of(data, cuts[:-1], cuts[1:], 40, 8)
    seen, windows = {}, 0
    for k, a, lo, hi in zip(key.tolist(), at.tolist(), low.tolist(), high.tolist(), strict=True):
        for p in range(lo, hi + 1):
            assert seen.setdefault(data[p : p + 40], (k, a - p)) == (k, a - p)
            windows += 1
    assert windows == sum(b - a - 39 for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def test_repeated_windows_of_one_group():
    rng = random.Random(7)
    contexts, left, more = [], [], []
    for _ in range(150):
        k, m = rng.randrange(0, 9), rng.randrange(0, 9)
        k = max(k, m)
        body = bytes(rng.choice(b"ab") for _ in range(k)) + b"GRAM" + bytes(rng.choice(b"ab") for _ in range(40))
        contexts.append(body[: m + 12])
        left.append(k)
        more.append(m)
    got = repeated_windows(np.array(left), np.array(more), contexts, 12)
    seen = Counter((left[i] - p, contexts[i][p : p + 12]) for i in range(150) for p in range(more[i] + 1))
    for i in range(150):
        for p in range(more[i] + 1):
            assert got[i, p] == (seen[left[i] - p, contexts[i][p : p + 12]] > 1)


def run(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: tuple(r)[2:6] for r in remove_repeats(df, **how).collect()}
    return [got[i] for i in range(len(texts))]


def test_matches_brute_force(spark, monkeypatch):
    texts = made_texts(random.Random(8))
    assert run(spark, texts, length=40, gram=6) == slow(texts, 40)
    texts = made_texts(random.Random(10))
    assert run(spark, texts, length=40, gram=6, at_once=7) == slow(texts, 40)


def test_shared_passages_are_split_over_tasks(spark):
    texts = made_texts(random.Random(9), 40)
    assert run(spark, texts, length=40, gram=6, most_contexts=1) == slow(texts, 40)


def test_long_texts_are_cut_in_pieces():
    assert suffixdedup.LONGEST_PIECE > suffixdedup.BUFFER
    rng = random.Random(3)
    text = bytes(rng.choice(b"ab") for _ in range(suffixdedup.LONGEST_PIECE + 900))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["row_hash", "text"])
    windows = []
    for b in suffixdedup._anchors(400, 32)(iter([batch])):
        for lo, more in zip(b.column("low").to_pylist(), b.column("more").to_pylist(), strict=True):
            windows += range(lo, lo + more + 1)
    assert windows == list(range(len(text) - 399))


def test_real_documents_match_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in rows]
    got = run(spark, texts)
    assert got == slow(texts, 400)
    assert sum(g[1] for g in got) > 0


def test_odd_rows(spark):
    t = "x" * 30 + "".join(map(str, range(200)))
    rows = [(None, t, 1, "k"), (4, t, 2, "k"), (5, None, 3, "k"), (6, "", 4, "k"), (7, t[5:] + "y", 5, "k"), (7, t[5:] + "y", 5, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long, key string")
    got = remove_repeats(df, length=40, gram=6).collect()
    assert sorted(tuple(r)[2:6] for r in got) == sorted(slow([r[1] for r in rows], 40))
    assert remove_repeats(df.limit(0)).count() == 0
