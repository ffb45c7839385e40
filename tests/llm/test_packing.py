import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strataloom.llm.packing import ByteBpe, Packer, best_filling, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def ids_of(bpe, text):
    return np.frombuffer(bpe.ids(text), "<u2").tolist()


def test_ids_equal_the_library(reference, spark, sf):
    bpe, rng = ByteBpe(PATH), random.Random(4)
    bits = ["the", "It's", " ", "  ", "\n", "\n\n", "&&&", "a.b", "12", "x1", "é", "中文", "…", "…&", "\t", "'s", "'", "<|endoftext|>", "<|", "ª", "²", "\u0301", ".", "\u00a0", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(8000)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t in texts:
        assert ids_of(bpe, t) == reference.encode(t, add_special_tokens=False).ids, repr(t)


def test_filling_matches_all_subsets():
    rng = random.Random(7)
    for _ in range(300):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 10))]
        cap = rng.randrange(1, 60)
        counts = defaultdict(int)
        for i in items:
            counts[i] += 1
        got = best_filling(counts, cap)
        assert all(c <= counts[n] for n, c in got.items())
        fits = [i for i in items if i <= cap]
        if not fits:
            assert not got
            continue
        seed = max(fits)
        rest = list(items)
        rest.remove(seed)
        sums = {0}
        for i in rest:
            sums |= {s + i for s in sums}
        assert sum(n * c for n, c in got.items()) == seed + max(s for s in sums if s <= cap - seed)


def check_pieces(pieces, tokens, window=2048):
    """pieces: rows; tokens: id -> array. Each id in one piece, sequences gapless, and none padded."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = tokens[p[0]][p[1] : p[1] + p[2]]
        assert zlib.crc32(np.asarray(ids, "<u4").tobytes()) == p[3] and p[4] == len(tokens[p[0]])
        by_doc[p[0]].append((p[1], p[2]))
        by_seq[p[5]].append((p[6], p[2]))
    for d, cuts in by_doc.items():
        at = 0
        for start, n in sorted(cuts):
            assert start == at and n > 0
            at += n
        assert at == len(tokens[d])
    assert set(by_doc) == set(tokens)
    padding = 0
    for cuts in by_seq.values():
        at = 0
        for offset, n in sorted(cuts):
            assert offset == at
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packer_wastes_nothing():
    rng = random.Random(9)
    for lengths in ([1500] * 500, [rng.randrange(1, 5000) for _ in range(900)], [3], [2047] * 3, [1024] * 7):
        packer = Packer(2048, 0, pool=64)
        tokens = {i: np.array([rng.randrange(50000) for _ in range(n)], "<u2") for i, n in enumerate(lengths)}
        for i, ids in tokens.items():
            packer.add(i, ids)
        packer.finish()
        assert check_pieces(packer.rows, tokens) == 0


def test_documents_are_packed_whole(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tokens = {r.doc_id: np.array([*reference.encode(r.text, add_special_tokens=False).ids, 1]) for r in docs.collect()}
    assert check_pieces([tuple(r) for r in pack(docs, PATH).collect()], tokens) == 0


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "word " * 60000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = pack(df, PATH).collect()
    assert sorted((r.id or 0, r.doc_tokens) for r in got if r.doc_tokens == 1) == [(0, 1), (1, 1), (1, 1)]
    assert sum(r.length for r in got if r.id == 2) == next(r.doc_tokens for r in got if r.id == 2)
    assert pack(df.limit(0), PATH).count() == 0


def test_long_runs_of_blanks_through_spark(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "x " * 5 + "\t \n" * 400_000 + " end", " " * 30_000]
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {}
    for r in pack(df, PATH).orderBy("id", "start").collect():
        got.setdefault(r.id, []).append((r.length, r.ids_crc32))
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for n, crc in got[f"d{i}"]:
            assert zlib.crc32(ids[at : at + n].tobytes()) == crc
            at += n
        assert at == len(ids)
