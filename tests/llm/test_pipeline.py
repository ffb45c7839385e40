import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataloom.llm.pii import redacted, spans
from strataloom.llm.simhash import simhash_groups
from tests.llm.test_nearcopies import components
from tests.llm.test_packing import check_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What each stage got and gave, as lists of rows."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_stages_return_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    for before, after in stages[:-1]:
        assert after.columns == COLUMNS and after.dtypes == before.dtypes
        assert after.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_few_clean_documents_go(spark):
    sf = "/root/testdata/sf0.01"
    toxic = dict(zip(*pq.read_table(f"{sf}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict().values(), strict=True))
    after = corpus_pipeline.toxicity(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    kept = {r.doc_id for r in after.collect()}
    clean = [d for d, t in toxic.items() if not t]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    firsts = {rows[k][0] for k in components([t for _, t in rows])}
    assert {r.doc_id for r in after.collect()} == firsts
    assert len(firsts) < len({r.component_id for r in simhash_groups(before).collect()})


def slow_cut(texts, length=400, words=51):
    """What is left of each text, as bytes, by counting every window of bytes and of words; and the whole characters cut."""
    data = [(t or "").encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"[^ \t\n\r\f\v]+", d)] for d in data]
    runs = [[d[a:b] for a, b in at] for d, at in zip(data, places, strict=True)]
    windows = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    passages = Counter(tuple(r[p : p + words]) for r in runs for p in range(len(r) - words + 1))
    out = []
    for d, at, r in zip(data, places, runs, strict=True):
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if windows[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        for p in range(len(r) - words + 1):
            if passages[tuple(r[p : p + words])] > 1:
                low, high = at[p][0], at[p + words - 1][1]
                gone[low:high] = b"\1" * (high - low)
        heads = [p for p in range(len(d)) if d[p] & 0xC0 != 0x80] + [len(d)]
        out.append(b"".join(d[p:q] for p, q in zip(heads, heads[1:], strict=False) if not any(gone[p:q])).decode())
    return out


def test_passages_and_personal_data_go(stages):
    (before, after), (_, masked) = stages[2], stages[3]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    got = {r.doc_id: r.text for r in after.collect()}
    want = slow_cut([t for _, t in rows])
    assert [got[i] for i, _ in rows] == want
    assert sum(t != w for (_, t), w in zip(rows, want, strict=True)) > 5
    for r in masked.collect():
        assert r.text == redacted(got[r.doc_id], spans(got[r.doc_id]))


def test_extra_columns_pass_whatever_their_names(stages, spark, sf, tmp_path):
    docs = stages[0][0]
    extra = ["row", "row_hash", "kept", "toxicity", "score", "spans", "id", "c0", "component_id", "n_removed", "words"]
    now = docs.select("*", *(F.concat(F.lit(name), F.col("doc_id")).alias(name) for name in extra))
    columns = now.columns
    for (name, stage), (_, plain) in zip(corpus_pipeline.STAGES[:-1], stages, strict=False):
        stage(spark, now, sf).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == columns
        assert sorted(tuple(r) for r in now.select(*COLUMNS).collect()) == sorted(tuple(r) for r in plain.collect())
        assert now.filter(" or ".join(f"`{c}` <> concat('{c}', doc_id)" for c in extra)).count() == 0


def test_packing_and_run(stages, spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = stages[4]
    tokens = {r.doc_id: np.array([*library.encode(r.text, add_special_tokens=False).ids, 1]) for r in before.collect()}
    rows = [tuple(r) for r in after.collect()]
    assert check_pieces(rows, tokens) == 0
    whole = lambda rows: sorted((r[0], r[1], r[2], r[3]) for r in rows if r[2] == 2048)
    assert whole(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == whole(rows)
    assert zlib.crc32(b"") == 0


def test_odd_rows(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d " * 300, "en", "s", 2400), (3, "a b c d " * 300, "en", "s", 2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            now = spark.createDataFrame(stage(spark, now, sf).collect(), stage(spark, now, sf).schema)
        assert (now.count() == 0) == empty
