import numpy as np
import public_tokenizers

from strataloom.llm import mergedropout
from strataloom.llm.mergedropout import MergeDropout, encode, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_a_frequent_word_has_many_segmentations():
    coder = MergeDropout(vocabulary(PATH), 1, 0.1)
    pieces = vocabulary(PATH).bytes
    words, now = [], []
    for i in coder.encode(" internationalization" * 3000).tolist():
        if pieces[i].startswith(b" ") and now:
            words.append(tuple(now))
            now = []
        now.append(i)
    assert len(set(words)) > 20


def test_agendas_side_by_side_are_those_of_the_heap(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40).collect()]
    for dropout in (0.1, 0.6):
        a = [MergeDropout(vocabulary(PATH), 7, dropout).encode(t) for t in texts]
        coder = MergeDropout(vocabulary(PATH), 7, dropout)
        ids = coder._ids
        for t, want in zip(texts, a, strict=True):
            words = coder.vocab.words.findall((mergedropout.SPACE if coder.vocab.dummy else "") + t.replace(mergedropout.SPACE, mergedropout._MARK).replace(" ", mergedropout.SPACE))
            parts = [p for w in words for p in coder.vocab.parts(w)]
            whole = [7, *(mergedropout.xxhash.xxh3_64_intdigest(x.encode()) for x in (t, ""))]
            keys = np.random.Generator(np.random.PCG64(whole)).integers(0, 1 << 64, len(parts), np.uint64).tolist()
            assert b"".join(ids(p, k, coder.limit) for p, k in zip(parts, keys, strict=True)) == want.tobytes()


def test_long_texts_and_parts():
    v = vocabulary(PATH)
    text = " leading  and long " * 70_000 + " " * 300 + "a" * 5000 + "é中🙂" + mergedropout.SPACE + "\n" * 100
    whole = MergeDropout(v, 3, 0.1).encode(text, "1")
    assert MergeDropout(v, 3, 0.1).decode(whole) == text and len(text) > mergedropout.WINDOW
    parts = [p for w in v.words.findall(mergedropout.SPACE + text.replace(mergedropout.SPACE, mergedropout._MARK).replace(" ", mergedropout.SPACE)) for p in v.parts(w)]
    coder = MergeDropout(v, 3, 0.1)
    keys = coder._keys(text, "1").integers(0, 1 << 64, len(parts), np.uint64).tolist()
    assert b"".join(coder._ids(p, k, coder.limit) for p, k in zip(parts, keys, strict=True)) == whole.tobytes()


def test_copies_in_other_documents_vary(spark):
    text = " internationalization of segmentations" * 20
    df = spark.createDataFrame([(1, text), (2, text), (2, text)], "doc_id long, text string")
    got = [r.ids_crc32 for r in encode(df, PATH).orderBy("id").collect()]
    assert got[0] != got[1] == got[2]
