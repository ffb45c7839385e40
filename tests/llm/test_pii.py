import hashlib
import random
import re

from strataloom.llm.pii import find_personal_data, joined, luhn, redact, redacted, spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_base(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {
                "email": lambda m, d: True,
                "ip": lambda m, d: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda m, d: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda m, d: 10 <= len(d) <= 15,
            }[kind](m, digits)
            if ok:
                out.append((m.start(), order, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def base(text):
    return [s for s in spans(text) if s[0] in PATTERNS]


def test_base_spans_match_regexes():
    rng = random.Random(2)
    bits = ["a", "b@", "@", ".", "..", "c.d", "-", "+", "+1", "1", "23", "4.", "255", "256", " ", "4111 1111 1111 1111", "é", "(", "\n", "10.0.0.1", "x@y.z", "://", "0"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(24)))
        assert base(text) == slow_base(text), text
    digits = "0123456789 -.+@a"
    for _ in range(6000):
        text = "".join(rng.choice(digits) for _ in range(rng.randrange(60)))
        assert base(text) == slow_base(text), text


def test_real_texts_match_regexes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = 0
    for r in find_personal_data(docs).collect():
        want = slow_base(texts[r.id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in PATTERNS]
        found += len(want)
    assert found


def test_added_kinds():
    text = "IBAN: DE89 3704 0044 0532 0130 00, see ftp://me:pw12@host.example/x token = \"abcdef123456\" account no. 12-345678."
    got = {k: text[a:b] for k, a, b in spans(text)}
    assert got["account"] == "12-345678" and got["login"] == "ftp://me:pw12@host.example" and got["secret"] == "abcdef123456"
    assert ("account", 6, 33) in spans(text)
    assert redacted("mail a@b.co now", spans("mail a@b.co now")) == "mail <EMAIL> now"


def test_odd_rows(spark):
    rows = [(1, None, 5), (None, "a@b.cd", 6), (2, "", 7), (2, "", 7), (3, "x " * 200000 + "1.2.3.4", 8)]
    df = spark.createDataFrame([(i, t, n, "s") for i, t, n in rows], "doc_id long, text string, n_email long, spans string")
    got = find_personal_data(df).collect()
    assert len(got) == 5 and sum(r.n_email for r in got) == 1 and sum(r.n_ip for r in got) == 1
    assert [r.text for r in redact(df).collect() if r.doc_id is None] == ["<EMAIL>"]
    assert find_personal_data(df.limit(0)).count() == 0
