"""Personal data by anchor expansion.

An Aho-Corasick pass over the whole text finds anchors: at-signs, plus-and-digit, digits, URL schemes, and cue words.
At each anchor a small deterministic parser expands to the left and right, fixes the boundaries and validates the
value. The base kinds give exactly the leftmost non-overlapping matches of these patterns, with failing ones dropped:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, each part at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 14 to 19 digits that pass the Luhn check
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 10 to 15 digits

Added kinds: login (``scheme://user:password@host``), account (IBAN with a correct checksum, or a number after an
account cue), secret (a quoted or long value after a token, key or password cue). Added spans never change base ones.

Rows: a null text is an empty one and gives no spans. A null id is kept. Repeated rows each give a row. Texts of any
length are read whole. Other columns are ignored by ``find_personal_data`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "login", "secret")
KINDS = BASE + ADDED

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
_LOGIN = re.compile(r"[^\s/?#:@]+:[^\s/?#@]+@[^\s/?#@]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?:\s*(?:number|no\.?|nr\.?))?\s*[:#=]?\s*([A-Z0-9][A-Z0-9-]{5,33})(?![A-Za-z0-9])")
_VALUE = re.compile(r"\s*[:=]\s*(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([A-Za-z0-9+/_=-]{16,}))")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")

# Cue words.
ACCOUNT_CUES = ("account", "acct", "customer id", "passport", "ssn")
SECRET_CUES = ("api_key", "apikey", "passwd", "password", "secret", "token")


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
        found.add_word("+" + d, ("plus", 2))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    for form in ("IBAN", "iban", "Iban"):
        found.add_word(form, ("iban", 4))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k & 1:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _iban(value: str) -> bool:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind in the order of KINDS."""
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    run_end = 0

    def take(kind: str, start: int, end: int) -> None:
        out.append((kind, start, end))
        done[kind] = end

    for last, (anchor, size) in _automaton().iter(text):
        at = last + 1 - size
        if anchor == "digit":
            if at >= run_end:
                run_end = _RUN.match(text, at).end()
                if at >= done["ip"] and (m := _IP.match(text, at)):
                    done["ip"] = m.end()
                    if all(map(_small, m[0].split("."))):
                        out.append(("ip", at, m.end()))
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, m.end()))
        elif anchor == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append(("phone", at, m.end()))
        elif anchor == "at":
            start, least = at, done["email"]
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, last + 1)):
                take("email", start, m.end())
        elif anchor == "scheme":
            start = at
            while start > done["login"] and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and (m := _LOGIN.match(text, last + 1)):
                take("login", start, m.end())
        elif anchor == "iban":
            if (m := _IBAN.match(text, last + 1 + len(text[last + 1 : last + 4]) - len(text[last + 1 : last + 4].lstrip(" :")))) and m.start() >= done["account"] and _iban(m[0]):
                take("account", m.start(), m.end())
        elif anchor == "account":
            if (m := _NUMBER.match(text, last + 1)) and m.start(1) >= done["account"] and sum(c in _DIGITS for c in m[1]) >= 6:
                take("account", m.start(1), m.end(1))
        elif (m := _VALUE.match(text, last + 1)) and m.start(m.lastindex) >= done["secret"]:
            take("secret", m.start(m.lastindex), m.end(m.lastindex))
    order = {k: i for i, k in enumerate(KINDS)}
    out.sort(key=lambda s: (s[1], order[s[0]]))
    return out


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, end = [], 0
    for kind, a, b in found:
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[] for _ in BASE]
        digests, texts = [], []
        for text in batch.column("text"):
            found = spans(text.as_py() or "")
            base = [s for s in found if s[0] in BASE]
            for k, column in zip(BASE, counts, strict=True):
                column.append(sum(s[0] == k for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            texts.append(joined(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
            names=["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
        )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return rows.mapInArrow(_find, schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with the personal data in ``text_col`` replaced; null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, spans(t)) for t in (x.as_py() for x in batch.column(at))]
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
