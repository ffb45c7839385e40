"""Packing of token sequences by minimum bin slack.

Each document is tokenised whole and ended with an end id. Blocks of a full window become sequences at once; the rest
of each document waits in a pool. A window takes the longest rest in the pool and, from a bitset of the sums that the
remaining lengths can make (each length as often as it is left), the multiset that fills it closest to capacity; the
counts come from backtracking through the bitsets. A filling that fits exactly is used as often as its lengths last.
Where nothing fills a window and too much waits to put it off, a rest is cut to close the gap, so no window is padded.
What is left at the end of a partition, under one window, is cut into sequences whose lengths are powers of two, which
need no padding either.

Packing works on each input partition alone: no shuffle, memory bounded by the pool, and a lost task is run again with
the same result.

Rows: a null or empty text is the end id alone. A null id is kept. Repeated rows are packed once each. Texts of any
length are packed whole. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Texts with so many white-space characters in a row go to the vocabulary file's own library.
BLANKS = 20_000
LONG_BLANKS = re.compile(r"\s{%d}" % BLANKS)
SCHEMA = "id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteBpe:
    """Token ids of a byte-level BPE vocabulary file, as little-endian 16-bit bytes.

    The file's vocabulary is run by the faster of two libraries; the ids equal those of the file's own one
    (tests/llm/test_packing.py holds them against it).
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {
            bytes(byte_of[c] for c in piece): i
            for piece, i in spec["model"]["vocab"].items()
            if piece not in self.special
        }
        if len(ranks) + len(self.special) > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self._encode = tiktoken.Encoding(
            "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self._path = path
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _segment(self, text: str) -> bytes:
        return array("H", self._encode(text)).tobytes()

    @cached_property
    def _own(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def ids(self, text: str) -> bytes:
        if len(text) > BLANKS and LONG_BLANKS.search(text):  # which the faster library does not survive
            return array("H", self._own.encode(text, add_special_tokens=False).ids).tobytes()
        if self._cut and "<|" in text:
            return b"".join(
                self.special[p].to_bytes(2, "little") if p in self.special else self._segment(p)
                for p in self._cut.split(text)
                if p
            )
        return self._segment(text)


@cache
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def best_filling(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, each at most ``counts`` times, with the largest sum within ``capacity``.

    Holds the longest length that fits. Among equal sums, one made of longer lengths.
    """
    lengths = sorted((n for n, c in counts.items() if c and n <= capacity), reverse=True)
    if not lengths:
        return {}
    seed = lengths[0]
    room = capacity - seed
    mask = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for n in lengths:
        left = counts[n] - (n == seed)
        if n > room or not left:
            continue
        times, chunk = min(left, room // n), 1
        while times:
            take = min(chunk, times)
            grown = (sums | sums << (take * n)) & mask
            if grown != sums:
                steps.append((n, take, sums))
                sums = grown
            times -= take
            chunk *= 2
        if sums >> room & 1:
            break
    rest = sums.bit_length() - 1
    out: dict[int, int] = defaultdict(int)
    out[seed] = 1
    for n, take, before in reversed(steps):
        if not before >> rest & 1:
            out[n] += take
            rest -= take * n
    return dict(out)


class Packer:
    """Packs what it is given; rows are lists of (id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int, pool: int = 4096):
        self.window, self.next, self.pool = window, first_sequence, pool
        self.waiting: dict[int, list[tuple]] = defaultdict(list)
        self.n = 0
        self.rows: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        n, window = len(ids), self.window
        whole = n - n % window
        for start in range(0, whole, window):
            self._place([(key, start, ids[start : start + window], n)])
        if n > whole:
            self.waiting[n - whole].append((key, whole, ids[whole:].copy(), n))
            self.n += 1
        if self.n >= self.pool:
            self._pack(self.pool // 4)

    def _place(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, n in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((key, start, len(ids), crc, n, self.next, offset))
            offset += len(ids)
        self.next += 1

    def _take(self, length: int) -> tuple:
        at = self.waiting[length]
        piece = at.pop()
        if not at:
            del self.waiting[length]
        self.n -= 1
        return piece

    def _cut(self, length: int, at: int) -> tuple:
        """The first ``at`` ids of a waiting piece; the rest goes on waiting."""
        key, start, ids, n = self._take(length)
        self.waiting[length - at].append((key, start + at, ids[at:], n))
        self.n += 1
        return key, start, ids[:at], n

    def _pack(self, put_off: int) -> None:
        """Fill windows; stop where one can't be filled exactly and at most ``put_off`` pieces wait."""
        while self.n:
            counts = {n: len(x) for n, x in self.waiting.items()}
            chosen = best_filling(counts, self.window)
            slack = self.window - sum(n * c for n, c in chosen.items())
            if slack and (self.n <= put_off or sum(n * c for n, c in counts.items()) < self.window):
                return
            for _ in range(1 if slack else min(counts[n] // c for n, c in chosen.items())):
                pieces = [self._take(n) for n in sorted(chosen, reverse=True) for _ in range(chosen[n])]
                if slack:
                    pieces.append(self._cut(max(self.waiting), slack))
                self._place(pieces)

    def finish(self) -> None:
        self._pack(0)
        left = sum(n * len(x) for n, x in self.waiting.items())
        while left:
            size = 1 << (left.bit_length() - 1)
            pieces, room = [], size
            while room:
                n = max(self.waiting)
                pieces.append(self._take(n) if n <= room else self._cut(n, room))
                room -= len(pieces[-1][2])
            self._place(pieces)
            left -= size


def _pack(path: str, window: int, end_id: int, kind: pa.DataType):
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokenizer(path).ids, Packer(window, TaskContext.get().partitionId() << 40)
        end = end_id.to_bytes(2, "little")

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[]] * len(names)
            packer.rows = []
            types = [kind, *[pa.int64()] * (len(names) - 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text"), strict=True):
                packer.add(key.as_py(), np.frombuffer(encode(text.as_py() or "") + end, "<u2"))
                if len(packer.rows) >= 8192:
                    yield out()
        packer.finish()
        yield out()

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``window`` is a power of two."""
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    return rows.mapInArrow(_pack(tokenizer_path, window, end_id, to_arrow_type(kind)), SCHEMA.format(kind.simpleString()))
