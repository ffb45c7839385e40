"""Encoding with a SentencePiece vocabulary of merges under seeded merge-dropout, and decoding.

Characters join by an agenda: candidate pairs come off a heap, best score first, then leftmost. Each candidate is decided
by a keyed hash of the seed, the document, the text, the word's number in it and the pair's place: with the given
probability it is skipped and does not come back. The same seed gives the same ids again; other seeds, documents and places
give other segmentations, and all of them decode to the same text. With probability 0 the ids are those of the vocabulary's own library.

Pieces never run over a space into the word before it, nor over two characters that are neighbours in no piece; texts
are cut there. The parts of a batch of texts run their agendas side by side, in arrays: each step takes the best candidate
of every part, decides it, and joins or skips. Nothing is remembered from one occurrence to the next. Parts of over LONG
characters run a heap of their own.

Rows: a null text is an empty one and has no ids. A null id is kept. Rows that repeat give equal rows. Texts of any length
are encoded whole. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_MARK = "\ud800"  # stands for a SPACE character of the text itself, which byte pieces then spell; in no valid text
_A, _B, _C, _M = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93
_ALL = (1 << 64) - 1
EACH, LONG = 8, 64  # parts up to EACH long run with those of equal length
BATCH, WINDOW = 1 << 18, 1 << 20  # characters encoded together, and of one text at once
_PAD, _GONE, _NONE = 0xFFFF, -1, 1 << 30


class PairTable:
    """Values of pairs of 16-bit numbers, by open addressing; _NONE for others."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: np.ndarray):
        bits = max(4, int(3 * len(a)).bit_length())
        self.shift = np.uint32(32 - bits)
        self.last = (1 << bits) - 1
        self.entries = np.full(1 << bits, _NONE, np.uint64)  # pair, then value; no pair is all zeros
        key = (a << 16 | b).astype(np.uint32)
        at = self._slot(key)
        while len(key):
            slot, first = np.unique(at, return_index=True)
            first = first[self.entries[slot] == _NONE]
            self.entries[at[first]] = key[first].astype(np.uint64) << np.uint64(32) | value[first].astype(np.uint64)
            key, at, value = np.delete(key, first), np.delete(at, first), np.delete(value, first)
            at = at + 1 & self.last

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(0x9E3779B1) >> self.shift).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of numbers from 1 on."""
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at = self._slot(key)
        got = self.entries.take(at)
        pair, out = (got >> np.uint64(32)).astype(np.uint32), got.astype(np.uint32).astype(np.int32)
        other = np.flatnonzero((pair != key) & (pair != 0))
        out[pair != key] = _NONE
        at = at[other]
        while len(other):
            at = at + 1 & self.last
            got = self.entries[at]
            pair = (got >> np.uint64(32)).astype(np.uint32)
            hit = pair == key[other]
            out[other[hit]] = got[hit].astype(np.uint32).astype(np.int32)
            on = ~hit & (pair != 0)
            other, at = other[on], at[on]
        return out


class MergeVocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("a merge vocabulary with byte fallback is needed")
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a vocabulary that changes texts before encoding can't decode them")
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type in (1, 4)]
        if any(SPACE in p.piece.lstrip(SPACE) for _, p in normal):
            raise ValueError("a piece runs over a space")
        self.dummy = model.normalizer_spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in normal}
        self.scores = {p.piece: p.score for _, p in normal if len(p.piece) > 1}
        self.byte_ids = [0] * 256
        self.bytes = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.bytes[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type in (1, 4):
                self.bytes[i] = p.piece.replace(SPACE, " ").encode()
        joined = {c for p in self.scores for c in p}
        #: Words with the spaces before them; characters of no longer piece stand alone.
        inside = "".join(sorted(map(re.escape, joined - {SPACE})))
        self.words = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{SPACE}{inside}]")
        #: Neighbours that some piece holds; between any other two characters no pieces ever join.
        self.pairs = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self._arrays(joined)

    def _arrays(self, joined: set[str]) -> None:
        """The same as numbers. Symbols are pieces and the characters in them; those that can be made come first, best first."""
        made = sorted(self.scores, key=lambda p: -self.scores[p])
        names = ["", *made, *sorted(joined), *(p for p in self.ids if p not in self.scores and p not in joined)]
        if len(names) >= _PAD:
            raise ValueError("symbols are kept in 16 bits")
        number = {name: i for i, name in enumerate(names)}
        spelled = [self.spell(name) for name in names]
        self.spelled = np.array([i for ids in spelled for i in ids], np.uint16)
        self.spelled_at = np.concatenate(([0], np.cumsum([len(ids) for ids in spelled])))
        self.symbol = np.full(0x110000, _GONE, np.int32)
        for name in names:
            if len(name) == 1:
                self.symbol[ord(name)] = number[name]
        self.symbol[ord(" ")], self.symbol[ord(SPACE)] = number[SPACE], _GONE
        order = {p: i for i, p in enumerate(made, 1)}
        for p, q in zip(made, made[1:], strict=False):  # of equal scores, the leftmost goes first
            order[q] = order[p] if self.scores[p] == self.scores[q] else order[q]
        self.tied = np.zeros(len(names), bool)
        self.tied[[order[p] for p in made if order[p] != number[p]]] = True
        splits = np.array([(number[p[:i]], number[p[i:]], order[p], number[p]) for p in made for i in range(1, len(p)) if p[:i] in number and p[i:] in number])
        self.merges = PairTable(splits[:, 0], splits[:, 1], splits[:, 2])
        alike = splits[self.tied[splits[:, 2]]]
        self.exact = PairTable(alike[:, 0], alike[:, 1], alike[:, 3])
        # pairs of characters: _NONE if they are neighbours in no piece, else what they make
        self.base, chars = len(made) + 1, len(joined)
        beside = np.full((chars + 1, chars + 1), -1, np.int32)
        for p in self.pairs:
            beside[number[p[0]] - self.base, number[p[1]] - self.base] = _NONE
        short = np.array([(number[p[0]], number[p[1]], order[p]) for p in made if len(p) == 2])
        beside[short[:, 0] - self.base, short[:, 1] - self.base] = short[:, 2]
        self._beside = beside

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of symbols of characters: -1 if nothing joins them ever, _NONE if nothing at first, else what does."""
        last = len(self._beside) - 1
        near = lambda x: np.minimum((x - self.base).astype(np.uint32), last)
        return self._beside.ravel().take(near(a).astype(np.int64) * (last + 1) + near(b))

    def spell(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.replace(SPACE, " ").encode()]

    def parts(self, word: str) -> list[str]:
        """The word cut where nothing can join."""
        pairs = self.pairs
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]


@cache
def vocabulary(path: str) -> MergeVocabulary:
    return MergeVocabulary(path)


def skipped(key: int, left: int, right: int, stop: int, limit: int) -> bool:
    """Whether the keyed hash skips the candidate that joins word[left:right] and word[right:stop]."""
    x = (key + left * _A + right * _B + stop * _C) * _M & _ALL
    return ((x ^ x >> 29) * _M & _ALL) < limit


def segment(word: str, scores: dict[str, float], key: int = 0, limit: int = 0) -> list[str]:
    """Pieces of a word by the agenda; of the candidates it takes off, the hash of ``key`` skips ``limit`` in 2**64."""
    n = len(word)
    if n < 2:
        return [word]
    before = list(range(-1, n - 1))  # of each piece's start, the start of the piece before it
    end = list(range(1, n + 1))  # of the piece that starts here; 0 once it has joined the one before
    agenda = [(-scores[word[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if word[i : i + 2] in scores]
    heapq.heapify(agenda)
    while agenda:
        _, left, right, stop = heapq.heappop(agenda)
        if end[left] != right or end[right] != stop or limit and skipped(key, left, right, stop, limit):
            continue
        end[left], end[right] = stop, 0
        if stop < n:
            before[stop] = left
            last = end[stop]
            score = scores.get(word[left:last])
            if score is not None:
                heapq.heappush(agenda, (-score, left, stop, last))
        first = before[left]
        if first >= 0:
            score = scores.get(word[first:stop])
            if score is not None:
                heapq.heappush(agenda, (-score, first, left, stop))
    out, at = [], 0
    while at < n:
        out.append(word[at : end[at]])
        at = end[at]
    return out


def spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``low`` on, ``n`` of each, one after the other."""
    return np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(n) else np.empty(0, np.int64)


class MergeDropout:
    """Encodes and decodes with one vocabulary, seed and probability."""

    def __init__(self, vocab: MergeVocabulary, seed: int, dropout: float):
        self.vocab, self.seed = vocab, seed
        self.limit = int(dropout * (1 << 64))

    def _ids(self, part: str, key: int = 0, limit: int = 0) -> bytes:
        """Ids of a part by a heap of its own."""
        v = self.vocab
        if part == _MARK:
            return array("H", [v.byte_ids[b] for b in SPACE.encode()]).tobytes()
        return array("H", [i for piece in segment(part, v.scores, key, limit) for i in v.spell(piece)]).tobytes()

    def _keys(self, text: str, document: str) -> np.random.Generator:
        seeds = [self.seed & (1 << 63) - 1, xxhash.xxh3_64_intdigest(text.encode(errors="surrogatepass")), xxhash.xxh3_64_intdigest(document.encode())]
        return np.random.Generator(np.random.PCG64(seeds))

    def _agendas(self, symbols: np.ndarray, cand: np.ndarray, keys: np.ndarray) -> None:
        """Joins symbols (place in the part, part) in place: a joined symbol stands in its first place, _GONE in the others.

        The last row is of _PAD, and so are the places after a part's end. A candidate is its order and its place in one
        number; ``cand`` has them for each symbol with the next.
        """
        v = self.vocab
        get, tied = v.merges.get, v.tied
        size, n = symbols.shape
        end = np.repeat(np.arange(1, size + 1), n)
        before = np.repeat(np.arange(-1, size - 1), n)
        cand, all_symbols, rows, width = cand.ravel(), symbols.ravel(), np.arange(n), n
        while True:
            best = cand.reshape(size, n).min(axis=0)
            live = np.flatnonzero(best < _NONE)
            if not len(live):
                return
            best = best.take(live)
            if 2 * len(live) < n:
                cand, end, before = (x.reshape(size, n)[:, live].ravel() for x in (cand, end, before))
                rows, n = rows[live], len(live)
                live = np.arange(n)
            left, made = (best & 0xFF).astype(np.int64), best >> 8
            at = left * n + live
            right = end.take(at)
            stop = end.take(right * n + live)
            if self.limit:
                place = left.astype(np.uint64) * np.uint64(_A) + right.astype(np.uint64) * np.uint64(_B) + stop.astype(np.uint64) * np.uint64(_C)
                x = (keys.take(rows.take(live)) + place) * np.uint64(_M)
                x = (x ^ x >> np.uint64(29)) * np.uint64(_M)
                skips = x <= np.uint64(self.limit - 1)
                if skips.any():
                    cand[at[skips]] = _NONE
                    on = np.flatnonzero(~skips)
                    live, left, right, stop, made, at = (c.take(on) for c in (live, left, right, stop, made, at))
            of = rows.take(live)
            here, there = left * width + of, right * width + of
            many = np.flatnonzero(tied.take(made))
            if len(many):
                made[many] = v.exact.get(all_symbols[here[many]], all_symbols[there[many]])
            all_symbols[here], all_symbols[there] = made, _GONE
            end[at] = stop
            before[stop * n + live] = left
            cand[right * n + live] = _NONE
            got = get(made, all_symbols.take(stop * width + of))
            cand[at] = np.where(got < _NONE, got << 8 | left, _NONE)
            inner = np.flatnonzero(left)
            if len(inner):
                live, of = live.take(inner), of.take(inner)
                first = before.take(at.take(inner))
                got = get(all_symbols.take(first * width + of), made.take(inner))
                cand[first * n + live] = np.where(got < _NONE, got << 8 | first, _NONE)

    def _some(self, texts: list[str], streams: list[np.random.Generator]) -> list[np.ndarray]:
        """Ids of texts, none of which starts or ends within a part."""
        v = self.vocab
        ends = np.cumsum([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = v.symbol.take(points)
        unknown = np.flatnonzero(symbols < 0)
        symbols[unknown] = 0
        pairs = np.append(v.beside(symbols[:-1], symbols[1:]), -1)
        pairs[ends - 1] = -1
        cut = np.concatenate(([True], pairs < 0))
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts)
        starts = starts[:-1]
        parts = np.diff(np.searchsorted(starts, np.concatenate(([0], ends))))
        keys = np.concatenate([g.integers(0, 1 << 64, n, np.uint64) for g, n in zip(streams, parts.tolist(), strict=True)]) if self.limit else np.zeros(len(starts), np.uint64)
        first = np.where(pairs < _NONE, pairs << 8, _NONE)
        width = 2
        while width <= LONG:
            least = width if width <= EACH else width // 2 + 1
            some = np.flatnonzero((sizes >= least) & (sizes <= width))
            if len(some):
                offset = np.arange(width)[:, None]
                place = np.append(starts[some] + offset, np.zeros((1, len(some)), np.int64), axis=0)
                block, cand = symbols.take(place, mode="clip"), first.take(place, mode="clip") | np.arange(width + 1)[:, None].astype(np.int32)
                if least < width:
                    block[:-1][offset >= sizes[some]] = _PAD
                    cand[:-1][offset >= sizes[some] - 1] = _NONE
                block[-1] = _PAD
                cand[-2:] = _NONE
                cand[cand > _NONE] = _NONE
                self._agendas(block, cand, keys[some])
                if least < width:
                    inside = offset < sizes[some]
                    symbols[place[:-1][inside]] = block[:-1][inside]
                else:
                    symbols[place[:-1].ravel()] = block[:-1].ravel()
            width = width + 1 if width < EACH else 2 * width
        ids_n = np.append(np.diff(v.spelled_at), 0).take(symbols, mode="wrap")  # none where gone
        ids_at = v.spelled_at.take(symbols, mode="wrap")
        more: list[int] = []
        known = len(v.spelled)

        def say(at: int, ids: list[int]) -> None:
            ids_at[at], ids_n[at] = known + len(more), len(ids)
            more.extend(ids)

        for at in unknown.tolist():
            say(at, [v.byte_ids[b] for b in chr(points[at]).encode(errors="surrogatepass")])
        for i in np.flatnonzero(sizes > LONG).tolist():
            a, n = int(starts[i]), int(sizes[i])
            part = points[a : a + n].tobytes().decode("utf-32-le").replace(" ", SPACE)
            ids_n[a : a + n] = 0
            say(a, array("H", self._ids(part, int(keys[i]), self.limit)).tolist())
        table = np.concatenate([v.spelled, np.array(more, np.uint16)]) if more else v.spelled
        some = np.flatnonzero(ids_n)
        flat = table.take(spread(ids_at.take(some), ids_n.take(some)))
        cuts = np.concatenate(([0], np.cumsum(ids_n)))[np.concatenate(([0], ends))]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _windows(self, text: str) -> Iterator[str]:
        """A text in windows that end between parts."""
        at, size = 0, WINDOW
        while len(text) - at > size:
            tail = text[at : at + size + 1]
            symbols = self.vocab.symbol[np.frombuffer(tail.encode("utf-32-le", "surrogatepass"), np.uint32)]
            ends = np.flatnonzero(self.vocab.beside(symbols[:-1], symbols[1:]) < 0)
            if not len(ends):
                size *= 2
                continue
            yield tail[: int(ends[-1]) + 1]
            at, size = at + int(ends[-1]) + 1, WINDOW
        yield text[at:]

    def encode_all(self, texts: list[str], documents: list[str]) -> list[np.ndarray]:
        """The little-endian 16-bit ids of each text."""
        out: list[np.ndarray] = [np.empty(0, np.uint16)] * len(texts)
        short = [i for i, t in enumerate(texts) if 0 < len(t) < WINDOW]
        dummy = " " if self.vocab.dummy else ""
        if short:
            got = self._some([dummy + texts[i] for i in short], [self._keys(texts[i], documents[i]) for i in short])
            for i, ids in zip(short, got, strict=True):
                out[i] = ids
        for i, text in enumerate(texts):
            if len(text) >= WINDOW:
                stream = self._keys(text, documents[i])
                out[i] = np.concatenate([self._some([w], [stream])[0] for w in self._windows(dummy + text)])
        return out

    def encode(self, text: str, document: str = "") -> np.ndarray:
        return self.encode_all([text], [document])[0]

    def decode(self, ids) -> str:
        pieces = self.vocab.bytes
        data = b"".join([pieces[i] for i in (ids.tolist() if hasattr(ids, "tolist") else ids)])
        return (data[1:] if self.vocab.dummy and data[:1] == b" " else data).decode()


def bounded(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[list[str], list[str]]]:
    """Ids as text and texts, some at a time: rows until their texts have BATCH characters."""
    names: list[str] = []
    held: list[str] = []
    size = 0
    for i, text in zip(ids, texts, strict=True):
        names.append(str(i.as_py()))
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= BATCH:
            yield names, held
            names, held, size = [], [], 0
    if held:
        yield names, held


def encode(
    docs: DataFrame, model_path: str, seed: int = 42, dropout: float = 0.1, id_col: str = "doc_id", text_col: str = "text", ids: bool = False
) -> DataFrame:
    """One row per input row: id, n_ids, ids_crc32 (unsigned, of little-endian unsigned 32-bit ids), lossless; with ``ids`` the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = MergeDropout(vocabulary(model_path), seed, dropout)
        for batch in batches:
            sizes, sums, same, all_ids = [], [], [], []
            for keyed, texts in bounded(batch.column("id"), batch.column("text")):
                for text, got in zip(texts, coder.encode_all(texts, keyed), strict=True):
                    sizes.append(len(got))
                    sums.append(zlib.crc32(got.astype("<u4").tobytes()))
                    same.append(coder.decode(got) == text)
                    if ids:
                        all_ids.append(got.astype(np.int32))
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())]
            names = ["id", "n_ids", "ids_crc32", "lossless"]
            if ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.dtypes[0][1]}, n_ids long, ids_crc32 long, lossless boolean" + (", ids array<int>" if ids else "")
    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``; null ids give a null."""
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = MergeDropout(vocabulary(model_path), 0, 0.0)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, decoded string")
