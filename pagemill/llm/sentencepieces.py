"""Operator 5: SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch are laid end to end and indexed by a suffix
array (as deep as the longest piece); every piece of the vocabulary is looked up
by binary search, which gives the range of its occurrences.  These are edges
(place, piece); sorted by place they are relaxed from left to right, and the path
to the end of a segment is its encoding.

The vocabulary is one of merges, so the path is not the one of least cost but the
one that merging by score gives.  A sequence of pieces is that encoding exactly if
each two neighbours, merged alone, stay two; so an edge relaxes its end only if
its piece and the piece that led to its start are such a pair.  Each place then
has one predecessor.  Pairs are tested by merging and remembered.

Segments.  No piece has a space mark after another character, and characters that
no longer piece holds (a line feed, for one) always stand alone; the text is cut
there.  Runs of several space marks, whose pieces tie in score, are merged
directly.  Unknown characters become byte pieces.

One scan, no shuffle.  A worker keeps about ``SEGMENTS`` encodings and ``PAIRS``
tested pairs.  The vocabulary goes to the tasks with the code; its file is read on
the driver only.

Edges: a null or empty text has no pieces and decodes to the empty text.  A text
that itself holds U+2581 decodes with spaces there, as the format has it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import tables, words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SEGMENTS, PAIRS = 200_000, 500_000
BATCH = 1 << 17  # bytes of segments that are indexed at once
_DEPTH = 16  # bytes that the suffix array sorts by; longer pieces are compared in full


class Vocabulary:
    """Pieces and scores; made from a model file with load()."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int]):
        self.pieces, self.scores, self.byte_ids = pieces, scores, byte_ids
        self.key = hashlib.sha256(repr((pieces, scores, sorted(byte_ids.items()))).encode()).hexdigest()

    def __getstate__(self):
        return {"pieces": self.pieces, "scores": self.scores, "byte_ids": self.byte_ids, "key": self.key}

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if model.is_unknown(i) or model.is_control(i) or model.is_unused(i)}
        bytes_at = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        pieces = ["" if i in special or model.is_byte(i) else p for i, p in enumerate(pieces)]
        return cls(pieces, [model.get_score(i) for i in range(n)], bytes_at)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        encoder = _encoders.get(self.key)
        if encoder is None:
            _encoders.clear()  # one vocabulary at a time
            encoder = _encoders[self.key] = Encoder(self)
        return encoder.encode(texts)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        if not hasattr(self, "raw"):
            self.raw = [p.replace(MARK, " ").encode() for p in self.pieces]
            for b, i in self.byte_ids.items():
                self.raw[i] = bytes([b])
        raw = self.raw
        out = b"".join([raw[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


# A Python worker serves one task after the other; what it has learnt stays with it.
_encoders: dict[str, Encoder] = {}


class Pairs:
    """Which neighbouring pieces stay as they are: an open-addressing table in numpy."""

    SLOTS = 1 << 21

    def __init__(self):
        self.keys, self.values, self.n = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, bool), 0

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)

    def stay(self, a: np.ndarray, b: np.ndarray, test) -> np.ndarray:
        keys = a << 20 | b
        out, slot, left = np.zeros(len(keys), bool), self._slot(keys), np.arange(len(keys))
        missing = []
        while len(left):
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            missing.append(left[there == -1])
            left = left[~hit & (there != -1)]
            slot[left] = (slot[left] + 1) % self.SLOTS
        new = np.concatenate(missing) if missing else left
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            if self.n + len(fresh) > PAIRS:
                self.__init__()
            said = np.array([test(k >> 20, k & 0xFFFFF) for k in fresh.tolist()], bool)
            for k, v, at in zip(fresh.tolist(), said.tolist(), self._slot(fresh).tolist(), strict=True):
                while self.keys[at] != -1:
                    at = (at + 1) % self.SLOTS
                self.keys[at], self.values[at] = k, v
            self.n += len(fresh)
            out[new] = said[back]
        return out


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.id = {p: i for i, p in enumerate(vocabulary.pieces) if p}
        joint = set("".join(p for p in self.id if len(p) > 1))
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a space mark after another character")
        # Characters of a text that no longer piece holds stand alone; the mark starts a segment.
        inside = "".join(re.escape(c) for c in sorted(joint - {MARK}))
        self.segments = re.compile(f"{MARK}*[{inside}]+|{MARK}+|.", re.DOTALL).findall
        usable = [p for p in self.id if self._merged(p) == [self.id[p]]]
        raw = sorted((p.encode(), self.id[p]) for p in usable)
        self.raw, self.ids = [r for r, _ in raw], np.array([i for _, i in raw], np.int64)
        self.size = np.array([len(r) for r in self.raw], np.int64)
        self.low, self.high = (self._keys([r.ljust(_DEPTH, fill)[:_DEPTH] for r in self.raw]) for fill in (b"\0", b"\xff"))
        self.size_of = np.zeros(len(vocabulary.pieces), np.int64)
        self.size_of[self.ids] = self.size
        self.pairs = Pairs()
        # Encodings as 32-bit ids: of what stands between spaces, and of other segments.
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _keys(raw: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(-1, 2)

    def _merged(self, s: str) -> list[int]:
        """The encoding by merging the best pair, the leftmost first, until none is left."""
        parts: list[str | None] = list(s)
        ids, scores, n = self.id, self.v.scores, len(s)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pairs: list[tuple[float, int, str]] = []  # (-score, place of the left one, what comes out)

        def ask(i: int, j: int) -> None:
            k = ids.get(parts[i] + parts[j])
            if k is not None:
                heapq.heappush(pairs, (-scores[k], i, parts[i] + parts[j]))

        for i in range(n - 1):
            ask(i, i + 1)
        while pairs:
            _, i, made = heapq.heappop(pairs)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != made:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = made, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                ask(i, after[i])
            if before[i] >= 0:
                ask(before[i], i)
        out: list[int] = []
        for p in parts:
            if p is not None:
                out += [ids[p]] if p in ids else [self.v.byte_ids[b] for b in p.encode()]
        return out

    def _stay(self, a: int, b: int) -> bool:
        """Do two neighbouring pieces stay as they are?"""
        return self._merged(self.v.pieces[a] + self.v.pieces[b]) == [a, b]

    def _edges(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of all occurrences."""
        n = len(data)
        padded = np.frombuffer(data + bytes(_DEPTH), np.uint8)
        words = np.ndarray(n + _DEPTH - 7, ">u8", padded, 0, (1,)).astype(np.uint64)
        first, second = words[:n], words[8 : n + 8]
        array = np.lexsort((second, first))  # the suffixes in order, as deep as _DEPTH
        a, b = first[array], second[array]
        start, end = np.searchsorted(a, self.low[:, 0], "left"), np.searchsorted(a, self.high[:, 0], "right")
        for i in np.flatnonzero((self.size > 8) & (end > start)).tolist():
            lo, hi = start[i], end[i]
            start[i] = lo + np.searchsorted(b[lo:hi], self.low[i, 1], "left")
            end[i] = lo + np.searchsorted(b[lo:hi], self.high[i, 1], "right")
        count = np.maximum(end - start, 0)
        some = np.flatnonzero(count)
        count = count[some]
        rank = np.repeat(start[some], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place, piece = array[rank], np.repeat(some, count)
        long = np.flatnonzero(self.size[piece] > _DEPTH)
        if len(long):
            wrong = [j for j in long.tolist() if not data.startswith(self.raw[piece[j]], int(place[j]))]
            place, piece = np.delete(place, wrong), np.delete(piece, wrong)
        return place, self.ids[piece]

    def _relaxed(self, segments: list[str]) -> None:
        """Encode segments together and remember them.

        All segments advance in step: edges are sorted by their place in the
        segment, and those of one place are relaxed at once.
        """
        raw = [s.encode() for s in segments]
        data = b"\n".join(raw)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        place, piece = self._edges(data)
        offset = place - np.repeat(starts, size + 1)[place]
        order = np.argsort(offset.astype(np.uint16) if size.max() < 1 << 16 else offset, kind="stable")
        place, piece, offset = place[order], piece[order], offset[order]
        to = place + self.size_of[piece]
        led = np.full(len(data) + 1, -2, np.int64)  # the piece that leads to a place; -1 at a start, -2 where none does
        led[starts] = -1
        cuts = np.flatnonzero(np.diff(offset)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
            before, t = led[place[i:j]], piece[i:j]
            good = before == -1
            ask = np.flatnonzero(before >= 0)
            good[ask] = self.pairs.stay(before[ask], t[ask], self._stay)
            led[to[i:j][good]] = t[good]
        at, owner, found = ends.copy(), np.arange(len(raw)), []
        failed = np.zeros(len(raw), bool)
        while len(at):
            t = led[at]
            failed[owner[t == -2]] = True
            live = t >= 0
            at, owner, t = at[live], owner[live], t[live]
            at = at - self.size_of[t]
            found.append((at, owner, t))
        at, owner, t = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        ids, cut = t[order].astype(np.int32).tobytes(), (4 * np.cumsum(np.bincount(owner, minlength=len(raw)))).tolist()
        for i, (s, bad) in enumerate(zip(segments, failed.tolist(), strict=True)):
            self._keep(s, self._packed(s) if bad else ids[cut[i - 1] if i else 0 : cut[i]])

    def _packed(self, s: str) -> bytes:
        return np.array(self._merged(s), np.int32).tobytes()

    def _keep(self, s: str, ids: bytes) -> None:
        if s[0] == MARK and s[:2] != MARK * 2:
            self.words[s[1:]] = ids
        else:
            self.known[s] = ids

    def _of(self, s: str) -> bytes | None:
        return self.words.get(s[1:]) if s[0] == MARK and s[:2] != MARK * 2 else self.known.get(s)

    def _learn(self, segments: list[str]) -> None:
        """Encode the segments that are not known yet."""
        new, size = [], 0
        for s in dict.fromkeys(segments):
            if self._of(s) is not None:
                continue
            if s[:2] == MARK * 2 or len(s) == 1:
                self._keep(s, self._packed(s))
                continue
            new.append(s)
            size += len(s)
            if size > BATCH:
                self._relaxed(new)
                new, size = [], 0
        if new:
            self._relaxed(new)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        table_of, of = self.words, self._of
        for table in (table_of, self.known):
            if len(table) > SEGMENTS:
                table.clear()
        # A text without double marks is cut at its spaces; a word is a mark and what follows.
        plain = [not (t.startswith(" ") or "  " in t or MARK in t) for t in texts]
        parts = [t.split(" ") if p else self.segments(MARK + t.replace(" ", MARK)) for t, p in zip(texts, plain, strict=True)]
        new = {w: self.segments(MARK + w) for w in {w for x, p in zip(parts, plain, strict=True) if p for w in x} if w not in table_of}
        self._learn([s for x in new.values() for s in x] + [s for x, p in zip(parts, plain, strict=True) if not p for s in x])
        for w, x in new.items():
            if len(x) > 1:
                table_of[w] = b"".join(map(of, x))
        out = []
        for t, x, p in zip(texts, parts, plain, strict=True):
            out.append(np.frombuffer(b"".join(map(table_of.__getitem__ if p else of, x)) if t else b"", np.int32))
        return out


def _groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_pieces and ids (array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.small(batches):
            texts = batch.column("text").to_pylist()
            for a, b in _groups(texts):
                ids = vocabulary.encode(texts[a:b])
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(offsets)), column], ["doc_id", "n_pieces", "ids"])

    return tables.named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_pieces int, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and the text of ``ids``; null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.small(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([vocabulary.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return tables.named(encoded, "doc_id", "ids").select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


REPORT = "doc_id long, n_pieces int, ids_sha256 string, decoded_sha256 string, exact boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int32()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())])


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per document: how many pieces, digests of the ids (little-endian 32-bit) and of the decoded text, and whether that is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.small(batches):
            texts, ids_of, rows = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), []
            for a, b in _groups(texts):
                for i, text, ids in zip(ids_of[a:b], texts[a:b], vocabulary.encode(texts[a:b]), strict=True):
                    back = vocabulary.decode(ids)
                    rows.append((i, len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

    return tables.named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, REPORT)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int32()), ("ids", pa.list_(pa.int32())), ("exact", pa.bool_())])


def encoded_exactly(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_pieces, ids, and whether decoding the ids gives back the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.small(batches):
            texts, at = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in _groups(texts):
                ids = vocabulary.encode(texts[a:b])
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                exact = pa.array([vocabulary.decode(x) == t for x, t in zip(ids, texts[a:b], strict=True)])
                yield pa.RecordBatch.from_arrays([at.slice(a, b - a), pa.array(np.diff(offsets)), column, exact], schema=_ENCODED)

    return tables.named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_pieces int, ids array<int>, exact boolean")
