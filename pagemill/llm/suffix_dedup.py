"""Operator 1: removal of repeated byte strings by hashed names and minimiser anchors.

A position's rank for its first 2L bytes is a function of the pair (rank at p,
rank at p + L); for lengths that are no power of two the second rank starts
earlier and overlaps.  Ranks here are names: the exact eight bytes at first,
then 64-bit mixtures of the pair (plus an independent 32-bit check), so equal
strings get equal names in every task without a global renumbering.  All
lengths are named inside a block; there is no Spark sort of ranks and no rerank.
Names are matched by hash bucket in three rounds, sorted by numpy in the workers,
and what has become unique takes no part in the next:

1. length 24, at the *anchors*: of the 27 strings of 24 bytes inside a window of
   50, the one with the smallest name.  Equal windows have equal anchors, so a
   window whose anchor no other document has is unique.
2. *runs*: the adjacent windows that share an anchor (at most 51).  The pair of
   the names of its first and last window, which overlap or touch, names all of
   a run's bytes.  A run that a smaller document has is removed whole.
3. length 50: single windows, only of the first holder of a run whose anchor
   also has other runs, that is where copies begin, end or differ.

Names take part once per block, whatever the number of copies (rounds.py).

Ties and edges: equal doc_ids never remove from each other; strings are judged on
the input; texts under 50 bytes stay; a null text is empty; a null doc_id counts
as the largest.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm import rounds, tables

ANCHOR = 24  # bytes of an anchor: three exact 8-byte ranks
CHUNK = 256 << 10  # bytes whose arrays are worked on at once
_U = np.uint64
# Odd multipliers of the two families of names.
_MULT = ((_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)), (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)))
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary, spans array<struct<start:long,end:long>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _mix(a: np.ndarray, b: np.ndarray, family: int) -> np.ndarray:
    p, q = _MULT[family]
    x = a * p
    x += b
    x *= q
    x ^= x >> _U(29)
    return x


def _doubled(r8: np.ndarray, family: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the strings of ANCHOR and of ``length`` bytes at each position."""
    r16 = _mix(r8[:-8], r8[8:], family)
    r24 = _mix(r16[:-8], r8[16:], family)
    r32 = _mix(r16[:-16], r16[16:], family)
    step, have = r32, 32
    while 2 * have < length:
        step, have = _mix(step[:-have], step[have:], family), 2 * have
    return r24, _mix(step[: len(step) - (length - have)], step[length - have :], family)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` adjacent values, by doubling."""
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class _Runs:
    """The runs of a block: per run its anchor, first window, window count, document and names."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int, names: bool):
        parts: dict[str, list] = {k: [] for k in ("anchor", "at", "n", "doc", "name", "check")}
        self.length, self.windows = length, []  # (first document, offsets, window names, checks) of each chunk
        start = 0
        while start < len(texts):
            end, total = start, 0
            while end < len(texts) and (end == start or total + len(texts[end]) <= CHUNK):
                total += len(texts[end])
                end += 1
            self._chunk(texts[start:end], start, parts, names)
            start = end
        kinds = {"anchor": np.uint64, "at": np.int64, "n": np.int64, "doc": np.int64, "name": np.uint64, "check": np.uint32}
        for k, kind in kinds.items():
            setattr(self, k, np.concatenate(parts[k]) if parts[k] else np.empty(0, kind))
        self.id = ids[self.doc] if len(self.doc) else np.empty(0, np.int64)

    def _chunk(self, texts: list[bytes], first: int, parts: dict, names: bool) -> None:
        length = self.length
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        if len(data) < length:
            return
        r8 = np.ndarray(len(data) - 7, "<u8", data, 0, (1,)).astype(np.uint64)
        r24, full = _doubled(r8, 0, length)
        least = _least(r24, length - ANCHOR + 1)
        n = len(full)
        opens = np.zeros(n + 1, bool)
        opens[1:n] = least[1:] != least[:-1]
        opens[0] = opens[n] = True
        opens[ends[:-1][ends[:-1] < n]] = True
        cross = np.maximum(ends - length + 1, 0)  # the first window that does not fit in its document
        opens[cross[cross < n]] = True
        at = np.flatnonzero(opens)
        size = np.diff(at)
        at = at[:-1]
        most = length + 1
        if (size > most).any():
            pieces = -(-size // most)
            offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at, left = np.repeat(at, pieces) + offset * most, np.repeat(size, pieces) - offset * most
            size = np.minimum(left, most)
        doc = np.searchsorted(ends, at, side="right")
        fits = at + length <= ends[doc]
        at, size, doc = at[fits], size[fits], doc[fits]
        anchor = least[at] * _MULT[1][0]  # minima are small; a product spreads them
        parts["anchor"].append(anchor ^ (anchor >> _U(31)))
        parts["at"].append(at - (ends - sizes)[doc])
        parts["n"].append(size)
        parts["doc"].append(doc + first)
        if names:
            check = _doubled(r8, 1, length)[1]
            last = at + size - 1
            parts["name"].append(_mix(full[at], full[last] + size.astype(np.uint64), 0))
            parts["check"].append((_mix(check[at], check[last] + size.astype(np.uint64), 1) >> _U(32)).astype(np.uint32))
            self.windows.append((first, ends - sizes, full, check))

    def keys(self, n_buckets: int) -> np.ndarray:
        """Bucket in the high half, 32 more bits of the anchor in the low half."""
        return (rounds.bucket_of(self.anchor, n_buckets) << _U(32)) | (self.anchor & _U(0xFFFFFFFF))

    def single(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each window of the runs ``which``: run, name, check."""
        runs, name, check = [], [], []
        firsts = np.array([w[0] for w in self.windows] + [1 << 62])
        part = np.searchsorted(firsts, self.doc[which], side="right") - 1
        for k, (first, begins, full, second) in enumerate(self.windows):
            mine = which[part == k]
            n = self.n[mine]
            run = np.repeat(mine, n)
            at = np.repeat(begins[self.doc[mine] - first] + self.at[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            runs.append(run)
            name.append(full[at])
            check.append((second[at] >> _U(32)).astype(np.uint32))
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        return cat(runs, np.int64), cat(name, np.uint64), cat(check, np.uint32)


def _shared(payloads: list[bytes]) -> list[bytes]:
    """Round 1, at a bucket: is the key in another block's message?"""
    keys = [np.frombuffer(p, np.uint32) for p in payloads]
    every = np.sort(np.concatenate(keys))
    more = np.unique(every[1:][every[1:] == every[:-1]])
    return [rounds.bits(np.isin(k, more, assume_unique=True)) for k in keys]


_RUN = np.dtype([("anchor", "<u4"), ("check", "<u4"), ("name", "<u8"), ("id", "<i8")])
_WINDOW = np.dtype([("name", "<u8"), ("id", "<i8"), ("check", "<u4")])


def _earlier(items: np.ndarray, keys: tuple[str, ...]) -> np.ndarray:
    """Has another item of the same keys a smaller id?"""
    order = np.lexsort([items["id"], *(items[k] for k in reversed(keys))])
    same = np.zeros(len(items), bool)
    same[1:] = np.logical_and.reduce([items[k][order[1:]] == items[k][order[:-1]] for k in keys])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(items))))
    out = np.empty(len(items), bool)
    out[order] = items["id"][order] > items["id"][order[head]]
    return out


def _runs_answer(payloads: list[bytes]) -> list[bytes]:
    """Round 2: bit 0, a smaller document has the run; bit 1, the anchor has other runs."""
    parts = [np.frombuffer(p, _RUN) for p in payloads]
    items = np.concatenate(parts)
    earlier = _earlier(items, ("anchor", "name", "check"))
    order = np.lexsort((items["name"], items["anchor"]))
    a, s = items["anchor"][order], items["name"][order]
    varies = np.zeros(len(items), bool)
    differs = np.flatnonzero((a[1:] == a[:-1]) & (s[1:] != s[:-1]))
    varies[order] = np.isin(a, a[differs])
    code = (earlier | (varies.astype(np.uint8) << 1)).astype(np.uint8)
    cut = np.cumsum([len(p) for p in parts])[:-1]
    return [x.tobytes() for x in np.split(code, cut)]


def _windows_answer(payloads: list[bytes]) -> list[bytes]:
    parts = [np.frombuffer(p, _WINDOW) for p in payloads]
    earlier = _earlier(np.concatenate(parts), ("name", "check"))
    return [rounds.bits(x) for x in np.split(earlier, np.cumsum([len(p) for p in parts])[:-1])]


class _Block:
    """What a block knows after the rounds whose answers it has."""

    def __init__(self, table: pa.Table, got: dict, length: int, n_buckets: int, stage: int):
        self.ids, self.none, self.texts = rounds.rows_of(table)
        self.n_buckets = n_buckets
        self.runs = runs = _Runs(self.ids, self.texts, length, names=stage > 1)
        keys = runs.keys(n_buckets)
        self.keys, place, count = np.unique(keys, return_inverse=True, return_counts=True)
        if stage == 1:
            return
        shared = self._bits(got[1], (self.keys >> _U(32)).astype(np.int64)) if len(self.keys) else np.empty(0, bool)
        self.suspect = np.flatnonzero((shared | (count > 1))[place]) if len(keys) else np.empty(0, np.int64)
        s = self.suspect
        key = keys[s]
        order = np.lexsort((runs.id[s], runs.check[s], runs.name[s], key))
        pairs = np.zeros(len(s), bool)
        pairs[1:] = (runs.check[s][order[1:]] == runs.check[s][order[:-1]]) & (runs.name[s][order[1:]] == runs.name[s][order[:-1]]) & (key[order[1:]] == key[order[:-1]])
        heads = np.flatnonzero(~pairs)
        group = np.cumsum(~pairs) - 1
        self.item_runs = s[order[heads]]  # each distinct run, by its smallest document
        self.item_bucket = (key[order[heads]] >> _U(32)).astype(np.int64)
        self.items = np.empty(len(heads), _RUN)
        self.items["anchor"] = (key[order[heads]] & _U(0xFFFFFFFF)).astype(np.uint32)
        self.items["check"], self.items["name"], self.items["id"] = runs.check[self.item_runs], runs.name[self.item_runs], runs.id[self.item_runs]
        self.group = np.empty(len(s), np.int64)
        self.group[order] = group
        if stage == 2:
            return
        code = self._bytes(got[2], self.item_bucket)
        gone = (code & 1).astype(bool)
        later = runs.id[s] > self.items["id"][self.group] if len(s) else np.empty(0, bool)
        self.removed = np.zeros(len(runs.at), bool)
        self.removed[s] = gone[self.group] | later if len(s) else False
        first = (runs.id[s] == self.items["id"][self.group]) & (~gone & ((code & 2) > 0))[self.group] if len(s) else np.empty(0, bool)
        self.split_runs = s[first]  # all places of a run in its first holder, and in rows that tie with it
        self.w_run, name, check = runs.single(self.split_runs)
        wid = runs.id[self.w_run]
        order = np.lexsort((wid, check, name))
        same = np.zeros(len(order), bool)
        same[1:] = (name[order[1:]] == name[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
        heads = np.flatnonzero(~same)
        self.w_group = np.empty(len(order), np.int64)
        self.w_group[order] = np.cumsum(~same) - 1
        self.w_items = np.empty(len(heads), _WINDOW)
        self.w_items["name"], self.w_items["check"], self.w_items["id"] = name[order[heads]], check[order[heads]], wid[order[heads]]
        self.w_bucket = rounds.bucket_of(self.w_items["name"], n_buckets).astype(np.int64)
        if stage == 3:
            return
        bit = self._bits(got[3], self.w_bucket)
        self.w_removed = bit[self.w_group] | (wid > self.w_items["id"][self.w_group]) if len(order) else np.empty(0, bool)

    @staticmethod
    def _bits(got: dict[int, bytes], buckets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buckets), bool)
        for bucket, at in rounds.split_sorted(buckets):
            out[at] = rounds.unbits(got[bucket], at.stop - at.start)
        return out

    @staticmethod
    def _bytes(got: dict[int, bytes], buckets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buckets), np.uint8)
        for bucket, at in rounds.split_sorted(buckets):
            out[at] = np.frombuffer(got[bucket], np.uint8)
        return out


def _result(block: _Block, length: int, texts: bool) -> pa.Table:
    runs = block.runs
    marks: list[list[tuple[int, int]]] = [[] for _ in block.texts]
    whole = np.flatnonzero(block.removed)
    for doc, at, n in zip(runs.doc[whole].tolist(), runs.at[whole].tolist(), runs.n[whole].tolist(), strict=True):
        marks[doc].append((at, at + n - 1 + length))
    if len(block.w_run):
        new = np.append(True, block.w_run[1:] != block.w_run[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))  # a run's windows are adjacent here
        offset = runs.at[block.w_run] + np.arange(len(block.w_run)) - first
        hit = np.flatnonzero(block.w_removed)
        for doc, at in zip(runs.doc[block.w_run[hit]].tolist(), offset[hit].tolist(), strict=True):
            marks[doc].append((at, at + length))
    rows = []
    for doc, (text, spans) in enumerate(zip(block.texts, marks, strict=True)):
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        kept, last = [], 0
        for a, b in merged:
            kept.append(text[last:a])
            last = b
        left = b"".join([*kept, text[last:]])
        rows.append((None if block.none[doc] else int(block.ids[doc]), len(text), sum(b - a for a, b in merged), len(merged), hashlib.sha256(left).hexdigest(), left if texts else None, [{"start": a, "end": b} for a, b in merged] if texts else None))
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def dedup_substrings(docs: DataFrame, length: int = 50, block_bytes: int = rounds.BLOCK_BYTES, texts: bool = True) -> DataFrame:
    """Each document without the bytes that a smaller document's ``length``-byte strings cover.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``texts``,
    the bytes kept and the removed spans.  ``length`` is at least 33.
    """
    if length < 33:
        raise ValueError("length must be at least 33")
    docs = tables.named(docs, "doc_id", "text")
    n = rounds.count_blocks(docs, block_bytes)
    blocks = rounds.in_blocks(docs, n)

    def anchors(table: pa.Table, _: dict) -> rounds.Messages:
        b = _Block(table, {}, length, n, 1)
        return [(k, 1, b.keys[at].astype(np.uint32).tobytes()) for k, at in rounds.split_sorted((b.keys >> _U(32)).astype(np.int64))]

    def runs(table: pa.Table, got: dict) -> rounds.Messages:
        b = _Block(table, got := {1: {}, 2: {}, 3: {}} | rounds.unecho(got), length, n, 2)
        return [*((k, 2, b.items[at].tobytes()) for k, at in rounds.split_sorted(b.item_bucket)), *rounds.echo(got)]

    def windows(table: pa.Table, got: dict) -> rounds.Messages:
        b = _Block(table, got := {1: {}, 2: {}, 3: {}} | rounds.unecho(got), length, n, 3)
        return [*((k, 3, b.w_items[at].tobytes()) for k, at in rounds.split_sorted(b.w_bucket)), *rounds.echo(got)]

    def result(table: pa.Table, got: dict) -> pa.Table:
        return _result(_Block(table, {1: {}, 2: {}, 3: {}} | rounds.unecho(got), length, n, 4), length, texts)

    got = rounds.answer(rounds.send(blocks, None, anchors), _shared)
    got = rounds.answer(rounds.send(blocks, got, runs), _runs_answer)
    got = rounds.answer(rounds.send(blocks, got, windows), _windows_answer)
    return rounds.finish(blocks, got, result, SCHEMA)


# Every 50-byte string as a row: for small tables.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, n, p, b[p:p + 49] AS w FROM (SELECT doc_id, n, b, unnest(range(1, n - 48)) AS p FROM d)),
f AS (SELECT w, min(doc_id) AS first FROM s GROUP BY w),
g AS (SELECT s.doc_id, s.p FROM s JOIN f ON s.w = f.w WHERE f.first < s.doc_id),
o AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS opens FROM g),
r AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM o),
x AS (SELECT doc_id, k, min(p) AS a, max(p) + 49 AS z FROM r GROUP BY doc_id, k),
y AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS q FROM x),
m AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS last FROM x GROUP BY doc_id),
kept AS (SELECT y.doc_id, string_agg(hex(b[q:a - 1]), '' ORDER BY a) AS h FROM y JOIN d ON y.doc_id = d.doc_id GROUP BY y.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN m.doc_id IS NULL THEN b ELSE unhex(h || hex(b[last + 1:n])) END) AS kept_sha256
FROM d LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
