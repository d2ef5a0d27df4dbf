"""Operator 6: removal of lines that many documents hold, by two Bloom filters.

Scan 1: every task sets the hashes of each document's distinct line keys in two
filters, of hashes seen once and of hashes seen again; bits travel, not hashes, and
are merged per range of the filter (bloom.py).  Scan 2: only keys that the second
filter suspects travel as text, with the number of documents that hold them and the
smallest doc_id, added up per task first; sums per exact key decide.  Scan 3: lines
are dropped where they stand.  A false positive costs a key's text on the wire, never
a result.

What scan 3 must know are the keys that go.  Up to ``SENT`` bytes of them are sent
to all tasks, and the texts are not shuffled at all.  Beyond that, suspected lines are
joined with these keys, and the places found are joined with the rows; results are
the same either way.

A key that every document holds travels once per task, so no sum sees more than one
entry per key and task.

``mode="drop"`` removes all lines of a key found in at least ``min_docs``
documents; ``mode="first"`` keeps the first occurrence: of the document with
the smallest doc_id, there the first line.

Ties and edges: a document is a row, so repeated rows count each; a null text is
one empty line; a null doc_id is larger than any other; keys under ``min_chars`` code
points are never dropped; in mode "first", rows that tie in doc_id keep the first line
of a key each.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from pagemill.llm import bloom, components, tables, words

_U = np.uint64
SENT = 4 << 20  # bytes of keys that are sent to all tasks, at most
TOLD = 50_000  # keys that a task adds up before it tells
LAST = (1 << 63) - 1  # stands for a null doc_id
FIELDS = [("doc_id", LongType()), ("n_lines", LongType()), ("n_dropped", LongType()), ("kept_sha256", StringType()), ("kept_text", StringType()), ("was_null", BooleanType())]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class Lines:
    """The lines of some texts, their keys and the hashes of these."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        self.lower = self.data.lower()
        array = np.frombuffer(self.lower, np.uint8)
        feeds = np.flatnonzero(array == 10)
        self.starts, self.ends = np.concatenate([[0], feeds + 1]), np.append(feeds, len(array))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, begins)  # of each text its first line; one more at the end
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        solid = np.append(np.flatnonzero(~_SPACE[array]), len(array))
        at = np.searchsorted(solid, self.starts)
        self.a = np.minimum(solid[at], self.ends)
        self.z = np.maximum(solid[np.searchsorted(solid, self.ends) - 1] + 1, self.a) if len(solid) > 1 else self.a
        self.z = np.where(self.a == self.ends, self.a, self.z)
        self.hash = words.hashes(array, self.a, self.z)
        self.chars = np.cumsum(np.append(0, (array & 0xC0) != 0x80))

    def long(self, min_chars: int) -> np.ndarray:
        """Lines whose key has at least ``min_chars`` code points, and is not empty."""
        return np.flatnonzero(self.chars[self.z] - self.chars[self.a] >= max(1, min_chars))

    def distinct(self, which: np.ndarray) -> np.ndarray:
        """Of these lines the first of each hash in its document."""
        order = which[np.lexsort((which, self.hash[which], self.doc[which]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.hash[order[1:]] != self.hash[order[:-1]]) | (self.doc[order[1:]] != self.doc[order[:-1]])
        return order[new]

    def key(self, i: int) -> bytes:
        return self.lower[self.a[i] : self.z[i]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    for batch in words.small(batches):
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        for a, b in words.chunks(texts):
            yield batch.slice(a, b - a), Lines(texts[a:b])


def _suspects(rows: DataFrame, min_chars: int) -> bloom.Filter:
    """The filter of the hashes of keys that came in two documents at least."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, x in _chunks(iter([batch])):
            yield x.hash[x.distinct(x.long(min_chars))]

    return bloom.built(rows.select("text"), hashes, bloom.bits_for(size // 64), again=True)


def _often(rows: DataFrame, seen: bloom.Filter, least: int, min_chars: int) -> DataFrame:
    """key, first: the keys that ``least`` documents hold, and the smallest doc_id of these."""

    def tell(found: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64())], ["key", "n", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list[int]] = {}
        for batch, x in _chunks(batches):
            ids = batch.column("id").to_pylist()
            which = x.long(min_chars)
            which = which[seen.has(x.hash[which])] if least > 1 else which
            # Two keys of one hash are two keys here, so a document's keys are told apart as text.
            for doc, key in dict.fromkeys((int(x.doc[i]), x.key(i)) for i in which.tolist()):
                n = found.setdefault(key, [0, LAST])
                n[0], n[1] = n[0] + 1, min(n[1], ids[doc])
            if len(found) > TOLD:
                yield tell(found)
                found.clear()
        yield tell(found)

    told = rows.select("id", "text").mapInArrow(run, "key binary, n long, first long")
    return told.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where(F.col("n") >= least).select("key", "first")


def _row_keys() -> list[Column]:
    """Two hashes that tell rows apart by doc_id and text; rows equal in both have equal results."""
    return [F.xxhash64(F.lit(i), "id", F.col("doc_id").isNull(), "text").alias(f"k{i}") for i in (1, 2)]


def _places(rows: DataFrame, seen: bloom.Filter, often: DataFrame, least: int, min_chars: int) -> DataFrame:
    """k1, k2, gone (array of line and first): the lines of each row whose key is among ``often``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _chunks(batches):
            which = x.long(min_chars)
            which = which[seen.has(x.hash[which])] if least > 1 else which
            doc = pa.array(x.doc[which])
            keys = [batch.column(c).take(doc) for c in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(which - x.first[x.doc[which]]), pa.array([x.key(i) for i in which.tolist()], pa.binary())], ["k1", "k2", "line", "key"])

    lines = rows.select(*_row_keys(), "text").mapInArrow(run, "k1 long, k2 long, line long, key binary")
    return lines.join(often, "key").groupBy("k1", "k2").agg(F.collect_set(F.struct("line", "first")).alias("gone"))


def _kept(x: Lines, doc: int, gone: dict[int, int], mine: int, mode: str) -> tuple[int, int, bytes]:
    """(lines, lines dropped, what is kept) of a text; gone: line -> smallest doc_id with its key."""
    a, b = int(x.first[doc]), int(x.first[doc + 1])
    kept, taken = [], set()
    for i in range(a, b):
        if i - a in gone:
            k = x.key(i)
            if mode == "drop" or gone[i - a] != mine or k in taken:
                continue
            taken.add(k)
        kept.append(x.data[x.starts[i] : x.ends[i]])
    return b - a, b - a - len(kept), b"\n".join(kept)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, mode: str = "drop", sent: int = SENT) -> DataFrame:
    """Each document with its repeated lines dropped; see the module's text.

    Returns doc_id, n_lines, n_dropped, kept_sha256, kept_text.
    """
    return _rows(tables.named(docs, "doc_id", "text"), min_docs, min_chars, mode, sent, extra=[]).drop("was_null")


def _rows(docs: DataFrame, min_docs: int, min_chars: int, mode: str, sent: int, extra: list[str]) -> DataFrame:
    if mode not in ("drop", "first"):
        raise ValueError(f"no such mode: {mode}")
    components.shared_folder(docs.sparkSession)
    least, last = max(1, min_docs), LAST
    schema = StructType([*(StructField(k, t) for k, t in FIELDS), *(docs.select(extra).schema.fields if extra else [])])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("text").isNull().alias("was_null"), *extra)
    seen = _suspects(rows, min_chars)
    often = _often(rows, seen, least, min_chars).checkpoint()
    size = often.agg(F.sum(F.octet_length("key").cast("long") + 8)).first()[0] or 0
    known: dict[bytes, int] = {}
    if size <= sent:
        known = {bytes(r.key): r.first for r in often.collect()}
        rows = rows.withColumn("gone", F.lit(None).cast("array<struct<line:long,first:long>>"))
    else:
        rows = rows.select("*", *_row_keys()).join(_places(rows, seen, often, least, min_chars), ["k1", "k2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = np.unique(words.hashes_of(list(known)))
        for batch, x in _chunks(batches):
            hit = np.flatnonzero(np.isin(x.hash, hashes)) if len(hashes) else np.empty(0, np.int64)
            places: list[dict[int, int]] = [{p["line"]: p["first"] for p in g or ()} for g in batch.column("gone").to_pylist()]
            for i in hit.tolist():
                k = x.key(i)
                if k in known:
                    places[x.doc[i]][i - int(x.first[x.doc[i]])] = known[k]
            out = [_kept(x, d, gone, mine, mode) for d, (gone, mine) in enumerate(zip(places, batch.column("id").to_pylist(), strict=True))]
            n, dropped, left = zip(*out, strict=True)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in left]), pa.array([t.decode() for t in left], pa.string()), batch.column("was_null"), *(batch.column(c) for c in extra)]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return rows.select("doc_id", "id", "text", "was_null", "gone", *extra).mapInArrow(run, schema)


def rewritten(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, mode: str = "drop", sent: int = SENT) -> DataFrame:
    """The rows of ``docs`` with the lines kept as their text and its length as n_chars; other columns stay."""
    wanted = ["doc_id", "text", *(c for c in docs.columns if c == "n_chars")]
    rows = tables.named(docs, *wanted)
    kept = _rows(rows, min_docs, min_chars, mode, sent, extra=tables.others(rows))
    text = F.when(~F.col("was_null"), F.col("kept_text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(rows.columns).toDF(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos,
             translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT doc_id, line, pos, key IN (SELECT key FROM often) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""
