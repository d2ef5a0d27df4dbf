"""Operator 3: benchmark passages in documents, by a prefix-filtered set join.

An item's windows are its runs of ``window`` words (an item with fewer is one
window).  A document that holds a window holds all its shingles of up to five words,
so one of them, the rarest in the corpus, is prefix enough.

1. The windows become a table of their distinct texts, and another of their items.
2. A first scan of the documents counts the shingles that windows have (a Bloom
   filter of them, of bounded size, turns the others away), added up per task first.
   Each window's prefix is its rarest shingle.
3. A second scan finds the places of prefix shingles (with a filter of these) and
   sends each with the words around it that a window may cover.
4. Places and prefixes are joined on the shingle.  The prefix's place in the window
   fixes where the window would start (positional bound), the document must reach as
   far on either side (length bound), and then the words themselves are compared.
5. Windows found become spans and items of their document, and these are joined with
   the documents' word counts.

The table of prefixes is sent to all tasks while it has at most ``SENT`` rows; a
larger benchmark is joined by sort and merge, where skewed shingles can be split.
Nothing of it is held by the driver but its filters.

Ties and edges: a null or wordless text has no words and is clean; wordless items
match nothing; a null item_id is written as an empty string; several rows of one
item_id count once; results are per row of documents, and rows equal in doc_id and
text have equal results.  An empty table of documents gives no rows, an empty
benchmark leaves all clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm import bloom, components, tables, words

SHINGLE = 5
SENT = 20_000  # rows of a table that is sent to all tasks, at most; about 200 bytes each
TOLD = 500_000  # shingles that a task counts before it tells
_WORD = np.zeros(256, bool)
_WORD[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True


class Words(NamedTuple):
    """The words of a run of texts."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray  # of each word
    first: np.ndarray  # of each text, its first word; one more at the end


def tokenised(texts: list[bytes]) -> Words:
    data = b"\n".join(texts).lower()
    array = np.frombuffer(data, np.uint8)
    starts, ends = words.spans(array, _WORD)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, begins)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, starts, ends, words.hashes(array, starts, ends), doc, first)


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item, size, k, words, shingles: each window of each item; shingles are hashes of k words, in order."""
    names = ["item", "size", "k", "words", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        tell = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64())), strict=True)], names)
        for batch in batches:
            for item, text in zip(*(batch.column(c).to_pylist() for c in ("item", "text")), strict=True):
                w = tokenised([text.encode()])
                n = len(w.starts)
                size = min(n, window)
                k = min(size, SHINGLE)
                g = words.grams(w.hashes, k).view(np.int64) if n else None
                parts = [w.data[a:b].decode() for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
                for i in range(n - size + 1 if n else 0):
                    rows.append((item, size, k, " ".join(parts[i : i + size]), g[i : i + size - k + 1].tolist()))
                    if len(rows) >= 4096:
                        yield tell()
                        rows.clear()
        if rows:
            yield tell()

    rows = tables.named(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item string, size int, k int, words string, shingles array<long>")


def _shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each shingle of k words inside a text."""
    g = words.grams(w.hashes, k)
    at = np.flatnonzero(w.doc[: len(g)] == w.doc[k - 1 :])
    return at, g[at]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in words.small(batches):
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        for a, b in words.chunks(texts):
            yield batch.slice(a, b - a), tokenised(texts[a:b])


def _filter(rows: DataFrame, column: str) -> bloom.Filter:
    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield np.unique(np.asarray(batch.column(column)).view(np.uint64))

    return bloom.built(rows.select(column), hashes, bloom.bits_for(rows.count()))


def _counts(docs: DataFrame, wanted: bloom.Filter, lengths: list[int]) -> DataFrame:
    """shingle, n: how often shingles that pass the filter are in the documents."""

    def tell(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        every, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        n = np.bincount(place, np.concatenate([n for _, n in parts]), len(every)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(n)], ["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for _, w in _texts(batches):
            for k in lengths:
                g = _shingles(w, k)[1]
                parts.append(np.unique(g[wanted.has(g)], return_counts=True))
                size += len(parts[-1][0])
            if size > TOLD:
                yield tell(parts)
                parts, size = [], 0
        if size:
            yield tell(parts)

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


PLACE = "array<struct<shingle:long,pos:int,before:int,n:int,around:string>>"
_PLACE = pa.list_(pa.struct([("shingle", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("n", pa.int32()), ("around", pa.string())]))


def _places(docs: DataFrame, prefixes: bloom.Filter, lengths: list[int], window: int) -> DataFrame:
    """The columns of docs but text, n_words, and the places of prefix shingles with the words around them."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in _texts(batches):
            places: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for k in lengths:
                at, g = _shingles(w, k)
                some = np.flatnonzero(prefixes.has(g))
                # A window of under SHINGLE words is its own shingle.
                reach = window if k == SHINGLE else k
                for j, h in zip(at[some].tolist(), g[some].view(np.int64).tolist(), strict=True):
                    doc = int(w.doc[j])
                    a, b = max(int(w.first[doc]), j - (reach - k)), min(int(w.first[doc + 1]), j + reach)
                    around = b" ".join([w.data[x:y] for x, y in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)])
                    places[doc].append({"shingle": h, "pos": j - int(w.first[doc]), "before": j - a, "n": b - a, "around": around.decode()})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.diff(w.first)), pa.array(places, _PLACE)], [*kept, "n_words", "places"])

    schema = ", ".join(f"{c} long" for c in kept)
    return docs.mapInArrow(run, f"{schema}, n_words long, places {PLACE}")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each row, as the starts and ends of their union, and how many words that has."""
    for batch in batches:
        hits = []
        for spans in batch.column("spans").to_pylist():
            out: list[int] = []
            for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
                if out and s["start"] <= out[-1]:
                    out[-1] = max(out[-1], s["end"])
                else:
                    out += [s["start"], s["end"]]
            hits.append(out)
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array([sum(h[1::2]) - sum(h[::2]) for h in hits], pa.int64()), pa.array(hits, pa.list_(pa.int64()))], ["k1", "k2", "n_hit", "hit_spans"])


def _sized(df: DataFrame, n: int, sent: int) -> DataFrame:
    """A side of a join, by its measured number of rows."""
    return F.broadcast(df) if n <= sent else df.hint("merge")


def _row_keys() -> list[Column]:
    """Two hashes that tell rows apart by doc_id and text."""
    return [F.xxhash64(F.lit(i), "doc_id", F.col("doc_id").isNull(), "text").alias(f"k{i}") for i in (1, 2)]


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, share: int, sent: int) -> DataFrame:
    """doc_id, k1, k2, n_words, n_hit, hit_spans, item_ids and contaminated of each row; docs has doc_id and text."""
    components.shared_folder(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *_row_keys())
    every = _windows(benchmark, window).checkpoint()
    distinct = every.select("words", "size", "k", "shingles").dropDuplicates(["words"]).checkpoint()
    lengths = sorted(r.k for r in distinct.select("k").distinct().collect())  # SHINGLE of them at most
    each = distinct.select("words", "size", F.posexplode("shingles").alias("at", "shingle"))
    counts = _counts(rows, _filter(each.select("shingle").distinct(), "shingle"), lengths)
    rarest = each.join(counts, "shingle", "left").groupBy("words", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "shingle")).alias("p"))
    prefix = rarest.select(F.col("p.shingle").alias("prefix"), F.col("p.at").alias("at"), "size", "words").checkpoint()
    found = _places(rows, _filter(prefix.select("prefix").distinct(), "prefix"), lengths, window).checkpoint()
    places = found.where(F.size("places") > 0).select("k1", "k2", F.explode("places").alias("p")).select("k1", "k2", "p.*")
    bounds = (F.col("shingle") == F.col("prefix")) & (F.col("at") <= F.col("before")) & (F.col("size") - F.col("at") <= F.col("n") - F.col("before"))
    start = F.col("before") - F.col("at")
    exact = F.array_join(F.slice(F.split("around", " "), start + 1, F.col("size")), " ") == F.col("words")
    hits = places.join(_sized(prefix, prefix.count(), sent), bounds).where(exact).select("k1", "k2", "words", (F.col("pos") - F.col("at")).cast("long").alias("start"), (F.col("pos") - F.col("at") + F.col("size")).cast("long").alias("end")).distinct().checkpoint()
    spans = hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans")).mapInArrow(_merged, "k1 long, k2 long, n_hit long, hit_spans array<long>")
    members = every.select("words", "item").distinct()
    items = hits.select("k1", "k2", "words").distinct().join(_sized(members, members.count(), sent), "words").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    whole = found.drop("places").join(spans, ["k1", "k2"], "left").join(items, ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<string>)")
    return whole.select("doc_id", "k1", "k2", "n_words", n_hit.alias("n_hit"), F.coalesce("hit_spans", none[0]).alias("hit_spans"), F.coalesce("item_ids", none[1]).alias("item_ids"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, sent: int = SENT) -> DataFrame:
    """Per document: its words, those inside occurrences of item windows, and the items found.

    ``contaminated``: at least one word is hit and ``share`` times the hit words
    are at least all words.  ``hit_spans`` holds starts and ends in words.
    """
    got = _searched(tables.named(docs, "doc_id", "text"), benchmark, window, share, sent)
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated", "item_ids", "hit_spans")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, sent: int = SENT) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    The keys of the others are sent to all tasks while there are at most ten times
    ``sent`` of them (16 bytes each), so that texts are not shuffled.
    """
    rows = tables.named(docs, "doc_id", "text")
    bad = _searched(rows, benchmark, window, share, sent).where("contaminated").select("k1", "k2").distinct().checkpoint()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mine = [F.xxhash64(F.lit(i), F.col("doc_id").cast("long"), F.col("doc_id").isNull(), text).alias(f"k{i}") for i in (1, 2)]
    kept = rows.select("*", *mine).join(_sized(bad, bad.count(), 10 * sent), ["k1", "k2"], "left_anti")
    return kept.select(rows.columns).toDF(*docs.columns)


ORACLE_SQL = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 13) AS k, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM iw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, p, win.k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
