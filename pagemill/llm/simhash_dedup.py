"""Operator 10: near-duplicates by SimHash, linked through vantage-point trees.

A fingerprint has a bit set where over half of the XXH64 values of a document's
3-word shingles have it.  Two fingerprints link if they differ in at most ``radius``
bits; a component is what links reach.

Search.  The 64 bits are cut into two halves; of a pair within the radius, one
half differs by at most ``radius // 2`` bits.  Each half has a vantage-point tree
over the distances of its own bits.  A fingerprint's home is the leaf that its
distances lead to; with the triangle bounds it visits every leaf that may hold a
partner, so only fingerprints near a boundary go to several shards.  A leaf
compares homes with visitors on all 64 bits.

Leaves grow in number, not in size.  The first trees are fitted on a sample of at
most ``SAMPLE`` fingerprints.  A leaf of more than ``MOST`` points is split again,
round after round, by a tree of at most ``DEEPER`` levels fitted on a sample of its
own members: over the bits of its half, or, where these do not tell its members
apart, over all bits (then with bounds of ``radius``).  Such trees are made by
tasks and joined to the members.  Where neither makes the work less, as in a ball
of fingerprints that are all near each other, the leaf is dealt into tiles: its
members by hash into parts, and each two parts are a leaf.  So no task ever holds
a group of much more than ``MOST`` points, and a bad sample costs time, never links.

Only distinct fingerprints are searched, so exact copies add nothing.  A leaf
emits a spanning forest of its links, at most one row per fingerprint, and grows
each component outward from a seed, so that a dense group is absorbed in a few
passes instead of being compared in all pairs.

Ties and edges: a text without words has fingerprint zero and links like any
other; under three words the whole sequence is the one shingle; a null text is
empty; repeated rows are one component; a null doc_id counts as the largest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm import components, tables, words

SHINGLE = 3
SAMPLE = 1 << 16  # fingerprints that the first trees are fitted on, at most
LEAF = 1024  # homes wanted in a leaf
PER_LEAF = 16  # fingerprints of the sample for each leaf wanted
MOST = 8192  # points of a leaf, homes and visitors, beyond which it is split again
DEEPER = 4  # levels of the tree that splits a leaf again
MEMBERS = 1024  # of a leaf, that such a tree is fitted on
_U = np.uint64
HALVES = (_U(0x00000000FFFFFFFF), _U(0xFFFFFFFF00000000))
WHOLE, TILE = 2, 3  # kinds of a leaf beside the two halves
MASKS = (*HALVES, _U(0xFFFFFFFFFFFFFFFF))
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text."""
    found = text.lower().split()  # of bytes: A-Z, and the six ASCII spaces
    if not found:
        return 0
    if len(found) < size:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(size)), strict=False))
    hashes = np.fromiter(map(_hash, shingles), "<u8")
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    on = votes * 2 > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, keys, fp) of each row: fp is the fingerprint as a signed long; keys are further long columns."""
    names = ["doc_id", *(keys or {})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.small(batches):
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fps.view(np.int64))], [*names, "fp"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = tables.named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in (keys or {}).items()), text.alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


class Tree:
    """A complete vantage-point tree over some of the 64 bits: at a node, a pivot and the distance up to which points are inside."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, depth: int):
        self.mask, self.depth = mask, depth
        self.pivot = np.zeros(1 << depth, np.uint64)
        self.cut = np.zeros(1 << depth, np.int64)
        members = [np.unique(sample)]
        for level in range(depth):
            below = []
            for i, x in enumerate(members):
                node = (1 << level) + i
                if len(x):
                    # Of a few candidates, the pivot whose distances vary the most splits with the thinnest boundary.
                    tries = x[:: max(1, len(x) // 8)][:8]
                    far = np.bitwise_count((tries[:, None] ^ x[None, :]) & mask)
                    best = int(far.std(axis=1).argmax())
                    self.pivot[node], self.cut[node] = tries[best], int(np.median(far[best]))
                    inside = far[best] <= self.cut[node]
                    below += [x[inside], x[~inside]]
                else:
                    below += [x, x]
            members = below

    @classmethod
    def of(cls, mask: np.uint64, depth: int, data: bytes) -> Tree:
        """The tree whose pivots and cuts are ``data``."""
        tree = cls.__new__(cls)
        tree.mask, tree.depth = mask, depth
        tree.pivot, tree.cut = np.frombuffer(data, np.uint64, 1 << depth), np.frombuffer(data, np.int64, 1 << depth, 8 << depth)
        return tree

    def leaves(self, fps: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, leaf, whether home) of every leaf that may hold a point within ``slack``."""
        index, node, home = np.arange(len(fps)), np.ones(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.depth):
            d = np.bitwise_count((fps[index] ^ self.pivot[node]) & self.mask).astype(np.int64)
            cut = self.cut[node]
            near, far = d - slack <= cut, d + slack > cut
            inner = d <= cut
            index = np.concatenate([index[near], index[far]])
            home = np.concatenate([(home & inner)[near], (home & ~inner)[far]])
            node = np.concatenate([2 * node[near], 2 * node[far] + 1])
        return index, node, home


def _forest(fps: np.ndarray, home: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links (point, seed) that span the components of a leaf, where one end of a link at least is at home."""
    fps, first = np.unique(fps, return_index=True)
    home = home[first]
    at_home, lonely = np.flatnonzero(home), np.ones(len(fps), bool)
    step = max(1, (1 << 21) // max(1, len(fps)))
    for i in range(0, len(at_home), step):
        rows = at_home[i : i + step]
        near = np.bitwise_count(fps[rows][:, None] ^ fps[None, :]) <= radius
        near[np.arange(len(rows)), rows] = False
        lonely[near.any(axis=0)] = False
        lonely[rows[near.any(axis=1)]] = False
    rest = np.flatnonzero(~lonely)
    while len(rest):
        seed, edge, rest = rest[0], rest[:1], rest[1:]
        while len(edge) and len(rest):
            hit = np.zeros(len(rest), bool)
            step = max(1, (1 << 21) // len(rest))
            for i in range(0, len(edge), step):
                e = edge[i : i + step]
                left = np.flatnonzero(~hit)
                if not len(left):
                    break
                close = np.bitwise_count(fps[e][:, None] ^ fps[rest[left]][None, :]) <= radius
                close &= home[e][:, None] | home[rest[left]][None, :]
                hit[left[close.any(axis=0)]] = True
            edge, rest = rest[hit], rest[~hit]
            for x in edge.tolist():
                yield int(fps[x]), int(fps[seed])


def _fitted(n: int, leaf: int) -> tuple[int, int]:
    """The size of the sample and the depth of the first trees for n fingerprints."""
    size, depth = min(SAMPLE, max(4096, PER_LEAF * n // leaf)), 0
    while n / (1 << depth) > leaf and (size >> depth) > 8:
        depth += 1
    return size, depth


_PLACED = "leaf long, kind int, fp long, home boolean"


def _placed(leaf: np.ndarray, kind: np.ndarray, fps: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), pa.array(kind.astype(np.int32)), pa.array(fps.view(np.int64)), pa.array(home)], ["leaf", "kind", "fp", "home"])


def _refit(n: int, homes: int, kind: int, fps: np.ndarray, home: np.ndarray, radius: int, leaf: int, most: int) -> tuple[int, int, bytes]:
    """How to split a leaf of n points, from a sample: (kind, depth, its tree), or (TILE, number of parts, nothing)."""
    depth = min(DEEPER, max(1, int(np.ceil(np.log2(max(2, homes / leaf))))))
    for k in dict.fromkeys((kind, WHOLE)):
        tree = Tree(fps, MASKS[k], depth)
        index, node, inner = tree.leaves(fps, radius // len(HALVES) if k != WHOLE else radius)
        inside, every = np.bincount(node[home[index] & inner], minlength=2 << depth), np.bincount(node, minlength=2 << depth)
        if (inside * every).sum() < 0.7 * home.sum() * len(fps):  # comparisons after and before
            return k, depth, tree.pivot.tobytes() + tree.cut.tobytes()
    return TILE, -(-2 * n // most), b""


def _split(placed: DataFrame, over: DataFrame, radius: int, leaf: int, most: int) -> DataFrame:
    """The points of the leaves ``over`` (leaf, n, homes) in the smaller leaves that take their place."""
    seen = placed.join(over, "leaf")
    sample = seen.where(F.pmod(F.xxhash64("fp", "leaf"), F.greatest(F.lit(1), F.floor(F.col("n") / MEMBERS))) == 0)

    def fit(table: pa.Table) -> pa.Table:
        fps, home = np.asarray(table.column("fp")).view(np.uint64), np.asarray(table.column("home"))
        first = {c: table.column(c)[0].as_py() for c in ("leaf", "n", "homes", "kind")}
        how = _refit(first["n"], first["homes"], first["kind"], fps, home, radius, leaf, most)
        return pa.table([pa.array([x]) for x in (first["leaf"], *how)], ["leaf", "how", "size", "tree"])

    trees = sample.groupBy("leaf").applyInArrow(fit, "leaf long, how long, size long, tree binary").checkpoint()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = np.asarray(batch.column("leaf"))
            for at in _runs(leaves):
                part = batch.slice(at.start, at.stop - at.start)
                how, size, tree = (part.column(c)[0].as_py() for c in ("how", "size", "tree"))
                fps, home, of = np.asarray(part.column("fp")).view(np.uint64), np.asarray(part.column("home")), _U(leaves[at.start].astype(np.uint64))
                if how is None:  # no sample: it stays as it is
                    yield _placed(leaves[at], np.full(len(fps), TILE), fps, home)
                    continue
                if how == TILE:
                    mine = _scrambled(fps) % _U(size)
                    for other in range(size):
                        low, high = np.minimum(mine, _U(other)), np.maximum(mine, _U(other))
                        yield _placed(_scrambled(of + _scrambled(low * _U(size) + high + _U(1))).view(np.int64), np.full(len(fps), TILE), fps, home)
                    continue
                t = Tree.of(MASKS[how], size, tree)
                index, node, inner = t.leaves(fps, radius if how == WHOLE else radius // len(HALVES))
                yield _placed(_scrambled(of + _scrambled(node.astype(np.uint64) + _U(how << 32))).view(np.int64), np.full(len(index), how), fps[index], home[index] & inner)

    named = trees.select(F.col("leaf"), "how", "size", "tree")
    return seen.select("leaf", "fp", "home").join(named, "leaf", "left").mapInArrow(place, _PLACED)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _runs(x: np.ndarray) -> Iterator[slice]:
    """Runs of equal values, of at most 4096."""
    if len(x):
        edges = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
        for a, b in zip(edges, edges[1:], strict=False):
            for i in range(a, b, 4096):
                yield slice(i, min(b, i + 4096))


def leaves(distinct: DataFrame, radius: int = 3, leaf: int = LEAF, most: int = MOST) -> DataFrame:
    """leaf, kind, fp, home: every distinct fingerprint in its home and in the leaves it visits, none of them over-full."""
    n = distinct.count()
    size, depth = _fitted(n, leaf)
    sample = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // size))) == 0).select("fp").toArrow()  # 8 bytes each, about SAMPLE of them at most
    points = sample.column("fp").to_numpy().view(np.uint64)
    trees = [Tree(points, mask, depth) for mask in HALVES]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.asarray(batch.column("fp")).view(np.uint64)
            for i in range(0, len(every), 4096):
                fps = every[i : i + 4096]
                for k, tree in enumerate(trees):
                    index, node, home = tree.leaves(fps, radius // len(trees))
                    yield _placed(node * 2 + k, np.full(len(index), k), fps[index], home)

    placed, done = distinct.select("fp").mapInArrow(place, _PLACED), []
    while True:
        placed = placed.checkpoint()
        sizes = placed.groupBy("leaf", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("homes"))
        over = sizes.where((F.col("n") > most) & (F.col("kind") < TILE)).select("leaf", "n", "homes").checkpoint()
        if not (n_over := over.count()):
            done.append(placed)
            break
        over = F.broadcast(over) if n_over < 1 << 16 else over  # 24 bytes each
        done.append(placed.join(over, "leaf", "left_anti"))
        placed = _split(placed, over.where("homes > 0"), radius, leaf, most)  # without homes there is nothing to compare
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def links(distinct: DataFrame, radius: int = 3, leaf: int = LEAF, most: int = MOST) -> DataFrame:
    """(a, b): links that span the components of the column ``fp`` of distinct fingerprints."""

    def link(table: pa.Table) -> pa.Table:
        fps, home = np.asarray(table.column("fp")).view(np.uint64), np.asarray(table.column("home"))
        pairs = np.array(list(_forest(fps, home, radius)), np.uint64).reshape(-1, 2)
        a, b = (np.ascontiguousarray(x).view(np.int64) for x in (pairs[:, 0], pairs[:, 1]))
        return pa.table([pa.array(a), pa.array(b)], ["a", "b"])

    return leaves(distinct, radius, leaf, most).groupBy("leaf").applyInArrow(link, "a long, b long")


def _labelled(fps: DataFrame, least: Column, radius: int) -> DataFrame:
    """(fp, least, label) of every distinct fingerprint: label is the same within a component."""
    distinct = fps.groupBy("fp").agg(least.alias("least")).checkpoint()
    labels = components.connected(links(distinct, radius))
    return distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable)."""
    components.shared_folder(docs.sparkSession)
    fps = fingerprints(docs).checkpoint()
    of = _labelled(fps, F.min("doc_id"), radius)
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    table = of.join(least, "label").select("fp", "component_id")
    return fps.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row of each component, with all its columns: of the smallest doc_id, then of the smallest key.

    Rows are told apart by two 64-bit hashes of doc_id and text, so neither null
    nor repeated ids join components or split them.  Of rows that are equal in
    both, each partition sends one on (the limit that Spark puts before the
    exchange), however many there are.
    """
    components.shared_folder(docs.sparkSession)
    rows = tables.named(docs, "doc_id", "text")
    keys = {f"key{i}": F.xxhash64(F.lit(i), F.col("doc_id").cast("long"), F.col("doc_id").isNull(), "text") for i in (1, 2)}
    fps = fingerprints(rows, keys).checkpoint()
    of = _labelled(fps, F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *keys)), radius)
    kept = of.groupBy("label").agg(F.min("least").alias("least")).select(*(F.col(f"least.{k}").alias(k) for k in keys))
    rest = F.xxhash64(F.lit(0), *(F.col(c) for c in tables.others(rows) if "map" not in rows.schema[c].dataType.simpleString()))  # maps have no hash
    marked = rows.select("*", rest.alias("rest"), *(c.alias(k) for k, c in keys.items())).join(kept, list(keys), "left_semi")
    one = marked.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy("rest"))).where("copy = 1")
    return one.select(rows.columns).toDF(*docs.columns)
