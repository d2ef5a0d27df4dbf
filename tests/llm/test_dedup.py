"""Operators 1, 6, 10 and 7 against brute force on a small corpus."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from pagemill.llm import bloom, components, fingerprints, line_dedup, rank_pairs, simhash_dedup, suffix_dedup
from tests.llm.common import corpus, documents

LAST = 1 << 63


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def brute_removed(rows, length=50):
    first = {}
    data = [(LAST if i is None else i, (t or "").encode(), i) for i, t in rows]
    for i, b, _ in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b, doc in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [2000, 1 << 20])
def test_substrings(spark, block_bytes):
    rows = corpus()
    got = suffix_dedup.dedup_substrings(documents(spark, rows), block_bytes=block_bytes).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_removed(rows)
    for r in got:
        assert sha(bytes(r.kept_text)) == r.kept_sha256
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_substrings_refuse_short_lengths(spark):
    with pytest.raises(ValueError):
        suffix_dedup.dedup_substrings(documents(spark, []), length=20)


def brute_lines(rows, least):
    key = lambda line: line.strip(b" \t\n\x0b\x0c\r").lower()
    n = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        n.update({key(x) for x in b.split(b"\n")})
    out = []
    for i, b in texts:
        lines = b.split(b"\n")
        kept = [x for x in lines if not (key(x) and n[key(x)] >= least)]
        out.append((i, len(lines), len(lines) - len(kept), sha(b"\n".join(kept))))
    return Counter(out)


@pytest.mark.parametrize(("least", "sent"), [(2, 1 << 20), (10, 1 << 20), (2, 0), (1, 0)])
def test_lines(spark, least, sent):
    rows = corpus()
    got = line_dedup.dedup_lines(documents(spark, rows), min_docs=least, sent=sent).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute_lines(rows, least)


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_first_lines_stay(spark, sent):
    rows = [(3, "a\nB\na"), (1, "b\nc"), (2, "c \nd"), (None, "D\n\n")]
    got = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(documents(spark, rows), min_docs=2, mode="first", sent=sent).collect()}
    assert got == {3: "a\na", 1: "b\nc", 2: "d", None: "\n"}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(documents(spark, rows), mode="other")


def test_rewritten_keeps_other_columns(spark):
    df = documents(spark, [(1, "a\nb"), (2, "a"), (3, None)])
    got = line_dedup.rewritten(df, min_docs=2)
    assert got.columns == df.columns
    assert {(r.doc_id, r.text, r.n_chars, r.bucket) for r in got.collect()} == {(1, "b", 1, "b"), (2, "", 0, "b"), (3, None, None, "b")}


def test_bloom_has_no_false_negatives():
    x = np.random.RandomState(1).randint(0, 1 << 63, 9000, dtype=np.uint64)
    one, other = bloom.Seen(17), bloom.Seen(17)
    one.add(x[:5000])
    other.add(x[4000:])
    one.add(x[:100])
    f = bloom.Filter(17, one.once | other.once)
    assert f.has(x).all()
    assert f.has(x + np.uint64(1)).mean() < 0.1
    twice = bloom.Filter(17, one.twice | other.twice | (one.once & other.once))
    assert twice.has(np.concatenate([x[:100], x[4000:5000]])).all()
    assert twice.has(x[5000:]).mean() < 0.1


def test_blooms_of_many_tasks(spark):
    x = np.random.RandomState(2).randint(0, 1 << 62, 3000).tolist()
    df = spark.createDataFrame([(v,) for v in x + x[:500]], "h long").repartition(7)
    hashes = lambda b: iter([np.asarray(b.column("h")).view(np.uint64)])
    every = np.array(x, np.uint64)
    assert bloom.built(df, hashes, 16).has(every).all()
    twice = bloom.built(df, hashes, 16, again=True)
    assert twice.has(every[:500]).all()
    assert twice.has(every[500:]).mean() < 0.1
    assert not bloom.built(df.limit(0), hashes, 16).has(every).any()
    assert bloom.bits_for(1 << 50) == bloom.MOST


def brute_fp(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark):
    rows = corpus()
    fps = [brute_fp(t) for _, t in rows]
    group = brute_components(fps)
    ids = [LAST if i is None else i for i, _ in rows]
    least = [min(i for i, g in zip(ids, group, strict=True) if g == mine) for mine in group]
    want = Counter((i, f"{f:016x}", None if c == LAST else c) for (i, _), f, c in zip(rows, fps, least, strict=True))
    got = simhash_dedup.near_duplicates(documents(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == want


@pytest.mark.parametrize("leaf", [8, 64])
def test_vantage_point_links(spark, leaf):
    """Chains and dense groups of fingerprints, in few and in many leaves."""
    r = np.random.RandomState(3)
    centres = r.randint(0, 1 << 62, 60, dtype=np.int64)
    points = set(centres.tolist())
    for c in centres[:20].tolist():
        x = c
        for _ in range(12):  # a walk: its ends are far apart but linked
            for b in r.choice(62, r.randint(1, 4), replace=False):
                x ^= 1 << int(b)
            points.add(x)
    points = sorted(points)
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    got = components.connected(simhash_dedup.links(df, 3, leaf)).collect()
    label = {p: p for p in points} | {x.node: x.label for x in got}
    group = brute_components(points)
    assert {p: points[g] for p, g in zip(points, group, strict=True)} == label


def flipped(r, x, most, bits):
    for b in r.choice(bits, r.randint(1, most + 1), replace=False):
        x ^= 1 << int(b)
    return x


def hard_points(kind):
    """Fingerprints that a tree tells apart badly: one half in common, a dense ball, or far apart beside a ball."""
    r = np.random.RandomState(6)
    if kind == "one half":
        return {int(x) << 32 | 12345 for x in r.randint(0, 1 << 30, 900)} | {flipped(r, 77 << 40 | 12345, 3, range(32, 62)) for _ in range(100)}
    if kind == "ball":
        return {flipped(r, 0, 5, 62) for _ in range(1200)}
    x = r.randint(0, 1 << 62, 1500, dtype=np.int64)
    return {*x.tolist(), *(x[:200] ^ 5).tolist(), *(flipped(r, 1 << 50, 4, 62) for _ in range(300))}


@pytest.mark.parametrize("kind", ["one half", "ball", "far apart"])
def test_leaves_stay_small(spark, monkeypatch, kind):
    """However badly the first trees fit, no leaf is over-full, and no link is lost."""
    monkeypatch.setattr(simhash_dedup, "_fitted", lambda n, leaf: (64, 2))
    monkeypatch.setattr(simhash_dedup, "MEMBERS", 100)
    components.shared_folder(spark)
    points, most = sorted(hard_points(kind)), 120
    df = spark.createDataFrame([(p,) for p in points], "fp long").checkpoint()
    sizes = simhash_dedup.leaves(df, 3, 24, most).groupBy("leaf").count().collect()
    assert max(r["count"] for r in sizes) <= 1.6 * most
    got = components.connected(simhash_dedup.links(df, 3, 24, most)).collect()
    label = {p: p for p in points} | {x.node: x.label for x in got}
    assert {p: points[g] for p, g in zip(points, brute_components(points), strict=True)} == label


def test_the_sample_of_the_first_trees_is_bounded():
    for n in (1 << 10, 1 << 20, 1 << 40):
        assert simhash_dedup._fitted(n, 1024)[0] <= simhash_dedup.SAMPLE


def test_fingerprints_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one TWO"), (6, " a\x0bb\x0cc\rd  "), (7, "ÀÉ é\u00a0x y z"), (8, "w " * 30000), (9, "tab\tÉ " * 7), (None, "q")]
    got = simhash_dedup.fingerprints(documents(spark, rows)).collect()
    assert {(r.doc_id, r.fp & (1 << 64) - 1) for r in got} == {(i, brute_fp(t)) for i, t in rows}


def test_components_of_a_path_and_a_star(spark):
    components.shared_folder(spark)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(500, 500)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(300)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_votes(text):
    v, total = [0] * 64, 0
    for w in re.split(r"[\W_]+", text.lower()):
        k = 0 if not w else 1 if len(w) <= 3 else min(len(w), 12)
        h = xxhash.xxh64_intdigest(w.encode(), seed=42)
        total += k
        v = [x + k * (h >> b & 1) for b, x in enumerate(v)]
    return sum(1 << b for b in range(64) if 2 * v[b] > total)


def test_fingerprints(spark):
    rows = [(i, t) for i, t in corpus() if i is not None and i != 70] + [(None, "last one"), (1 << 40, "far away words")]
    order = sorted(rows, key=lambda r: -(LAST if r[0] is None else r[0]))
    fps = {i: brute_votes(t or "") for i, t in rows}
    want = set()
    for k, (i, t) in enumerate(order):
        j, u = order[(k + 1) % len(order)]
        t, u = t or "", u or ""
        n = len(t)
        e = t[: n - n // 2] + u[: n // 2]
        f = brute_votes(e)
        near = sum((fps[i] ^ x).bit_count() <= 3 for x in fps.values()) - 1 if i is not None and i % 20 == 0 else None
        want.add((i, n, sha(e.encode()), f"{fps[i]:016x}", f"{f:016x}", 1 - (fps[i] ^ f).bit_count() / 64, 1 - (fps[i] ^ fps[j]).bit_count() / 64, near))
    assert {tuple(r) for r in fingerprints.compare(documents(spark, rows)).collect()} == want


def test_fingerprints_of_ties_and_of_a_single_row(spark):
    got = fingerprints.compare(documents(spark, [(1, "ab cd"), (1, "ab cd"), (1, "xyz")])).collect()
    assert len(got) == 3
    assert len({r.fingerprint for r in got}) == 2
    one = fingerprints.compare(documents(spark, [(7, "abcd")])).first()
    assert (one.edited_sha256, one.near_next) == (sha(b"abab"), 1.0)


def test_neighbours_within_the_radius(spark):
    r = np.random.RandomState(5)
    base = r.randint(0, 1 << 62, 30, dtype=np.int64).tolist()
    points = sorted({x ^ sum(1 << int(b) for b in r.choice(62, k, replace=False)) for x in base for k in range(6)})
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    for radius in (1, 3):
        got = fingerprints.neighbours(df, df, radius).collect()
        want = {(a, b, (a ^ b).bit_count()) for a in points for b in points if (a ^ b).bit_count() <= radius}
        assert len(got) == len(want)
        assert {tuple(x) for x in got} == want


def test_empty_tables(spark):
    none = documents(spark, [])
    assert suffix_dedup.dedup_substrings(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert fingerprints.compare(none).count() == 0


def test_rank_pairs(spark):
    rows = corpus()
    got = rank_pairs.dedup_by_ranks(documents(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == brute_removed(rows)
    short = [(3, "abcdefgh12"), (1, "xabcdefgh1"), (2, None), (None, "abcdefgh12"), (3, "abcdefgh12")]
    assert Counter(tuple(r) for r in rank_pairs.dedup_by_ranks(documents(spark, short), 9).collect()) == brute_removed(short, 9)
    assert rank_pairs.dedup_by_ranks(documents(spark, [])).count() == 0
