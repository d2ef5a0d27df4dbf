"""Edges of the training-data operators: clashing names, repeated and null ids, faults, and plain versions of the models."""

from __future__ import annotations

import gzip
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, fingerprints, labelled, line_dedup, quality, secrets, sentencepieces, simhash_dedup, suffix_dedup, tables, toxicity, warc
from tests.llm.common import corpus, documents, words
from tests.llm.test_texts import clean_text, junk_text, labelled_rows, toxic_text

NAMES = ["n_lines", "was_null", "kept_text", "kept_sha256", "n_dropped", "a.b", "text was null", "row", "k1", "block", "fp", "TEXT", "other0", "gone", "places", "copy"]


def odd(spark, rows):
    """Documents with columns whose names clash with those that operators use."""
    df = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES)), F.array(F.lit(1)).alias("list"))


def kept(df):
    return Counter((r[0], r[1], *r[5:21]) for r in df.collect())


def test_columns_by_place(spark):
    df = odd(spark, [(1, "a")])
    assert tables.named(df, "doc_id", "text").columns[:3] == ["doc_id", "text", "other2"]
    with pytest.raises(ValueError, match="no column"):
        tables.named(df, "nope")


def test_operators_take_columns_of_any_name(spark):
    rows = [(1, "one line\nshared"), (2, "two words here\nshared"), (None, None), (None, "one line\nshared"), (3, ""), (3, "x y z")]
    df = odd(spark, rows)
    rest = tuple(range(len(NAMES)))
    bench = spark.createDataFrame([(1, "two words here", 5)], "item_id long, text string, `text.x` int")
    labels = spark.createDataFrame([(1, 1, 0, 9)], "doc_id long, quality int, toxic int, `a.b` int")
    same = Counter((i, t, *rest) for i, t in rows)
    out = line_dedup.rewritten(df, min_docs=3)
    assert out.columns == df.columns
    assert kept(out) == Counter((i, None if t is None else t.replace("\nshared", ""), *rest) for i, t in rows)
    assert kept(decontaminate.clean(df, bench)) == same - Counter([(2, rows[1][1], *rest)])
    assert kept(quality.accepted(df, quality.fit([], []))) == same
    assert kept(simhash_dedup.first_rows(df)) == Counter((i, t, *rest) for i, t in [rows[0], rows[1], rows[4], rows[5]])
    for n, got in enumerate([
        suffix_dedup.dedup_substrings(df), line_dedup.dedup_lines(df), decontaminate.decontaminate(df, bench), toxicity.score(df, labels), quality.score(df, labels), secrets.find_secrets(df),
        simhash_dedup.near_duplicates(df), fingerprints.compare(df), sentencepieces.round_trip(df, sentencepieces.Vocabulary.load()),
    ]):
        assert Counter(r.doc_id for r in got.collect()) == Counter(i for i, _ in rows), n
    pages = df.toDF("page_id", "html", "url", *df.columns[3:])
    assert Counter(r.page_id for r in warc.round_trip(pages).collect()) == Counter(i for i, _ in rows)


def test_empty_tables(spark):
    none, pages = odd(spark, []), spark.createDataFrame([], "page_id long, url string, html string")
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (line_dedup.rewritten(none), decontaminate.clean(none, bench), simhash_dedup.first_rows(none), toxicity.score(none, labels), quality.score(none, labels), secrets.find_secrets(none), warc.round_trip(pages)):
        assert df.count() == 0


def test_rows_without_ids_spread_over_blocks(spark):
    from pagemill.llm import rounds

    df = spark.createDataFrame([(None if i % 2 else 7, f"text {i}") for i in range(2000)], "doc_id long, text string")
    assert rounds.in_blocks(df, 16).select("block").distinct().count() == 16


def test_long_ranges_are_cut(spark, monkeypatch):
    """Null and repeated ids, in parts of a range and in one piece, give the same neighbours."""
    r = random.Random(3)
    rows = [(r.choice([None, None, 7, 8, 300, 511, 512, 10**6, (1 << 63) - 1, -5]), f"text {i} " + " ".join(words(i, i % 9))) for i in range(300)]
    df = documents(spark, rows)
    kept = ["doc_id", "tie", "next_id", "next_tie", "text", "edited"]
    whole = Counter(map(tuple, fingerprints.edited(df).select(kept).collect()))
    monkeypatch.setattr(fingerprints, "HOT", 10)
    cut = fingerprints.edited(df)
    assert Counter(map(tuple, cut.select(kept).collect())) == whole
    assert max(x["count"] for x in cut.groupBy("g", "sub").count().collect()) <= 12
    assert len({(i, t) for i, t, *_ in whole}) == len({(i, t) for *_, i, t, _, _ in whole}) == 300
    monkeypatch.setattr(fingerprints, "SENT", 0)
    assert Counter(map(tuple, fingerprints.edited(df).select(kept).collect())) == whole


def test_samples_do_not_depend_on_partitions(spark):
    rows = [(i % 40, f"text {i} " + clean_text(i)) for i in range(160)] + [(5, "x" * (labelled.SAMPLE_CHARS + 1))]
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = [labelled.sample(documents(spark, rows).repartition(n), lab, "quality", per_class=10) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2]
    assert Counter(got[0][1]) == {0: 10, 1: 10}
    assert not any(t.startswith(b"xxx") for t in got[0][0])


def test_very_long_texts(spark):
    long = " ".join(words(3, 60_000)) + "\n" + "y" * 50_000 + " " * 50_000 + "end"
    df = documents(spark, [(1, long), (2, long + " more"), (3, "short")])
    assert {r.doc_id: r.n_removed > 300_000 for r in suffix_dedup.dedup_substrings(df, texts=False).collect()} == {1: False, 2: True, 3: False}
    assert len({r.component_id for r in simhash_dedup.near_duplicates(df).collect()}) == 2
    assert all(r.exact for r in sentencepieces.round_trip(df, sentencepieces.Vocabulary.load()).collect())
    assert {r.n_lines for r in line_dedup.dedup_lines(df).collect()} == {1, 2}
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(df, lab).count() == quality.score(df, lab).count() == secrets.find_secrets(df).count() == 3


# -- archives


def archive(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return f"file://{tmp_path}/{name}"


def read(spark, path, **more):
    return sorted(((r.page_id, r.error and r.error.split(" ")[0], r.payload and r.payload.decode()) for r in warc.read(spark, path, **more).collect()), key=repr)


def test_faults_are_rows(spark, tmp_path):
    made = lambda i, html, n=1 << 20: [r.encode() for r in warc.records(i, "u", html, None, segment=n)]
    a, b, c = made(1, "one" * 500)[0], made(2, "two")[0], made(3, "three")[0]
    end = warc.END
    good = [(1, None, "one" * 500), (2, None, "two"), (3, None, "three")]
    plain = lambda *rs: b"".join(r + end for r in rs)
    assert read(spark, archive(tmp_path, "plain.warc", plain(a, b, c))) == good
    assert read(spark, archive(tmp_path, "one.warc.gz", gzip.compress(plain(a, b, c)))) == good
    assert read(spark, archive(tmp_path, "each.warc.gz", b"".join(gzip.compress(r + end) for r in (a, b, c)))) == good
    for bad in (re.sub(rb"Content-Length: \d+\r\n", b"", b), re.sub(rb"Content-Length: \d+", b"Content-Length: x", b), re.sub(rb"Content-Length: \d+", b"Content-Length: 9", b), re.sub(rb"Content-Length: \d+", b"Content-Length: 99999", b)):
        got = read(spark, archive(tmp_path, "bad.warc", plain(a, bad, c)))
        assert [x for x in got if x[1] is None] == [good[0], good[2]]
        assert any(x[1] for x in got)
    for bad in (b.replace(b"WARC-Record-ID", b"X-Record-ID"), b.replace(b"sha1:", b"sha1:!"), b.replace(b"two", b"tow")):
        got = read(spark, archive(tmp_path, "bad.warc", plain(a, bad, c)))
        assert [x for x in got if x[1] is None] == [good[0], good[2]]
        assert len(got) == 3
    members = [gzip.compress(r + end) for r in (a, b, c)]
    for bad in (members[0] + members[1][:-9], members[0] + members[1][:20] + members[2], members[0] + bytes(x ^ 255 for x in members[1]) + members[2]):
        got = read(spark, archive(tmp_path, "cut.warc.gz", bad))
        assert good[0] in got
        assert any(x[1] for x in got) or len(got) == 1
        assert (good[2] in got) == bad.endswith(members[2]) or len(got) == 1
    cut = made(4, "four" * 900, 500)
    got = read(spark, archive(tmp_path, "gap.warc", plain(a, *cut[:2], *cut[3:], c)))
    assert got == [good[0], good[2], (4, "segments", None)]
    assert read(spark, archive(tmp_path, "empty.warc", b"")) == []
    assert read(spark, archive(tmp_path, "junk.warc", b"nothing")) == [(None, "a", None)]


def test_our_archives_are_members_and_split(spark, tmp_path):
    rows = [(i, f"u{i % 3}", f"<p>{i % 50} " + "é" * (i % 300)) for i in range(900)] + [(5, "other", "<p>5 " + "é" * 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = f"file://{tmp_path}/own"
    warc.write(pages, path, segment=256)
    files = list((tmp_path / "own").glob("part-*"))
    records = 0
    for f in files:
        data = f.read_bytes()
        while data:
            z = zlib.decompressobj(31)
            assert z.decompress(data).startswith(b"WARC/1.1\r\n")
            assert z.eof
            data, records = z.unused_data, records + 1
    assert records > 1500
    want = Counter((i, u, h) for i, u, h in rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for own in (True, False):
            assert Counter((r.page_id, r.url, r.payload.decode()) for r in warc.read(spark, path, own=own).collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    data = bytearray(files[0].read_bytes())
    at = data.find(warc.MEMBER, len(data) // 2)
    data[at + 14] ^= 255
    got = warc.read(spark, archive(tmp_path, "damaged.txt", bytes(data)), own=True).collect()
    assert any("member" in r.error for r in got if r.error)
    assert len(got) > 100
    with pytest.raises(ValueError, match="segment"):
        warc.write(pages, f"{path}2", segment=1 << 30)


@pytest.mark.parametrize("sent", [0, 1000])
def test_revisits_by_either_join(spark, sent):
    rows = [(i, f"u{i}", "same" * 400) for i in (4, 9, 7)] + [(9, "twin", "same" * 400), (None, "n", "same" * 400), (1, "s", "short")]
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), sent=sent).collect())
    assert got == Counter([(4, "revisit", 9, 1600), (7, "revisit", 9, 1600), (9, "response", None, 1600), (9, "response", None, 1600), (None, "revisit", 9, 1600), (1, "response", None, 5)])


# -- models against plain versions


def plain_toxicity(model, text):
    """The score by one compression after the other."""
    g = model.gains
    parameters = zstandard.ZstdCompressionParameters(**toxicity._PARAMETERS)
    size = lambda content, window: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters).compress(window))
    w = text.lower().split()
    found = [f" {' '.join(w[i : i + toxicity.WINDOW])} ".encode() for i in range(0, len(w), toxicity.WINDOW)] or [b""]
    gains = [size(g.contents[0], x) - size(g.contents[0] + g.contents[1], x) for x in found]
    n = len(gains)
    over, under = [sum(x >= k for x in gains) for k in range(1, 12)], [sum(x <= -k for x in gains) for k in range(1, 12)]
    top = sorted(gains, reverse=True)[:4]
    top += [min(gains)] * (4 - len(top))
    mean = sum(gains) / n
    f = [*map(math.log1p, over), *(x / n for x in over), *map(math.log1p, under), *(x / n for x in under), *top, mean, math.sqrt(sum((x - mean) ** 2 for x in gains) / n), math.log1p(n)]
    z = sum((x - m) / s * v for x, m, s, v in zip(f, model.mean, model.scale, model.weights, strict=True)) + model.bias
    return 1 / (1 + math.exp(-z))


def test_toxicity_against_a_plain_version(spark):
    rows, labels = labelled_rows(toxic_text, clean_text, 120)
    rows += [(500, None), (501, ""), (502, "Ünï " * 40), (502, clean_text(2))]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = documents(spark, rows)
    texts, known = labelled.sample(df, lab, "toxic")
    model = toxicity.fit([t.decode() for t in texts], known, labelled.share(lab, "toxic"))
    want = sorted((i, round(plain_toxicity(model, t or ""), 6)) for i, t in rows)
    assert sorted((r.doc_id, round(r.score, 6)) for r in toxicity.score(df, lab).collect()) == want


_M = (1 << 64) - 1


def _scrambled(x):
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & _M
    return x ^ (x >> 29)


def _hash(data):
    return _scrambled(sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(data)) & _M)


def _gram(hs):
    out = hs[0]
    for h in hs[1:]:
        out = (out * 0xD6E8FEB86659FD93 + h) & _M
    return _scrambled(out)


def plain_quality(model, text):
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[\x21-\x7e]", text.encode())
    hashes = [_hash(t.lower()) for t in tokens]
    shapes = []
    for i, t in enumerate(tokens):
        if not re.match(rb"[0-9A-Za-z\x80-\xff]", t):
            code = t[0]
        else:
            up = sum(65 <= c <= 90 for c in t)
            case = 0 if not up else 2 if up == len(t) else 1 if 65 <= t[0] <= 90 else 3
            code = 256 + case * 64 + any(48 <= c <= 57 for c in t) * 32 + (i > 0 and hashes[i] == hashes[i - 1]) * 16 + min(len(t), 24) // 4
        shapes.append(_scrambled((code * 0x9E3779B97F4A7C15 + 1) & _M))
    total = n = 0
    for hs, most, salt in ((hashes, 2, 11), (shapes, 3, 23)):
        for k in range(1, most + 1):
            for i in range(len(hs) - k + 1):
                total += float(model.weights[_scrambled((_gram(hs[i : i + k]) + salt * k) & _M) & ((1 << quality.BITS) - 1)])
                n += 1
    return 1 / (1 + math.exp(-(model.bias + quality.SCALE * total / max(n, 1))))


def test_quality_against_a_plain_version():
    rows, labels = labelled_rows(junk_text, clean_text, 120)
    model = quality.fit([t.encode() for _, t in rows], [x[1] for x in labels])
    texts = [t for _, t in rows[:40]] + ["", "One ONE one 12a!! é", "x", "!?", " \n"]
    assert np.allclose(model.score([t.encode() for t in texts]), [plain_quality(model, t) for t in texts], atol=1e-5)


def test_precision_and_recall_of_added_spans():
    """Planted keys among words, paths and identifiers; a span counts if it holds at least 90 % of a key and little else."""
    r = random.Random(12)
    alphabets = [a for a in secrets.ALPHABETS if len(a) > 16]
    texts, planted = [], []
    for i in range(300):
        w = words(i, 60) + ["_".join(words(900 + i, 4)), "/".join(words(1900 + i, 5)), "-".join(words(2900 + i, 5)), f"2024-05-{i % 28 + 1:02}T10-11-12", str(10**15 + i * 7919)]
        r.shuffle(w)
        keys = ["".join(r.choices(r.choice(alphabets), k=r.randint(20, 44))) for _ in range(i % 3)]
        for k in keys:
            w.insert(r.randrange(len(w)), k)
        texts.append(" ".join(w))
        planted.append(keys)
    model = secrets.train([" ".join(words(5000 + i, 200)) for i in range(40)])
    hit = found = 0
    for t, keys in zip(texts, planted, strict=True):
        got = [t[a:b] for _, a, b in secrets.added_spans(t, secrets.base_spans(t), model)]
        found += len(got)
        hit += sum(any(g in k and len(g) >= 0.9 * len(k) for g in got) for k in keys)
    n = sum(map(len, planted))
    assert hit >= 0.95 * n
    assert hit >= 0.95 * found


# -- pipeline stages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(1, 40)))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages_keep_clean_rows_with_null_and_repeated_ids(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(None, clean_text(101)), (None, clean_text(2)), (5, clean_text(3)), (5, clean_text(4)), (None, None), (6, ""), (7, " ".join(words(1, 40))), (7, clean_text(5))]
    docs = odd(spark, rows)
    for name, stage in pipeline.STAGES:
        got = [r.doc_id for r in stage(spark, docs, folder).collect()]
        want = [i for i, _ in rows]
        if name == "benchmark_decontamination":
            want.remove(7)
        if name == "simhash_near_dedup":
            want.remove(None)  # the null text and the empty one are one group, with the smallest doc_id 6
        assert Counter(got) == Counter(want), name
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_stages_with_repeated_rows_and_ties(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "alpha beta gamma delta")] * 12 + [(2, "alpha beta gamma delta"), (3, clean_text(9))]
    stages = dict(pipeline.STAGES)
    docs = documents(spark, rows).select(pipeline.COLUMNS)
    assert Counter((r.doc_id, r.text) for r in stages["simhash_near_dedup"](spark, docs, folder).collect()) == Counter([rows[0], rows[-1]])
    assert Counter((r.doc_id, r.text, r.n_chars) for r in stages["line_dedup"](spark, docs, folder).collect()) == Counter([(1, "", 0)] * 12 + [(2, "", 0), (3, rows[-1][1], len(rows[-1][1]))])
    assert stages["quality_classifier"](spark, docs, folder).count() == stages["benchmark_decontamination"](spark, docs, folder).count() == stages["sentencepiece"](spark, docs, folder).count() == 14


def test_corpus_of_edges_through_all_stages(spark, folder, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd(spark, [*corpus(), (1, clean_text(1))])
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == pipeline.COLUMNS
    out = pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.count() == docs.count() > 20
    assert all(r.exact for r in out.collect())
