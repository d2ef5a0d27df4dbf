"""The native functions against their plain twins, the views, streams, and the entry points."""

from __future__ import annotations

import importlib

import pytest
from pyspark.sql import functions as F

from pagemill import sources, streaming
from pagemill.functions import columns as C
from pagemill.functions import text as X
from pagemill.operators import convert, tokens
from pagemill.operators.writer import convert as plain_convert
from pagemill.options import Options

TEXTS = ["", " ", "a  b\t\nc", "1. x\n 12.\ty\n3.z", "+ a\n - b\n--c\n-d", "\\* \\a [x](y) `c` _d_ {e} #!", "line\u0085 1. no", "a | b", "    code", "\ttab", "-- x", "--- x", "* item", "**bold", "> q", "see [l](u) now", "10. item", "é-ü a-b -c d-", "x y", "‎m‏", "&copy; &AMP;&eacute; &#8217;&#x93; &#0; &nosuch; &amp &; &#99999999999;"]
LINKS = ["", "#f", "?q=1", "//o/x", "http://z/y", "/a/../b/./c/", "../up/f.txt?x=1#y", "mailto:a", "e", "a//b", ".."]
BASES = ["", "http://h", "http://h/", "http://u:p@h:80/d/e?q=2#f", "//h/d/", "http://[::1]:8/p", "://bad"]
STYLES = ["", "a:b", "Color: RED; color : blue;x", "margin-left: 72px", "margin-left:-5pt;height:0", "font-family: Courier New", "font-style:italic;font-weight:bold;text-decoration:line-through", "list-style-type: square", "margin-left: 3em", ";;:v"]


def column(spark, rows, expression, name="c"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_text_functions(spark):
    pairs = [
        (lambda: C.escape("c"), X.escape), (lambda: C.escape("c", True), lambda s: X.escape(s, True)), (lambda: C.escape_link("c"), X.escape_link),
        (lambda: C.keeps_line("c"), lambda s: X.keeps_line(s, True, False, False)), (lambda: C.keeps_line("c", False, True, True), lambda s: X.keeps_line(s, False, True, True)),
        (lambda: C.trimmed("c"), lambda s: s.strip(X._PHP_TRIM)),
    ]
    for native, plain in pairs:
        assert column(spark, TEXTS, native()) == [plain(t) for t in TEXTS]
    assert column(spark, ["é-ü a-b -c d-", "1-2-3", "--"], C.hyphen_breaks("c")) == [2, 2, 0]


def test_entities(spark):
    from pagemill.operators import html_tree

    def decoded(s, snob):
        return "".join(X.entity(p, snob) if e else p for p, e in ((m, html_tree.ENTITY.fullmatch(m) is not None) for m in html_tree.re.split(f"({C.ENTITY})", s))).replace(X.NBSP, " ")

    for snob in (False, True):
        assert column(spark, TEXTS, C.decode_entities("c", snob)) == [decoded(t, snob) for t in TEXTS]


def test_addresses(spark):
    def joined(b, u):
        try:
            return X.join_url(b, u)
        except ValueError:
            return None

    rows = [(b, u) for b in BASES for u in LINKS]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b string, u string")
    got = [r[0] for r in df.orderBy("i").select(C.join_url("b", "u")).collect()]
    assert got == [joined(*r) for r in rows]
    assert column(spark, LINKS, C.normal_path("c")) == [X.normal_path(u) for u in LINKS]


def test_styles(spark):
    assert column(spark, STYLES, C.properties("c")) == [X.properties(s) for s in STYLES]
    for native, plain in ((C.list_kind, X.list_kind), (C.fixed_width, X.fixed_width), (C.emphasis_of, X.emphasis_of), (C.has_height, lambda s: "height" in s), (C.nesting, lambda s: X.nesting(s, 36))):
        assert column(spark, STYLES, native(C.properties("c"))) == [plain(X.properties(s)) for s in STYLES]
    css = ["@import url(x); p{a:b} .c , d {E: F;a:1}", "", "p{a:b}p{a:c}", "p{", "@import x"]
    assert column(spark, css, C.rules("c")) == [X.rules(s) for s in css]
    starts = ["3", " -2 ", "x", "", "1.5"]
    assert column(spark, starts, C.list_start("c")) == [X.list_start({"start": s}) for s in starts]
    tags = ["h1", "h9", "h0", "h10", "div", ""]
    assert column(spark, tags, C.heading_level("c")) == [X.heading_level(t) for t in tags]


def test_tables(spark):
    tables = [["a| b", "---|---", "long cell| c | more"], ["x"], []]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "i int, ls array<string>")
    assert [list(r[0]) for r in df.orderBy("i").select(C.align_table(F.col("ls"))).collect()] == [X.align_table(t) for t in tables]
    text = f"a\n{X.TABLE_MARK}\nb|c\n{X.TABLE_MARK}\nd\n{X.TABLE_MARK}\nopen|end"
    assert column(spark, [text], convert.align_tables("c")) == ["a\n| b |c |\n\nd\n| open |end |"]


HTML = "<head><title>t</title><style>p {Color: Red}</style></head><body><h1>A<b>b</b></h1><a href='/x' title=\"T\">l</a><a>n</a><a href=/y>m</a><a href='/x' title='T'>again</a><script>'</p><a href=q>'</script><!-- <li> --><ol><li>1<ul><li>2</ul><li>3</ol><img src=i.png alt=''><table><tr><td>c1<td>c2</tr><tr><th>c3</table>"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "http://h/d/", HTML), (2, None, None), (3, "http://h/", "")], "page_id long, url string, html string").repartition(2)


def test_views(spark, pages):
    assert {(r.href, r.title, r.resolved) for r in tokens.links(pages).collect()} == {("/x", "T", "http://h/x"), ("/y", None, "http://h/y")}
    assert {(r.href, r.n, r.ref_no) for r in tokens.reference_numbers(pages).collect()} == {("/x", 2, 1), ("/y", 1, 2)}
    assert [(r.level, r.text) for r in tokens.headings(pages).collect()] == [(1, "Ab")]
    assert {(r.li_idx, r.list_no, r.list_kind, r.number, r.level) for r in tokens.list_items(pages).collect()} == {(1, 1, "ol", 1, 1), (2, 2, "ul", 1, 2), (3, 1, "ol", 2, 1)}
    assert {(r.table_no, r.row_no, r.col_no, r.text) for r in tokens.table_cells(pages).collect()} == {(1, 1, 1, "c1"), (1, 1, 2, "c2"), (1, 2, 1, "c3")}
    assert [(r.src, r.alt) for r in tokens.images(pages).collect()] == [("i.png", "")]
    assert [tuple(r)[1:] for r in tokens.styles(pages).collect()] == [("p", "color", "red")]
    assert {r.tag: r.n for r in tokens.tag_histogram(pages).collect()}["a"] == 4
    assert {(r.page_id, r.text) for r in tokens.visible_text(pages).collect()} == {(1, "Ablnmagain123c1c2c3"), (2, ""), (3, "")}


def made(spark, html):
    return spark.createDataFrame([(1, None, html)], "page_id long, url string, html string")


def test_views_of_nested_elements(spark):
    lists = made(spark, "</ul><li>o<ol start=3><li>a<ul><li>b<ol start='x'><li>c</ol><li>d</ul><li>e</ol></ol><ul><li>f")
    got = {(r.li_idx, r.list_no, r.list_kind, r.number, r.level) for r in tokens.list_items(lists).collect()}
    assert got == {(1, 0, "ul", 1, 0), (2, 1, "ol", 3, 1), (3, 2, "ul", 1, 2), (4, 3, "ol", 1, 3), (5, 2, "ul", 2, 2), (6, 1, "ol", 4, 1), (7, 4, "ul", 1, 1)}
    tables = made(spark, "<tr><table><tr><td>a<table><tr><th>x<th>y</tr></table>b<td>c</tr><tr><td>d</table></table><table><tr><td>e</table>")
    assert {(r.table_no, r.row_no, r.col_no, r.text) for r in tokens.table_cells(tables).collect()} == {(1, 1, 1, "ab"), (1, 1, 2, "c"), (1, 2, 1, "d"), (2, 1, 1, "x"), (2, 1, 2, "y"), (3, 1, 1, "e")}
    assert {(r.table_no, r.row_no, r.n_cells, r.explicit) for r in tokens.table_rows(tables).collect()} == {(1, 1, 2, True), (1, 2, 1, False), (2, 1, 2, True), (3, 1, 1, False)}
    links = made(spark, "</a><a href=/x>1<a href=/y>2</a></a><a href=/z><a>n</a><a href=/w>")
    assert {(r.href, r.ref_no) for r in tokens.reference_numbers(links).collect()} == {("/y", 1), ("/x", 2), ("/w", 3), ("/z", 4)}
    quiet = made(spark, "</head>a<head>h<body>b</head>c<head>i</body>d")
    assert [r.text for r in tokens.visible_text(quiet).collect()] == ["abcd"]


def test_views_of_spans_definitions_and_code(spark):
    page = made(spark, "x<b>1<i>2</i>3</b><s>4</s></u>y<em>5<dl><dt>t <b>u</b><dd>d</dd>out<dt></dl><pre>p<code>q</code>\n</pre><pre>r")
    assert {(r.span_no, r.kind, r.depth, r.text) for r in tokens.spans(page).collect()} == {(1, "strong", 1, "13"), (2, "emphasis", 2, "2"), (3, "struck", 1, "4"), (4, "emphasis", 1, "5t doutpq\nr"), (5, "strong", 2, "u")}
    assert {(r.list_no, r.item_no, r.kind, r.text) for r in tokens.definitions(page).collect()} == {(1, 1, "term", "t u"), (1, 2, "definition", "d"), (1, 3, "term", "")}
    assert {(r.block_no, r.text) for r in tokens.code_blocks(page).collect()} == {(1, "pq\n"), (2, "r")}


def test_lines_of_texts(spark):
    texts = ["a\n\nb", "c", None, "", "\n", "\n\n\n", "\n\na\n\n\n\nb\n\n\n", "a\n \n\nb\n"]

    def brute(t):
        ls = t.split("\n")
        return "\n".join(x for i, x in enumerate(ls) if x or i == 0 or ls[i - 1])

    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")  # one key for all
    got = sorted((r.text for r in tokens.few_blank_lines(df).collect()), key=str)
    assert got == sorted((None if t is None else brute(t) for t in texts), key=str)
    fences = spark.createDataFrame([(1, "```\na\n ```\nb"), (1, "c"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.pos, r.line, r.fenced) for r in tokens.fenced_lines(fences).collect()))
    assert got == [(0, 0, "", False), (1, 0, "```", True), (1, 0, "c", False), (1, 1, "a", True), (1, 2, " ```", False), (1, 3, "b", False)]


def test_wrap_with_breaks_and_cuts(spark):
    assert column(spark, ["aaaa bb cccccc", None], convert.wrap("c", 4, "<br>")) == ["aaaa<br>bb<br>cccccc", None]
    assert column(spark, ["aaaaaa bb cccccccccc"], convert.wrap("c", 4, cut=True)) == ["aaaa\naa\nbb\ncccc\ncccc\ncc"]
    assert X.graphemes("\U0001f1e9\U0001f1eae\u0301\u1100\u1161") == ["\U0001f1e9\U0001f1ea", "\u00e9", "\uac00"]


def test_conversion_of_columns(spark, pages):
    want = {1: plain_convert(HTML), 2: None, 3: ""}
    for n in (1, 3):
        got = convert.convert(pages.repartition(n)).collect()
        assert {r.page_id: r.markdown for r in got} == want
    bad = Options(base_url="://bad base")
    got = {r.page_id: r.r for r in pages.select("page_id", convert.try_to_markdown("html", bad).alias("r")).collect()}
    assert got[1].markdown is None
    assert "invalid base" in got[1].error
    assert (got[3].markdown, got[3].error) == ("", None)
    per_row = pages.withColumn("o", F.create_map(F.lit("bodyWidth"), F.lit("0"), F.lit("strongMark"), F.lit("__")))
    got = {r.page_id: r.m for r in per_row.select("page_id", convert.to_markdown_with("html", "o").alias("m")).collect()}
    assert got[1] == plain_convert(HTML, Options(body_width=0, strong_mark="__"))


def test_events(spark, pages):
    rows = convert.events(pages).where("page_id = 1").orderBy("pos").collect()
    assert (rows[0].tag, rows[0].depth, rows[-1].kind) == ("html", 0, "end")
    assert any(r.kind == "start" and r.attrs == {"href": "/x", "title": "T"} for r in rows)


def test_streams_give_what_batches_give(spark, pages, tmp_path):
    pages.withColumn("ts", F.current_timestamp()).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    for name, time in (("plain", None), ("once", "ts")):
        converted = streaming.convert_stream(source, time=time).select("page_id", "markdown")
        streaming.write_stream(converted, f"{tmp_path}/{name}", f"{tmp_path}/{name}-log").awaitTermination()
        got = {r.page_id: r.markdown for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}
        assert got == {1: plain_convert(HTML), 2: None, 3: ""}


def test_sources(spark, pages, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.html").write_text("<p>a\n<p>b")
    found = sources.read_html_files(spark, f"{tmp_path}/h").collect()
    assert [(r.html, r.url.endswith("a.html")) for r in found] == [("<p>a\n<p>b", True)]
    pages.write.json(f"{tmp_path}/j")
    back = sources.read_pages(spark, f"{tmp_path}/j", "json")
    assert back.count() == 3
    sources.write_markdown(convert.convert(back), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").columns == ["page_id", "url", "html", "markdown"]


def test_entry(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).columns == ["page_id", "markdown"]
    assert set(e.oracle_sql()) <= set(e.queries())
