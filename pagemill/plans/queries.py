"""Queries over the test tables, one per operator, with the SQL that gives the same rows.

Inputs that the tables lack (addresses, styles, tables) are made in the query from
their columns, in the same way in the SQL.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import sources, streaming
from pagemill.functions import columns as C
from pagemill.functions import text as X
from pagemill.functions.tables import C1, stand_ins_by_code
from pagemill.operators import convert, tokens
from pagemill.options import Options
from pagemill.plans import golden

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _shared(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only in local mode, where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared')}"
    return folder


# -- pieces of SQL

_TOKEN = tokens.TOKEN.replace("'", "''")
_TOKENS = rf"""
x AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{_TOKEN}') AS ts FROM pages),
e AS (SELECT page_id, unnest(ts) AS tok, generate_subscripts(ts, 1) - 1 AS pos FROM x),
t AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, tok,
  CASE WHEN regexp_matches(tok, '(?i)^<(script|style)[\s>]') THEN 'raw' WHEN regexp_matches(tok, '^<[!?]') THEN 'skip'
       WHEN regexp_matches(tok, '^</[a-zA-Z]') THEN 'close' WHEN regexp_matches(tok, '^<[a-zA-Z]') THEN 'open' ELSE 'text' END AS kind,
  lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM e)"""
_SO_FAR = "OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _step(tag: str) -> str:
    return f"CASE WHEN tag <> '{tag}' THEN 0 WHEN kind = 'open' THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END"


def _attribute(name: str) -> str:
    pattern = rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|''[^'']*''|[^\s>]+)"
    raw = f"regexp_extract(tok, '{pattern}', 1)"
    bare = f"CASE WHEN regexp_matches({raw}, '^[\"'']') THEN substr({raw}, 2, length({raw}) - 2) ELSE {raw} END"
    return f"CASE WHEN regexp_matches(tok, '{pattern}') THEN {_decoded(bare)} END"


def _decoded(c: str) -> str:
    """The entities of the test pages."""
    out = c
    for name, text in (("amp", "&"), ("quot", '"'), ("copy", "(C)"), ("middot", "*"), ("lt", "<"), ("gt", ">")):
        out = f"replace({out}, '&{name};', '{text}')" if name != "amp" else out
    return f"replace({out}, '&amp;', '&')"


_URL = C._URL.replace("'", "''")


def _normal_path(c: str) -> str:
    parts = f"list_filter(string_split({c}, '/'), lambda s: s NOT IN ('', '.'))"
    step = "lambda acc, s: CASE WHEN s = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_append(acc, s) END"
    kept = f"CASE WHEN len({parts}) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_reduce({parts}, {step}, CAST([] AS VARCHAR[])) END"
    out = f"((CASE WHEN starts_with({c}, '/') THEN '/' ELSE '' END) || array_to_string({kept}, '/'))"
    return f"CASE WHEN ends_with({c}, '/') AND {out} <> '/' THEN {out} || '/' ELSE {out} END"


def _joined(base: str, link: str) -> str:
    part = lambda i: f"regexp_extract({base}, '{_URL}', {i})"
    scheme, site, path, query = part(1), f"regexp_replace({part(2)}, ':$', '')", part(3), part(4)
    rest = f"regexp_extract({link}, '(?s)^([^?#]*)', 1)"
    tail = f"regexp_extract({link}, '(?s)^[^?#]*(\\?[^#]*)', 1)"
    fragment = f"regexp_extract({link}, '(?s)(#.*)$', 1)"
    folder = f"coalesce(nullif(regexp_extract(CASE WHEN {path} = '' THEN '/' ELSE {path} END, '(?s)^(.*/)', 1), ''), '/')"
    whole = _normal_path(f"(CASE WHEN starts_with({rest}, '/') THEN {rest} ELSE {folder} || {rest} END)")
    front = f"(CASE WHEN {scheme} <> '' THEN {scheme} || '://' ELSE '' END) || {site}"
    return f"""CASE WHEN {link} = '' THEN {base} WHEN {base} = '' OR regexp_matches({link}, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN {link}
      WHEN {scheme} = '' AND {site} = '' THEN NULL
      WHEN starts_with({link}, '#') THEN regexp_extract({base}, '(?s)^([^#]*)', 1) || {link}
      WHEN starts_with({link}, '?') THEN {front} || (CASE WHEN {path} = '' THEN '/' ELSE {path} END) || {link}
      WHEN starts_with({link}, '//') THEN (CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END) || {link}
      ELSE {front} || ({whole}) || (CASE WHEN {tail} = '' AND {query} <> '' THEN '?' || {query} ELSE {tail} END) || {fragment} END"""


# -- tokens and views


@_query(f"WITH {_TOKENS} SELECT page_id, pos, kind, tag, length(tok) AS n_chars FROM t")
def html_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokens(_read(spark, sf_dir, "pages")).select("page_id", "pos", "kind", "tag", F.length("tok").cast("long").alias("n_chars"))


@_query(f"WITH {_TOKENS} SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM t WHERE kind IN ('open', 'raw') GROUP BY tag")
def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tag_histogram(_read(spark, sf_dir, "pages"))


@_query(f"""WITH {_TOKENS}, s AS (SELECT *, sum({_step('a')}) {_SO_FAR} AS s FROM t), m AS (SELECT *, s - least(0, min(s) {_SO_FAR}) AS d FROM s)
SELECT page_id, pos, CAST(d AS INTEGER) AS depth, CAST(length(tok) AS INTEGER) AS n_chars FROM m WHERE kind = 'text'""")
def anchor_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.anchor_depth(_read(spark, sf_dir, "pages"))


# Another rule than the view's: a text is hidden if, after the last tag of body before it, a start tag of head has had no end tag.
@_query(f"""WITH {_TOKENS}, k AS (SELECT page_id, pos, tag, kind FROM t WHERE tag IN ('head', 'body') AND kind IN ('open', 'close')),
h AS (SELECT DISTINCT x.page_id, x.pos FROM t x JOIN k o ON o.page_id = x.page_id AND o.tag = 'head' AND o.kind = 'open' AND o.pos < x.pos WHERE x.kind = 'text'
  AND NOT EXISTS (SELECT 1 FROM k c WHERE c.page_id = o.page_id AND c.pos > o.pos AND c.pos < x.pos AND (c.tag = 'body' OR c.kind = 'close'))),
v AS (SELECT page_id, string_agg(tok, '' ORDER BY pos) AS text FROM t ANTI JOIN h USING (page_id, pos) WHERE kind = 'text' GROUP BY page_id)
SELECT page_id, coalesce(text, '') AS text FROM pages LEFT JOIN v USING (page_id)""")
def quiet_filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.visible_text(_read(spark, sf_dir, "pages"))


_LINKS = f"""l AS (SELECT page_id, pos, {_attribute('href')} AS href, {_attribute('title')} AS title FROM t WHERE kind = 'open' AND tag = 'a')"""


@_query(f"WITH {_TOKENS}, {_LINKS} SELECT page_id, pos, href, title, {_joined('url', 'href')} AS resolved FROM l JOIN pages USING (page_id) WHERE href IS NOT NULL")
def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.links(_read(spark, sf_dir, "pages"))


# The end of an element is the first place after its start where fewer are open than just after the start.
_CLOSED = "(SELECT min(c.pos) FROM ev c WHERE c.page_id = o.page_id AND c.pos > o.pos AND c.cum < o.cum)"


@_query(f"""WITH {_TOKENS}, ev AS (SELECT *, sum(CASE WHEN kind = 'open' THEN 1 ELSE -1 END) {_SO_FAR} AS cum FROM t WHERE tag = 'a' AND kind IN ('open', 'close')),
o AS (SELECT page_id, pos, cum, {_attribute('href')} AS href, {_attribute('title')} AS title FROM ev WHERE kind = 'open'),
z AS (SELECT page_id, href, title, coalesce({_CLOSED}, 1000000000 - pos) AS place FROM o WHERE href IS NOT NULL),
g AS (SELECT page_id, href, title, min(place) AS place, count(*) AS n FROM z GROUP BY ALL)
SELECT page_id, href, title, n, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) AS INTEGER) AS ref_no FROM g""")
def link_reference_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.reference_numbers(_read(spark, sf_dir, "pages"))


def _by_order(spark: SparkSession, sf_dir: str, piece: Column, before: Column, after: str) -> DataFrame:
    """page_id and html: a page of each order, with a piece for each of its lines in order."""
    made = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", piece.alias("h")))).alias("hs"))
    return made.select("page_id", F.concat(before, F.array_join(F.transform("hs", lambda x: x["h"]), ""), F.lit(after)).alias("html"))


def _by_flag(a: str, n: str, r: str) -> Column:
    return F.when(F.col("l_returnflag") == "A", a).when(F.col("l_returnflag") == "N", n).otherwise(r)


_NUMBERED = "n AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS INTEGER) AS k FROM lineitem)"


# From the rows that the pages are made of, without tokens: each has up to two tags.
@_query(f"""WITH {_NUMBERED}, ev AS (SELECT l_orderkey AS page_id, k * 2 + j AS pos, CASE WHEN l_returnflag = 'R' THEN (CASE j WHEN 0 THEN -1 ELSE 0 END) WHEN l_returnflag = 'A' THEN 1 - j ELSE 0 END AS step,
  (l_returnflag = 'N' AND j = 0) OR (l_returnflag <> 'N' AND j = 1) AS item, 1 AS list_from, 'ul' AS list_kind FROM n, (SELECT unnest([0, 1]) AS j)
  UNION ALL SELECT l_orderkey, 0, 1, false, l_orderkey % 7, 'ol' FROM n GROUP BY l_orderkey),
c AS (SELECT *, sum(step) {_SO_FAR} AS cum FROM ev),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS list_no, (SELECT min(x.pos) FROM c x WHERE x.page_id = c.page_id AND x.pos > c.pos AND x.cum < c.cum) AS ends FROM c WHERE step = 1),
i AS (SELECT c.page_id, c.pos, max(o.list_no) AS list_no, count(o.list_no) AS level FROM c LEFT JOIN o ON o.page_id = c.page_id AND o.pos < c.pos AND (o.ends IS NULL OR o.ends > c.pos) WHERE c.item GROUP BY c.page_id, c.pos)
SELECT i.page_id, CAST(row_number() OVER (PARTITION BY i.page_id ORDER BY i.pos) AS INTEGER) AS li_idx, coalesce(i.list_no, 0) AS list_no, coalesce(o.list_kind, 'ul') AS list_kind,
  CAST(coalesce(o.list_from, 1) - 1 + row_number() OVER (PARTITION BY i.page_id, i.list_no ORDER BY i.pos) AS INTEGER) AS number, CAST(level AS INTEGER) AS level
FROM i LEFT JOIN o ON o.page_id = i.page_id AND o.list_no = i.list_no""")
def nested_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in lists, ends without starts, and lists that start at any number."""
    start = F.concat(F.lit("<ol start="), F.col("page_id") % 7, F.lit(">"))
    return tokens.list_items(_by_order(spark, sf_dir, _by_flag("<ul><li>a", "<li>n", "</ul><li>r"), start, "</ol>"))


@_query(f"""WITH {_NUMBERED}, ev AS (SELECT l_orderkey AS page_id, k AS pos, '/' || l_linenumber AS href, CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END AS opens, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS ends FROM n),
st AS (SELECT page_id, pos * 4 AS pos, href, 1 AS step FROM ev WHERE opens = 1 UNION ALL SELECT page_id, pos * 4 + j, NULL, -1 FROM ev, (SELECT unnest([1, 2]) AS j) WHERE j <= ends),
c AS (SELECT *, sum(step) {_SO_FAR} AS s FROM st), ev2 AS (SELECT *, s - least(0, min(s) {_SO_FAR}) AS cum FROM c),
o AS (SELECT page_id, href, coalesce((SELECT min(x.pos) FROM ev2 x WHERE x.page_id = y.page_id AND x.pos > y.pos AND x.cum < y.cum), 1000000000 - y.pos) AS place FROM ev2 y WHERE step = 1),
g AS (SELECT page_id, href, min(place) AS place, count(*) AS n FROM o GROUP BY ALL)
SELECT page_id, href, CAST(NULL AS VARCHAR) AS title, n, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) AS INTEGER) AS ref_no FROM g""")
def nested_reference_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in links, ends without starts, and links that are left open."""
    a = F.concat(F.lit("<a href='/"), F.col("l_linenumber"), F.lit("'>"))
    piece = F.when(F.col("l_returnflag") == "A", F.concat(a, F.lit("a"))).when(F.col("l_returnflag") == "N", F.concat(a, F.lit("n</a>"))).otherwise("r</a></a>")
    return tokens.reference_numbers(_by_order(spark, sf_dir, piece, F.lit(""), ""))


_LEVEL = "CASE WHEN regexp_matches(tag, '^h[1-9]$') THEN CAST(substr(tag, 2, 1) AS INTEGER) ELSE 0 END"


@_query(f"""WITH {_TOKENS}, h AS (SELECT *, {_LEVEL} AS level FROM t),
n AS (SELECT *, sum(CASE WHEN kind = 'open' AND level > 0 THEN 1 ELSE 0 END) {_SO_FAR} AS heading_no, sum(CASE WHEN kind = 'close' AND level > 0 THEN 1 ELSE 0 END) {_SO_FAR} AS closed FROM h)
SELECT page_id, CAST(heading_no AS INTEGER) AS heading_no, max(level) AS level, coalesce(string_agg(tok, '' ORDER BY pos) FILTER (WHERE kind = 'text'), '') AS text
FROM n WHERE heading_no > closed OR (kind = 'open' AND level > 0) GROUP BY page_id, heading_no""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.headings(_read(spark, sf_dir, "pages"))


@_query(f"""WITH {_TOKENS}, ev AS (SELECT *, sum(CASE WHEN tag = 'li' THEN 0 WHEN kind = 'open' THEN 1 ELSE -1 END) {_SO_FAR} AS cum FROM t WHERE tag IN ('ol', 'ul', 'li') AND kind IN ('open', 'close')),
o AS (SELECT page_id, pos, tag, cum, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS list_no FROM ev WHERE tag <> 'li' AND kind = 'open'),
z AS (SELECT *, {_CLOSED} AS ends FROM o),
i AS (SELECT l.page_id, l.pos, max(z.list_no) AS list_no, count(z.list_no) AS level FROM ev l LEFT JOIN z ON z.page_id = l.page_id AND z.pos < l.pos AND (z.ends IS NULL OR z.ends > l.pos) WHERE l.tag = 'li' AND l.kind = 'open' GROUP BY l.page_id, l.pos)
SELECT i.page_id, CAST(row_number() OVER (PARTITION BY i.page_id ORDER BY i.pos) AS INTEGER) AS li_idx, coalesce(i.list_no, 0) AS list_no, coalesce(z.tag, 'ul') AS list_kind,
  CAST(row_number() OVER (PARTITION BY i.page_id, i.list_no ORDER BY i.pos) AS INTEGER) AS number, CAST(level AS INTEGER) AS level
FROM i LEFT JOIN z ON z.page_id = i.page_id AND z.list_no = i.list_no""")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.list_items(_read(spark, sf_dir, "pages"))


@_query(f"""WITH {_TOKENS}, c AS (SELECT page_id, pos, string_split(regexp_extract(tok, '(?is)^<style[^>]*>(.*)</style', 1), '}}') AS rs FROM t WHERE kind = 'raw' AND tag = 'style'),
r AS (SELECT page_id, pos, unnest(rs) AS r FROM c), d AS (SELECT page_id, pos, trim(split_part(r, '{{', 1)) AS selector, string_split(split_part(r, '{{', 2), ';') AS ds FROM r WHERE contains(r, '{{')),
p AS (SELECT page_id, pos, selector, unnest(ds) AS d, generate_subscripts(ds, 1) AS i FROM d)
SELECT page_id, selector, lower(trim(split_part(d, ':', 1))) AS property, arg_max(lower(trim(substr(d, instr(d, ':') + 1))), i) AS value FROM p WHERE contains(d, ':') GROUP BY page_id, pos, selector, property""")
def style_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.styles(_read(spark, sf_dir, "pages"))


def _made_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.concat(F.lit("<tr><td>"), F.col("l_linenumber"), F.lit("</td><td>"), F.col("l_returnflag"), F.lit("</td><td><img src='/i/"), F.col("l_partkey"), F.lit(".png' alt='p'></td></tr>"))
    made = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", rows.alias("r")))).alias("rs"))
    return made.select("page_id", F.concat(F.lit("<table>"), F.array_join(F.transform("rs", lambda x: x["r"]), ""), F.lit("</table>")).alias("html"))


@_query(f"""WITH {_NUMBERED}, c AS (SELECT l_orderkey AS page_id, k AS row_no, unnest([CAST(l_linenumber AS VARCHAR), l_returnflag, '']) AS text, unnest([1, 2, 3]) AS col_no FROM n)
SELECT page_id, 1 AS table_no, row_no, CAST(col_no AS INTEGER) AS col_no, text, CAST(length(text) AS INTEGER) AS width FROM c""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.table_cells(_made_tables(spark, sf_dir))


@_query("""SELECT l_orderkey AS page_id, '/i/' || l_partkey || '.png' AS src, 'p' AS alt FROM lineitem""")
def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.images(_made_tables(spark, sf_dir)).drop("pos")


@_query(f"""WITH {_TOKENS}, s AS (SELECT *, sum({_step('ul')}) {_SO_FAR} AS s FROM t), m AS (SELECT *, s - least(0, min(s) {_SO_FAR}) AS d FROM s)
SELECT page_id, pos, CAST(d AS INTEGER) AS depth FROM m WHERE kind = 'text'""")
def element_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.depth(_read(spark, sf_dir, "pages"), "ul")


@_query(f"""WITH {_TOKENS}, s AS (SELECT *, sum(CASE WHEN tag IN ('b', 'li') AND kind IN ('open', 'close') THEN 1 ELSE 0 END) {_SO_FAR} AS n FROM t)
SELECT page_id, pos, n % 2 = 1 AS inside FROM s WHERE kind = 'text'""")
def parity_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.toggled(_read(spark, sf_dir, "pages"), "b", "li")


@_query(f"""WITH {_TOKENS}, m AS (SELECT *, CASE WHEN kind = 'open' THEN 1 ELSE -1 END AS step FROM t WHERE kind IN ('open', 'close')),
l AS (SELECT *, sum(step) OVER (PARTITION BY page_id, tag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv FROM m),
d AS (SELECT *, CAST(CASE WHEN kind = 'open' THEN lv ELSE lv + 1 END AS INTEGER) AS depth FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, tag, depth, kind ORDER BY pos) AS n FROM d WHERE depth > 0)
SELECT o.page_id, o.tag, o.depth, o.pos AS opened, c.pos AS closed FROM n o JOIN n c USING (page_id, tag, depth, n) WHERE o.kind = 'open' AND c.kind = 'close'""")
def tag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tag_pairs(_read(spark, sf_dir, "pages"))


_EDGE = "tag IN (" + ", ".join(f"'{t}'" for t in tokens._BLOCKS) + ") AND kind IN ('open', 'close')"


@_query(f"""WITH {_TOKENS}, b AS (SELECT *, sum(CASE WHEN {_EDGE} THEN 1 ELSE 0 END) {_SO_FAR} AS block_no FROM t),
z AS (SELECT page_id, block_no, max(CASE WHEN {_EDGE} THEN tag END) AS tag, string_agg(tok, '' ORDER BY pos) FILTER (WHERE kind = 'text') AS text FROM b GROUP BY page_id, block_no),
r AS (SELECT page_id, CAST(block_no AS INTEGER) AS block_no, tag, regexp_replace(regexp_replace(text, '^[\\x00\\t\\n\\x0b\\r ]+', ''), '[\\x00\\t\\n\\x0b\\r ]+$', '') AS text FROM z)
SELECT * FROM r WHERE text <> ''""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.paragraphs(_read(spark, sf_dir, "pages"))


@_query("""WITH n AS (SELECT CAST(p_size AS BIGINT) AS page_id, p_brand AS abbr, p_type AS title, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part)
SELECT page_id, abbr, arg_max(title, k) AS title, CAST(min(k) * 3 - 3 AS INTEGER) AS first_pos FROM n GROUP BY page_id, abbr""")
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat(F.lit("<abbr title='"), F.col("p_type"), F.lit("'>"), F.col("p_brand"), F.lit("</abbr>"))
    made = _read(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("h")))).alias("hs"))
    return tokens.abbreviations(made.select("page_id", F.array_join(F.transform("hs", lambda x: x["h"]), "").alias("html")))


@_query(f"""WITH {_NUMBERED} SELECT l_orderkey AS page_id, 1 AS table_no, k AS row_no, CAST(1 + l_linenumber % 3 AS BIGINT) AS n_cells, l_returnflag <> 'N' AS explicit FROM n""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("<tr>"), F.expr("repeat('<td>x', cast(1 + l_linenumber % 3 as int))"), F.when(F.col("l_returnflag") == "N", "").otherwise("</tr>"))
    return tokens.table_rows(_by_order(spark, sf_dir, row, F.lit("<table>"), "</table>"))


@_query(f"""WITH {_NUMBERED}, i AS (SELECT *, CAST(sum(CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY k) AS INTEGER) AS inner_no FROM n),
c AS (SELECT l_orderkey AS page_id, 1 AS table_no, k AS row_no, 1 AS col_no, CASE l_returnflag WHEN 'A' THEN 'beforeafter' ELSE l_returnflag END AS text FROM i
UNION ALL SELECT l_orderkey, 1 + inner_no, 1, 1, CAST(l_linenumber AS VARCHAR) FROM i WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, 1 + inner_no, 1, 2, '' FROM i WHERE l_returnflag = 'A')
SELECT *, CAST(length(text) AS INTEGER) AS width FROM c""")
def nested_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in cells; text after the inner table belongs to the outer cell."""
    inner = F.concat(F.lit("before<table><tr><td>"), F.col("l_linenumber"), F.lit("<th></table>after"))
    row = F.concat(F.lit("<tr><td>"), F.when(F.col("l_returnflag") == "A", inner).otherwise(F.col("l_returnflag")))
    return tokens.table_cells(_by_order(spark, sf_dir, row, F.lit("<table>"), "</table>"))


def _by_part(spark: SparkSession, sf_dir: str, html: Column) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))


@_query("""SELECT p_partkey AS page_id, s.span_no, s.kind, s.depth, CASE s.span_no WHEN 1 THEN p_brand || 'tail' WHEN 2 THEN p_type WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE 'open' END AS text
FROM part, (VALUES (1, 'strong', 1), (2, 'emphasis', 2), (3, 'struck', 1), (4, 'emphasis', 1)) s(span_no, kind, depth)""")
def inline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("</i>x<b>"), F.col("p_brand"), F.lit("<EM class=y>"), F.col("p_type"), F.lit("</em>tail</b>y<strike>"), F.col("p_size"), F.lit("</strike><u>open"))
    return tokens.spans(_by_part(spark, sf_dir, html))


@_query("""SELECT p_partkey AS page_id, 1 AS list_no, s.item_no, s.kind, CASE s.item_no WHEN 1 THEN p_brand WHEN 2 THEN p_type || 'b' ELSE CAST(p_size AS VARCHAR) END AS text
FROM part, (VALUES (1, 'term'), (2, 'definition'), (3, 'definition')) s(item_no, kind) WHERE s.item_no < 3 OR p_size % 2 = 0""")
def definition_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<dd>"), F.col("p_size"))).otherwise("")
    html = F.concat(F.lit("<dt>no</dt><dl>out<dt> "), F.col("p_brand"), F.lit("</dt>out<dd>"), F.col("p_type"), F.lit("<b>b</b>"), more, F.lit("</dl>after"))
    return tokens.definitions(_by_part(spark, sf_dir, html))


@_query("SELECT p_partkey AS page_id, b.block_no, CASE b.block_no WHEN 1 THEN p_brand || chr(10) || '  ' || p_type ELSE p_type || chr(10) END AS text FROM part, (VALUES (1), (2)) b(block_no) WHERE b.block_no = 1 OR p_size % 2 = 0")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<pre>"), F.col("p_type"), F.lit("\n"))).otherwise("")
    return tokens.code_blocks(_by_part(spark, sf_dir, F.concat(F.lit("x<pre>"), F.col("p_brand"), F.lit("\n  <code>"), F.col("p_type"), F.lit("</code></pre>y"), more)))


@_query("""SELECT p_partkey AS page_id, pos, pos % 4 = 2 AS inside FROM part, (SELECT unnest(range(0, 9, 2)) AS pos) WHERE pos <= 2 * (p_size % 5)""")
def quotation_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any tag of q or code switches, an end tag like a start tag."""
    html = F.concat(F.lit("t"), F.expr("substr('<q>t</code>t<code>t</q>t', 1, array(0, 4, 12, 19, 24)[p_size % 5])"))
    return tokens.toggled(_by_part(spark, sf_dir, html), "q", "code").select("page_id", F.col("pos").cast("long").alias("pos"), "inside")


@_query(f"WITH {_TOKENS}, {_LINKS} SELECT page_id, pos, href, NOT (starts_with(href, '#') OR starts_with(href, 'mailto:')) AS shown FROM l WHERE href IS NOT NULL")
def link_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.shown_links(_read(spark, sf_dir, "pages"), ignore_mailto=True)


@_query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), k AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l),
f AS (SELECT doc_id, pos, sum(CASE WHEN starts_with(ltrim(line), 'Th') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM k)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, n % 2 = 1 AS fenced FROM f""")
def fence_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.fenced_lines(_read(spark, sf_dir, "documents"), "Th").drop("line")


@_query("""WITH l AS (SELECT doc_id, string_split(replace(text, '. ', chr(10) || chr(10) || chr(10)), chr(10)) AS ls FROM documents),
k AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l), b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM k),
z AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM b WHERE line <> '' OR before IS NULL OR before <> '' GROUP BY doc_id)
SELECT doc_id, z.text FROM documents LEFT JOIN z USING (doc_id)""")
def blank_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("\n\n\n")).alias("text"))
    return tokens.few_blank_lines(docs)


# -- text functions


@_query(f"""WITH {_TOKENS} SELECT page_id, pos, {_decoded('tok')} AS text FROM t WHERE kind = 'text'""")
def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokens(_read(spark, sf_dir, "pages")).where("kind = 'text'").select("page_id", "pos", C.decode_entities("tok").alias("text"))


_CODES = {k: stand_ins_by_code().get(v, chr(v)) for k, v in C1.items()} | stand_ins_by_code()
_CODE_CASES = " ".join(f"WHEN {k} THEN '" + v.replace("'", "''") + "'" for k, v in _CODES.items())


@_query(f"""SELECT DISTINCT code, CASE WHEN code <= 0 OR code >= 1114112 OR code BETWEEN 55296 AND 57343 THEN chr(65533)
  ELSE coalesce(CASE code {_CODE_CASES} END, chr(CAST(code AS INTEGER))) END AS text
FROM (SELECT CAST(l_partkey * 37 + l_linenumber * 5 - 300 AS BIGINT) AS code FROM lineitem)""")
def charref_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _read(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 37 + F.col("l_linenumber") * 5 - 300).cast("long").alias("code")).distinct()
    return codes.select("code", C.character(F.col("code")).alias("text"))


_ESC_LINK = r"regexp_replace({c}, '([\\\[\]()])', '\\\1', 'g')"


@_query("SELECT doc_id, " + _ESC_LINK.format(c="text") + " AS escaped FROM documents")
def escape_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", C.escape_link("text").alias("escaped"))


def _escaped(c: str, snob: bool = False) -> str:
    """Without lookahead: what follows is captured and given back; starts of lines do not overlap."""
    out = rf"regexp_replace({c}, '\\([\\`*_{{}}\[\]()#+\-.!])', '\\\\\1', 'g')"
    if snob:
        out = rf"regexp_replace({out}, '([`*_{{}}\[\]()#!])', '\\\1', 'g')"
    for start, mark, after in ((r"[\t-\r ]*[0-9]+", r"\.", r"[\t-\r ]"), (r"[\t-\r ]*", r"\+", r"[\t-\r ]"), (r"[\t-\r ]*", "-", r"[\t-\r \-]")):
        out = rf"regexp_replace({out}, '(?m)^({start})({mark})({after})', '\1\\\2\3', 'g')"
    return out


@_query(f"SELECT doc_id, {_escaped('text')} AS escaped FROM documents")
def escape_md_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", C.escape("text").alias("escaped"))


@_query(f"SELECT doc_id, {_escaped('text', True)} AS escaped FROM documents")
def escape_snob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", C.escape("text", snob=True).alias("escaped"))


@_query(r"SELECT doc_id, regexp_replace(text, '[\t-\r ]+', ' ', 'g') AS collapsed FROM documents")
def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", C.collapse_space("text").alias("collapsed"))


@_query("SELECT doc_id, replace(replace(replace(chr(8206) || text || chr(160) || lang || chr(8207), chr(8206), ''), chr(8207), ''), chr(160), ' ') AS plain FROM documents")
def strip_marks_nbsp(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("‎"), F.col("text"), F.lit(" "), F.col("lang"), F.lit("‏"))
    return _read(spark, sf_dir, "documents").select("doc_id", C.plain_spaces(C.strip_direction_marks(marked)).alias("plain"))


_LINES = "l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), k AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l), b AS (SELECT *, regexp_replace(line, '^[\\x00\\t\\n\\x0b\\r ]+', '') AS bare FROM k)"


@_query(rf"""WITH {_LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos,
CASE WHEN starts_with(line, '    ') OR starts_with(line, chr(9)) THEN true WHEN regexp_matches(bare, '(?s)^--[^-]') THEN false
     WHEN starts_with(bare, '-') OR (starts_with(bare, '*') AND NOT starts_with(bare, '**')) THEN true
     WHEN contains(line, ' | ') THEN true ELSE regexp_matches(bare, '^([0-9]+\.[\t-\r ]|[-*+][\t-\r ])') END AS keeps FROM b""")
def skipwrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tokens.lines(_read(spark, sf_dir, "documents"))
    return lines.select("doc_id", "pos", C.keeps_line("line").alias("keeps"))


_MARKED = "CASE pos % 9 WHEN 0 THEN '- ' WHEN 1 THEN ' | ' WHEN 2 THEN '[a](b) ' WHEN 3 THEN '12. ' WHEN 4 THEN '**' WHEN 5 THEN '-- ' WHEN 6 THEN '--- ' WHEN 7 THEN '    ' ELSE '' END || line"


@_query(rf"""WITH {_LINES}, m AS (SELECT doc_id, pos, {_MARKED} AS line FROM k), y AS (SELECT *, regexp_replace(line, '^[\x00\t\n\x0b\r ]+', '') AS bare FROM m)
SELECT doc_id, CAST(pos AS INTEGER) AS pos,
CASE WHEN regexp_matches(line, '\[.*?\] ?\(.*?\)|\[.*?\]:') THEN true WHEN starts_with(line, '    ') OR starts_with(line, chr(9)) THEN true WHEN regexp_matches(bare, '(?s)^--[^-]') THEN false
     WHEN starts_with(bare, '-') OR (starts_with(bare, '*') AND NOT starts_with(bare, '**')) THEN false
     ELSE regexp_matches(bare, '^([0-9]+\.[\t-\r ]|[-*+][\t-\r ])') END AS keeps FROM y""")
def skipwrap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other value of each of the three flags."""
    k = F.col("pos") % 9
    mark = F.when(k == 0, "- ").when(k == 1, " | ").when(k == 2, "[a](b) ").when(k == 3, "12. ").when(k == 4, "**").when(k == 5, "-- ").when(k == 6, "--- ").when(k == 7, "    ").otherwise("")
    lines = tokens.lines(_read(spark, sf_dir, "documents")).withColumn("line", F.concat(mark, "line"))
    return lines.select("doc_id", "pos", C.keeps_line("line", wrap_links=False, wrap_list_items=True, wrap_tables=True).alias("keeps"))


# Letters and digits are doubled, so that one can be the end of a match and the start of the next.
@_query(r"""SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(coalesce(text, ''), '([\pL\pN])', '\1\1', 'g'), '[\pL\pN]-[\pL\pN]')) AS INTEGER) AS n FROM documents""")
def hyphen_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", C.hyphen_breaks(F.coalesce("text", F.lit(""))).alias("n"))


@_query("SELECT c_custkey, regexp_matches(u, '^[a-zA-Z+]+://') AS absolute FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'http://' WHEN 1 THEN '/' ELSE 'a1://' END || c_name AS u FROM customer)")
def absolute_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.concat(F.when(F.col("c_custkey") % 3 == 0, "http://").when(F.col("c_custkey") % 3 == 1, "/").otherwise("a1://"), F.col("c_name"))
    return _read(spark, sf_dir, "customer").select("c_custkey", C.is_absolute(u).alias("absolute"))


_PATHS = "(CASE c_custkey % 2 WHEN 0 THEN '/' ELSE '' END || 'a/./' || c_nationkey || '/../' || c_mktsegment || '//' || CASE c_custkey % 5 WHEN 0 THEN '../../..' WHEN 1 THEN 'x/' ELSE 'y' END)"


def _paths() -> Column:
    end = F.when(F.col("c_custkey") % 5 == 0, "../../..").when(F.col("c_custkey") % 5 == 1, "x/").otherwise("y")
    return F.concat(F.when(F.col("c_custkey") % 2 == 0, "/").otherwise(""), F.lit("a/./"), F.col("c_nationkey"), F.lit("/../"), F.col("c_mktsegment"), F.lit("//"), end)


@_query(f"SELECT c_custkey, {_normal_path(_PATHS)} AS path FROM customer")
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", C.normal_path(_paths()).alias("path"))


@_query(f"""WITH u AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'https://u:p@h.example:8080/d/e?q=1#f' WHEN 1 THEN 'http://h.example' ELSE '//h.example/d/' END AS base,
  CASE c_custkey % 7 WHEN 0 THEN '#x' WHEN 1 THEN '?y=1' WHEN 2 THEN '//o.example/z' WHEN 3 THEN '' WHEN 4 THEN 'mailto:a' ELSE {_PATHS} || '?k=2#m' END AS link FROM customer)
SELECT c_custkey, base, link, {_joined('base', 'link')} AS joined FROM u""")
def url_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    base = F.when(k % 3 == 0, "https://u:p@h.example:8080/d/e?q=1#f").when(k % 3 == 1, "http://h.example").otherwise("//h.example/d/")
    link = F.when(k % 7 == 0, "#x").when(k % 7 == 1, "?y=1").when(k % 7 == 2, "//o.example/z").when(k % 7 == 3, "").when(k % 7 == 4, "mailto:a").otherwise(F.concat(_paths(), F.lit("?k=2#m")))
    u = _read(spark, sf_dir, "customer").select("c_custkey", base.alias("base"), link.alias("link"))
    return u.select("c_custkey", "base", "link", C.join_url("base", "link").alias("joined"))


_STYLE = "('Color: ' || p_brand || '; margin-left: ' || p_size || 'px;x; font-weight:' || CASE p_partkey % 3 WHEN 0 THEN 'BOLD' ELSE '400' END || CASE p_partkey % 2 WHEN 0 THEN ';height: 1px; list-style-type:disc' ELSE '; font-family: Courier New;color:red' END)"


def _style() -> Column:
    weight = F.when(F.col("p_partkey") % 3 == 0, "BOLD").otherwise("400")
    end = F.when(F.col("p_partkey") % 2 == 0, ";height: 1px; list-style-type:disc").otherwise("; font-family: Courier New;color:red")
    return F.concat(F.lit("Color: "), F.col("p_brand"), F.lit("; margin-left: "), F.col("p_size"), F.lit("px;x; font-weight:"), weight, end)


@_query(f"""WITH s AS (SELECT p_partkey, string_split({_STYLE}, ';') AS ps FROM part),
e AS (SELECT p_partkey, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM s),
k AS (SELECT p_partkey, i, lower(trim(substr(p, 1, instr(p, ':') - 1))) AS property, lower(trim(substr(p, instr(p, ':') + 1))) AS value FROM e WHERE contains(p, ':'))
SELECT p_partkey, property, arg_max(value, i) AS value FROM k GROUP BY p_partkey, property""")
def css_property_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", F.explode(C.properties(_style())).alias("property", "value"))


@_query(r"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'ul' ELSE 'ol' END AS kind, p_partkey % 2 = 0 AS tall, p_partkey % 2 <> 0 AS fixed,
CAST(p_size // 36 AS INTEGER) AS nesting, CASE WHEN p_partkey % 3 = 0 THEN 'bold' ELSE '400' END AS emphasis, CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size - 1 END AS INTEGER) AS starts FROM part""")
def style_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    styled = _read(spark, sf_dir, "part").withColumn("s", C.properties(_style()))
    start = F.when(F.col("p_partkey") % 4 == 0, "x").otherwise(F.concat(F.lit(" "), F.col("p_size")))
    s = F.col("s")
    return styled.select("p_partkey", C.list_kind(s).alias("kind"), C.has_height(s).alias("tall"), C.fixed_width(s).alias("fixed"), C.nesting(s).alias("nesting"), F.array_join(C.emphasis_of(s), ",").alias("emphasis"), C.list_start(start).alias("starts"))


@_query("""WITH rules(class, property, value) AS (VALUES ('c0', 'color', 'red'), ('c1', 'color', 'green'), ('c1', 'top', 'y'), ('p, a', 'z', '1')),
k AS (SELECT p_partkey, p_size, string_split(CASE WHEN p_partkey % 2 = 0 THEN 'c0 none' WHEN p_partkey % 3 = 0 THEN 'c0 c1' ELSE 'c9' END, ' ') AS cs FROM part),
e AS (SELECT p_partkey, unnest(cs) AS class, generate_subscripts(cs, 1) AS i FROM k),
v AS (SELECT p_partkey, property, value, i FROM e JOIN rules USING (class) UNION ALL SELECT p_partkey, 'width', p_size || 'px', 100 FROM k UNION ALL SELECT p_partkey, 'top', 'x', 0 FROM k UNION ALL SELECT p_partkey, 'color', 'blue', 0 FROM k)
SELECT p_partkey, arg_max(value, i) FILTER (WHERE property = 'color') AS color, arg_max(value, i) FILTER (WHERE property = 'width') AS width, arg_max(value, i) FILTER (WHERE property = 'top') AS top FROM v GROUP BY p_partkey""")
def element_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = C.rules(F.lit("@import url(a.css); .c0 {color: RED} .c1 {color: green; top: y} p, a {z: 1}"))
    parent = F.create_map(F.lit("top"), F.lit("x"), F.lit("color"), F.lit("blue"))
    made = C.element_style(parent, F.when(F.col("p_partkey") % 2 == 0, " c0  none").when(F.col("p_partkey") % 3 == 0, "c0 c1").otherwise("c9"), known, F.concat(F.lit("width:"), F.col("p_size"), F.lit("PX")))
    styled = _read(spark, sf_dir, "part").withColumn("s", made)
    return styled.select("p_partkey", *(F.try_element_at("s", F.lit(k)).alias(k) for k in ("color", "width", "top")))


@_query(f"""WITH {_NUMBERED}, w AS (SELECT *, max(length(CAST(l_partkey AS VARCHAR)) + 1) OVER (PARTITION BY l_orderkey) AS w1, max(length(l_returnflag) + 2) OVER (PARTITION BY l_orderkey) AS w2 FROM n),
r AS (SELECT l_orderkey, k, '| ' || rpad(CAST(l_partkey AS VARCHAR), CAST(w1 AS INTEGER), ' ') || '|' || rpad(' ' || l_returnflag, CAST(w2 AS INTEGER), ' ') || '|' AS line FROM w)
SELECT l_orderkey, string_agg(line, chr(10) ORDER BY k) AS aligned FROM r GROUP BY l_orderkey""")
def pad_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("l_partkey").cast("string"), F.lit("| "), F.col("l_returnflag"))
    made = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))).alias("ls"))
    return made.select("l_orderkey", F.array_join(C.align_table(F.transform("ls", lambda x: x["line"])), "\n").alias("aligned"))


@_query(f"""WITH {_NUMBERED}, w AS (SELECT *, max(length(CAST(l_partkey AS VARCHAR)) + 1) OVER (PARTITION BY l_orderkey) AS w1, max(length(l_returnflag) + 2) OVER (PARTITION BY l_orderkey) AS w2 FROM n),
r AS (SELECT l_orderkey, k, '| ' || rpad(CAST(l_partkey AS VARCHAR), CAST(w1 AS INTEGER), ' ') || '|' || rpad(' ' || l_returnflag, CAST(w2 AS INTEGER), ' ') || '|' AS line FROM w),
a AS (SELECT l_orderkey, string_agg(line, chr(10) ORDER BY k) AS aligned FROM r GROUP BY l_orderkey)
SELECT l_orderkey, 'head | x' || chr(10) || aligned || CASE l_orderkey % 2 WHEN 0 THEN chr(10) || chr(10) || 'tail' ELSE '' END AS aligned FROM a""")
def align_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables between marks within a text; those of odd orders are not closed."""
    line = F.concat(F.col("l_partkey").cast("string"), F.lit("| "), F.col("l_returnflag"))
    made = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))).alias("ls"))
    text = F.concat(F.lit(f"head | x\n{X.TABLE_MARK}\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.when(F.col("l_orderkey") % 2 == 0, f"\n{X.TABLE_MARK}\ntail").otherwise(""))
    return made.select("l_orderkey", convert.align_tables(text).alias("aligned"))


@_query(r"SELECT tag, count(*) AS n, CASE WHEN regexp_matches(tag, '^h[1-9]$') THEN CAST(substr(tag, 2, 1) AS INTEGER) ELSE 0 END AS level FROM (SELECT 'h' || (o_orderkey % 13) AS tag FROM orders) GROUP BY tag")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _read(spark, sf_dir, "orders").select(F.concat(F.lit("h"), F.col("o_orderkey") % 13).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).withColumn("level", C.heading_level("tag"))


# -- the conversion itself


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@_query("SELECT * FROM (VALUES " + ", ".join(f"({_literal(name)}, {_literal(want)})" for name, _, _, want in golden.CASES) + ") v(name, markdown)")
def golden_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversion of a table of cases, each with options of its own."""
    rows = [(name, html, golden.named(options)) for name, html, options, _ in golden.CASES]
    cases = spark.createDataFrame(rows, "name string, html string, options map<string,string>")
    ends = F.regexp_replace(F.regexp_replace(convert.to_markdown_with("html", "options"), r"\A\n+", ""), r"[ \t\n\x0b\f\r]+\z", "")
    return cases.select("name", ends.alias("markdown"))


@_query(r"""SELECT p_partkey AS page_id, '# ' || p_brand || chr(10) || chr(10) || 'Type _' || p_type || '_ of **size ' || p_size || '**.' || chr(10) || chr(10)
|| '  * [' || p_partkey || '](http://h.example/p/' || p_partkey || ')' || chr(10) || '    ' || (CASE WHEN p_size % 2 = 0 THEN '1. even' ELSE '1. odd' END) || chr(10) || '    2. `' || p_brand || '`' || chr(10) || '  * last' || repeat(chr(10), 4)
|| '> quoted' || chr(10) || chr(10) || 'k| v  ' || chr(10) || '---|---  ' || chr(10) || 'size| ' || p_size || '  ' || chr(10) || '      ' || chr(10) || '    ' || chr(10) || '    code' || chr(10) || '      ' || p_size || chr(10) || chr(10) || 'end  ' || chr(10) || 'x' AS markdown FROM part""")
def markdown_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of columns, converted without wrapping."""
    html = F.concat(
        F.lit("<html><head><title>no</title><style>p{}</style></head><body><h1>"), F.col("p_brand"), F.lit("</h1>\n<p>Type <em>"), F.col("p_type"), F.lit("</em>  of\n<b>size "), F.col("p_size"), F.lit("</b>.</p>"),
        F.lit("<ul><li><a href='/p/"), F.col("p_partkey"), F.lit("'>"), F.col("p_partkey"), F.lit("</a><ol><li>"), F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd"), F.lit("<li><code>"), F.col("p_brand"), F.lit("</code></ol><li>last</ul>"),
        F.lit("<blockquote>quoted</blockquote><table><tr><th>k<th>v</tr><tr><td>size<td>"), F.col("p_size"), F.lit("</tr></table><pre>code\n  "), F.col("p_size"), F.lit("</pre><script>no</script><p>end<br>x"),
    )
    made = _by_part(spark, sf_dir, html)
    text = convert.to_markdown("html", Options(body_width=0, base_url="http://h.example/d/"))
    return convert.spread(made).select("page_id", F.regexp_replace(text, r"\A\n+|\n+\z", "").alias("markdown"))


# A line takes words while they fit; the words are short, and have neither hyphens nor marks.
@_query("""WITH RECURSIVE t AS (SELECT c_custkey, string_split(replace(c_name, '#', ' ') || ' ' || c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR) || ' ' || lower(c_mktsegment) || ' ' || CAST(c_custkey AS VARCHAR) || ' é ' || c_mktsegment, ' ') AS ws FROM customer),
w AS (SELECT c_custkey, ws, 1 AS i, ws[1] AS wrapped, length(ws[1]) AS used FROM t
UNION ALL SELECT c_custkey, ws, i + 1, wrapped || CASE WHEN used + 1 + length(ws[i + 1]) <= 16 THEN ' ' ELSE chr(10) END || ws[i + 1], CASE WHEN used + 1 + length(ws[i + 1]) <= 16 THEN used + 1 + length(ws[i + 1]) ELSE length(ws[i + 1]) END FROM w WHERE i < len(ws))
SELECT c_custkey, wrapped FROM w WHERE i = len(ws)""")
def wordwrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", F.replace("c_name", F.lit("#"), F.lit(" ")), "c_mktsegment", F.col("c_nationkey").cast("string"), F.lower("c_mktsegment"), F.col("c_custkey").cast("string"), F.lit("é"), "c_mktsegment")
    return _read(spark, sf_dir, "customer").select("c_custkey", convert.wrap(text, 16).alias("wrapped"))


@_query("SELECT page_id, url, coalesce(html, '') AS html FROM pages")
def pages_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as JSON, read as a source, written by the sink with their Markdown, and read back."""
    folder = f"{_shared(spark)}/pages-{uuid.uuid4().hex}"
    _read(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).write.json(f"{folder}/in")
    sources.write_markdown(convert.convert(sources.read_pages(spark, f"{folder}/in", "json")), f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").where("markdown is not null").select("page_id", "url", "html")


@_query()
def to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.convert(_read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "markdown")


@_query()
def markdown_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = Options(body_width=0, inline_links=False, unicode_snob=True, strong_mark="__", single_line_break=True)
    pages = convert.spread(_read(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", convert.try_to_markdown("html", options).alias("r")).select("page_id", "r.*")


@_query()
def html_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.events(_read(spark, sf_dir, "pages"))


@_query()
def wordwrap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = convert.spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", convert.wrap("text", 72).alias("wrapped"))


@_query()
def stream_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convert the pages as a stream of what is there, and read back what was written."""
    folder = _shared(spark)
    path = f"{folder}/stream-{uuid.uuid4().hex}"
    schema = _read(spark, sf_dir, "pages").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/pages.parquet" if not _is_file(spark, f"{sf_dir}/pages.parquet") else sf_dir + "/page[s].parquet")
    streaming.write_stream(streaming.convert_stream(source).select("page_id", "markdown"), f"{path}/out", f"{path}/log").awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
