"""HTML as rows of tokens, and the views over them: depths, links, headings, list items.

All are DataFrame operations.  Tokens of a page are numbered by ``pos``; page_id must
identify a page.  Views that look at single tokens shuffle nothing.  Views with windows
deal the pages out by page_id while each is still one row, and all windows and groups
of the view then run where the page lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from pagemill.functions import columns as C

# A script, style or comment is one token, so that what it holds is never taken for tags.
TOKEN = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[^>]*>|[^<]+|<"


def _page() -> WindowSpec:
    return W.partitionBy("page_id").orderBy("pos")


def _so_far() -> WindowSpec:
    return _page().rowsBetween(W.unboundedPreceding, W.currentRow)


def tokens(pages: DataFrame, *extra: str) -> DataFrame:
    """page_id, pos, tok, kind (open, close, raw, skip or text) and tag in lower case, with further columns of pages."""
    each = pages.select("page_id", *extra, F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    kind = (
        F.when(F.col("tok").rlike("(?i)^<(script|style)[\\s>]"), "raw").when(F.col("tok").rlike("^<[!?]"), "skip").when(F.col("tok").rlike("^</[a-zA-Z]"), "close")
        .when(F.col("tok").rlike("^<[a-zA-Z]"), "open").otherwise("text")
    )
    return each.select("page_id", *extra, "pos", "tok", kind.alias("kind"), F.lower(F.regexp_extract("tok", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)).alias("tag"))


def _dealt(pages: DataFrame) -> DataFrame:
    """tokens() with all of a page in one partition: a page moves as one row, not as its tokens."""
    return tokens(pages.select("page_id", "html").repartition("page_id"))


def attribute(name: str) -> Column:
    """The value of an attribute of the token at hand, null where it has none."""
    pattern = rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
    raw = F.regexp_extract("tok", pattern, 1)
    bare = F.when(raw.rlike("^[\"']"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.when(F.col("tok").rlike(pattern), C.decode_entities(bare))


def tag_histogram(pages: DataFrame) -> DataFrame:
    return tokens(pages).where("kind = 'open' or kind = 'raw'").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("n_pages"))


def anchor_depth(pages: DataFrame) -> DataFrame:
    """Open anchors around each text, never below zero."""
    step = F.when(F.col("tag") != "a", 0).when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    summed = _dealt(pages).withColumn("s", F.sum(step).over(_so_far()))
    floored = summed.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(_so_far())))
    return floored.where("kind = 'text'").select("page_id", "pos", F.col("depth").cast("int").alias("depth"), F.length("tok").alias("n_chars"))


def visible_text(pages: DataFrame) -> DataFrame:
    """page_id and the text outside of head, scripts and styles; a page without any has an empty one.

    Either tag of body starts anew, and an end tag of head without a start hides nothing.
    """
    t = _dealt(pages).withColumn("part", F.sum(F.when((F.col("tag") == "body") & F.col("kind").isin("open", "close"), 1).otherwise(0)).over(_so_far()))
    part = W.partitionBy("page_id", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumn("s", F.sum(_stepped("head")).over(part))
    quiet = F.col("s") - F.least(F.lit(0), F.min("s").over(part))
    shown = t.withColumn("quiet", quiet).withColumn("shown", F.when((F.col("quiet") == 0) & (F.col("kind") == "text"), F.struct("pos", "tok")))
    joined = shown.groupBy("page_id").agg(F.array_sort(F.collect_list("shown")).alias("parts"))
    bare = pages.where(F.coalesce("html", F.lit("")) == "").select("page_id", F.lit("").alias("text"))  # these have no tokens
    return joined.select("page_id", F.array_join(F.transform("parts", lambda p: p["tok"]), "").alias("text")).union(bare)


def _nested(t: DataFrame, *tags: str) -> DataFrame:
    """Tokens with ``depth`` and ``no``: how many elements of ``tags`` are open there, and which the innermost is.

    Elements are numbered by their start tags.  A start and an end tag count as inside
    of their element; an end tag without a start is inside of none.
    """
    mine = F.col("tag").isin(*tags)
    t = t.withColumn("step", F.when(mine & (F.col("kind") == "open"), 1).when(mine & (F.col("kind") == "close"), -1).otherwise(0))
    t = t.withColumn("s", F.sum("step").over(_so_far())).withColumn("opened", F.sum(F.when(F.col("step") == 1, 1).otherwise(0)).over(_so_far()))
    t = t.withColumn("after", F.col("s") - F.least(F.lit(0), F.min("s").over(_so_far())))
    t = t.withColumn("depth", F.when(F.col("step") == -1, F.lag("after", 1, 0).over(_page())).otherwise(F.col("after")).cast("int"))
    same = W.partitionBy("page_id", "depth").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    no = F.when(F.col("depth") > 0, F.last(F.when(F.col("step") == 1, F.col("opened")), ignorenulls=True).over(same))
    return t.withColumn("no", no.cast("int")).drop("s", "opened", "after")


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, title and the address resolved against the page's."""
    found = tokens(pages, "url").where("kind = 'open' and tag = 'a'").select("page_id", "url", "pos", attribute("href").alias("href"), attribute("title").alias("title")).where("href is not null")
    return found.select("page_id", "pos", "href", "title", C.join_url("url", "href").alias("resolved"))


def reference_numbers(pages: DataFrame) -> DataFrame:
    """page_id, href, title, n, ref_no: distinct links numbered in the order in which they close, the inner before the outer.

    A link that is not closed ends with the page.
    """
    t = _nested(_dealt(pages).where("tag = 'a' and kind in ('open', 'close')"), "a").where("no is not null")
    one = t.groupBy("page_id", "no").agg(F.min(F.when(F.col("kind") == "close", F.col("pos"))).alias("closed"), F.min(F.when(F.col("kind") == "open", F.struct("pos", "tok"))).alias("o"))
    found = one.select("page_id", "closed", F.col("o.pos").alias("pos"), F.col("o.tok").alias("tok")).select("page_id", "closed", "pos", attribute("href").alias("href"), attribute("title").alias("title")).where("href is not null")
    place = F.struct(F.col("closed").isNull().alias("left_open"), "closed", (-F.col("pos")).alias("pos"))
    first = found.groupBy("page_id", "href", "title").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))
    return first.select("page_id", "href", "title", "n", F.row_number().over(W.partitionBy("page_id").orderBy("place")).alias("ref_no"))


def headings(pages: DataFrame) -> DataFrame:
    """page_id, heading_no, level and text of each heading."""
    level = C.heading_level("tag")
    t = _dealt(pages).withColumn("level", level)
    starts = F.when((F.col("kind") == "open") & (F.col("level") > 0), 1).otherwise(0)
    ends = F.when((F.col("kind") == "close") & (F.col("level") > 0), 1).otherwise(0)
    t = t.withColumn("heading_no", F.sum(starts).over(_so_far())).withColumn("closed", F.sum(ends).over(_so_far()))
    inside = t.where("heading_no > closed or (kind = 'open' and level > 0)")
    made = inside.groupBy("page_id", "heading_no").agg(F.max("level").alias("level"), F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "tok")))).alias("parts"))
    return made.select("page_id", F.col("heading_no").cast("int").alias("heading_no"), "level", F.array_join(F.transform("parts", lambda p: p["tok"]), "").alias("text"))


def list_items(pages: DataFrame) -> DataFrame:
    """page_id, li_idx, list_no, list_kind, number and level of each list item.

    An item belongs to the innermost list that is open; lists are numbered by their
    start tags (0: an item outside of lists).  Items of a list are numbered from its
    ``start``, if that is of digits, or else from 1.
    """
    t = _nested(_dealt(pages).where("kind in ('open', 'close') and tag in ('ol', 'ul', 'li')"), "ol", "ul").where("kind = 'open'")
    own = W.partitionBy("page_id", "no").orderBy("pos")
    start = F.regexp_extract(F.coalesce(attribute("start"), F.lit("")), "^([0-9]{1,9})$", 1)
    t = t.withColumn("kind_of", F.first("tag").over(own)).withColumn("from", F.first(F.when((F.col("tag") == "ol") & (start != ""), start.try_cast("int")).otherwise(1)).over(own))
    t = t.withColumn("nth", F.sum(F.when(F.col("tag") == "li", 1).otherwise(0)).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)))
    items = t.where("tag = 'li'")
    outside = F.col("no").isNull()
    number = F.when(outside, F.col("nth")).otherwise(F.col("from") - 1 + F.col("nth")).cast("int")
    return items.select("page_id", F.row_number().over(_page()).alias("li_idx"), F.coalesce("no", F.lit(0)).alias("list_no"), F.when(outside, "ul").otherwise(F.col("kind_of")).alias("list_kind"), number.alias("number"), F.col("depth").alias("level"))


def images(pages: DataFrame) -> DataFrame:
    """page_id, pos, src and alt of images that have a source."""
    found = tokens(pages).where("kind = 'open' and tag = 'img'").select("page_id", "pos", attribute("src").alias("src"), attribute("alt").alias("alt"))
    return found.where("src is not null and src <> ''")


def _rows(pages: DataFrame) -> DataFrame:
    """Tokens inside tables, by the innermost one (table_no), with the number of its rows so far."""
    t = _nested(_dealt(pages), "table").where("no is not null").withColumnRenamed("no", "table_no")
    so_far = W.partitionBy("page_id", "table_no").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return t.withColumn("row_no", F.sum(F.when((F.col("kind") == "open") & (F.col("tag") == "tr"), 1).otherwise(0)).over(so_far).cast("int"))


def table_cells(pages: DataFrame) -> DataFrame:
    """page_id, table_no, row_no, col_no, text and width of each cell; the text of a table inside a cell is in cells of its own.

    Tables are numbered by their start tags, rows by those of their table.
    """
    cell = F.col("tag").isin("td", "th")
    opens = F.when((F.col("kind") == "open") & cell, 1).otherwise(0)
    own = W.partitionBy("page_id", "table_no").orderBy("pos")
    so_far = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    t = _rows(pages).withColumn("cell_at", F.sum(opens).over(so_far))
    edge = F.when(F.col("kind").isin("open", "close") & F.col("tag").isin("td", "th", "tr", "table"), F.col("pos"))
    t = t.withColumn("cut", F.last(edge, ignorenulls=True).over(so_far)).withColumn("begun", F.last(F.when(opens == 1, F.col("pos")), ignorenulls=True).over(so_far))
    made = t.where("begun = cut").groupBy("page_id", "table_no", "row_no", "cell_at").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "tok")))).alias("parts"))
    text = C.trimmed(F.array_join(F.transform("parts", lambda p: p["tok"]), ""))
    cols = W.partitionBy("page_id", "table_no", "row_no").orderBy("cell_at")
    return made.select("page_id", "table_no", "row_no", F.row_number().over(cols).alias("col_no"), text.alias("text"), F.length(text).alias("width"))


def styles(pages: DataFrame) -> DataFrame:
    """page_id, selector, property, value of the rules in style elements."""
    css = tokens(pages).where("kind = 'raw' and tag = 'style'").select("page_id", F.regexp_extract("tok", r"(?is)^<style[^>]*>(.*)</style\s*>$", 1).alias("css"))
    each = css.select("page_id", F.explode(C.rules("css")).alias("selector", "found"))
    return each.select("page_id", "selector", F.explode("found").alias("property", "value"))


def _stepped(tag: str) -> Column:
    return F.when(F.col("tag") != tag, 0).when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)


def depth(pages: DataFrame, tag: str) -> DataFrame:
    """page_id, pos and how many elements ``tag`` are open at each text, never below zero."""
    summed = _dealt(pages).withColumn("s", F.sum(_stepped(tag)).over(_so_far()))
    floored = summed.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(_so_far())))
    return floored.where("kind = 'text'").select("page_id", "pos", F.col("depth").cast("int").alias("depth"))


def toggled(pages: DataFrame, *tags: str) -> DataFrame:
    """page_id, pos and whether each text is inside, where any tag of ``tags`` switches (quotation marks, code)."""
    switch = F.when(F.col("tag").isin(*tags) & F.col("kind").isin("open", "close"), 1).otherwise(0)
    counted = _dealt(pages).withColumn("n", F.sum(switch).over(_so_far()))
    return counted.where("kind = 'text'").select("page_id", "pos", (F.col("n") % 2 == 1).alias("inside"))


def tag_pairs(pages: DataFrame) -> DataFrame:
    """page_id, tag, depth, opened and closed: places of start tags and of the end tags that match them.

    Within a page and tag, the n-th start tag at a depth belongs to the n-th end
    tag at that depth; start tags without one are left out.
    """
    marks = _dealt(pages).where("kind in ('open', 'close')").withColumn("step", F.when(F.col("kind") == "open", 1).otherwise(-1))
    one = W.partitionBy("page_id", "tag").orderBy("pos")
    level = F.sum("step").over(one.rowsBetween(W.unboundedPreceding, W.currentRow))
    marks = marks.withColumn("depth", (F.when(F.col("kind") == "open", level).otherwise(level + 1)).cast("int")).where("depth > 0")
    nth = F.row_number().over(W.partitionBy("page_id", "tag", "depth", "kind").orderBy("pos"))
    marks = marks.select("page_id", "tag", "depth", "kind", "pos", nth.alias("n"))
    paired = marks.groupBy("page_id", "tag", "depth", "n").agg(F.max(F.when(F.col("kind") == "open", F.col("pos"))).alias("opened"), F.max(F.when(F.col("kind") == "close", F.col("pos"))).alias("closed"))
    return paired.where("opened is not null and closed is not null").select("page_id", "tag", "depth", "opened", "closed")


_BLOCKS = "p div article section h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre nav footer header body dl dt dd hr".split()


def paragraphs(pages: DataFrame) -> DataFrame:
    """page_id, block_no, tag and text of each run of text between block tags, where there is text."""
    edge = F.when(F.col("tag").isin(*_BLOCKS) & F.col("kind").isin("open", "close"), 1).otherwise(0)
    t = _dealt(pages).withColumn("block_no", F.sum(edge).over(_so_far()))
    t = t.withColumn("at", F.last(F.when(edge == 1, F.col("tag")), ignorenulls=True).over(_so_far()))
    made = t.where("kind = 'text'").groupBy("page_id", "block_no").agg(F.max("at").alias("tag"), F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("parts"))
    text = C.trimmed(F.array_join(F.transform("parts", lambda p: p["tok"]), ""))
    return made.select("page_id", F.col("block_no").cast("int").alias("block_no"), "tag", text.alias("text")).where("text <> ''")


def abbreviations(pages: DataFrame) -> DataFrame:
    """page_id, abbr, title, first_pos: each abbreviation with the title given last."""
    t = _dealt(pages).withColumn("next", F.lead("tok").over(_page())).withColumn("follows", F.lead("kind").over(_page()))
    found = t.where("kind = 'open' and tag = 'abbr' and follows = 'text'").select("page_id", "pos", attribute("title").alias("title"), F.col("next").alias("abbr")).where("title is not null")
    return found.groupBy("page_id", "abbr").agg(F.max_by("title", "pos").alias("title"), F.min("pos").alias("first_pos"))


def table_rows(pages: DataFrame) -> DataFrame:
    """page_id, table_no, row_no, n_cells and whether the row has its own end tag; a row's cells are those of its table only."""
    ends = F.max(F.when((F.col("kind") == "close") & (F.col("tag") == "tr"), 1).otherwise(0)) == 1
    cells = F.sum(F.when((F.col("kind") == "open") & F.col("tag").isin("td", "th"), 1).otherwise(0))
    return _rows(pages).where("row_no > 0").groupBy("page_id", "table_no", "row_no").agg(cells.alias("n_cells"), ends.alias("explicit"))


SPANS = {"em": "emphasis", "i": "emphasis", "u": "emphasis", "strong": "strong", "b": "strong", "del": "struck", "strike": "struck", "s": "struck"}


def _texts_of(t: DataFrame) -> DataFrame:
    """Of each element that _nested() numbers: page_id, no, depth, tag, opened, and the text that has it as the innermost."""
    made = t.where("no is not null").groupBy("page_id", "no").agg(
        F.min(F.when(F.col("step") == 1, F.struct("pos", "tag", "depth"))).alias("o"), F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "tok")))).alias("parts")
    )
    return made.select("page_id", "no", F.col("o.depth").alias("depth"), F.col("o.tag").alias("tag"), F.col("o.pos").alias("opened"), F.array_join(F.transform("parts", lambda p: p["tok"]), "").alias("text"))


def spans(pages: DataFrame) -> DataFrame:
    """page_id, span_no, kind (emphasis, strong or struck), depth and the text whose innermost span each is."""
    found = _texts_of(_nested(_dealt(pages), *SPANS))
    kind = F.create_map(*(F.lit(x) for kv in SPANS.items() for x in kv))[F.col("tag")]
    return found.select("page_id", F.col("no").alias("span_no"), kind.alias("kind"), "depth", "text")


def code_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_no and the text of each pre, without the tags in it."""
    return _texts_of(_nested(_dealt(pages), "pre")).select("page_id", F.col("no").alias("block_no"), "text")


def definitions(pages: DataFrame) -> DataFrame:
    """page_id, list_no, item_no, kind (term or definition) and text of each dt and dd of a dl."""
    t = _nested(_dealt(pages), "dl").where("no is not null")
    so_far = W.partitionBy("page_id", "no").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    mine = F.col("tag").isin("dt", "dd")
    t = t.withColumn("item_no", F.sum(F.when(mine & (F.col("kind") == "open"), 1).otherwise(0)).over(so_far).cast("int"))
    t = t.withColumn("last", F.last(F.when((mine | (F.col("tag") == "dl")) & F.col("kind").isin("open", "close"), F.struct("kind", "tag")), ignorenulls=True).over(so_far))
    made = t.where("item_no > 0 and last.kind = 'open' and last.tag in ('dt', 'dd')").groupBy("page_id", "no", "item_no").agg(F.max("last.tag").alias("tag"), F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "tok")))).alias("parts"))
    text = C.trimmed(F.array_join(F.transform("parts", lambda p: p["tok"]), ""))
    return made.select("page_id", F.col("no").alias("list_no"), "item_no", F.when(F.col("tag") == "dt", "term").otherwise("definition").alias("kind"), text.alias("text"))


def shown_links(pages: DataFrame, skip_internal: bool = True, ignore_mailto: bool = False) -> DataFrame:
    """links() with whether each keeps its link syntax."""
    hidden = F.lit(False)
    if skip_internal:
        hidden = hidden | F.col("href").startswith("#")
    if ignore_mailto:
        hidden = hidden | F.col("href").startswith("mailto:")
    return links(pages).select("page_id", "pos", "href", (~hidden).alias("shown"))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos and line of each text; a null text is one empty line."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def fenced_lines(docs: DataFrame, mark: str = "```", key: str = "doc_id", text: str = "text") -> DataFrame:
    """lines() with whether each is inside marks, or opens them; each line that starts with the mark switches.

    A row is a text of its own, whatever its key.  Rows are dealt out whole, before they become lines.
    """
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")).repartition("row")
    each = rows.select(key, "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    switch = F.when(C.left_trimmed("line").startswith(mark), 1).otherwise(0)
    so_far = W.partitionBy("row").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return each.select(key, "pos", "line", (F.sum(switch).over(so_far) % 2 == 1).alias("fenced"))


def few_blank_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text, with one blank line at most between others, and none at the start or end beside the one; null stays null."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), r"\n{3,}", "\n\n"), r"\A\n\n", "\n"), r"\n\n\z", "\n")
    return docs.select(key, F.when(F.col(text).rlike(r"\A\n+\z"), "").otherwise(c).alias("text"))
