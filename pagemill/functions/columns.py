"""Native twins of pagemill.functions.text: expressions over columns, no Python at run time."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import tables as T

_ASCII_SPACE = r"[\t-\r ]"  # what the reference rules call white space
_TRIM = "\t\n\r\0\x0b "


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without tabs, line ends, NUL, vertical tabs and spaces at both ends."""
    return F.trim(_text(c), F.lit(_TRIM))


def left_trimmed(c: Column | str) -> Column:
    return F.ltrim(_text(c), F.lit(_TRIM))


# -- escaping and white space


def escape_link(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), T.LINK_CHARACTERS, r"\\$1")


def escape(c: Column | str, snob: bool = False) -> Column:
    """Escape running text; ``(?d)`` keeps line feed the only line end."""
    out = F.regexp_replace(_text(c), T.BACKSLASH, r"\\$1")
    if snob:
        out = F.regexp_replace(out, T.ALL_CHARACTERS, r"\\$1")
    for start in (T.ORDERED_START, T.PLUS_START, T.DASH_START):
        out = F.regexp_replace(out, f"(?md){start}", r"$1\\$2")
    return out


def collapse_space(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), rf"{_ASCII_SPACE}+", " ")


def strip_direction_marks(c: Column | str) -> Column:
    return F.translate(_text(c), "‎‏", "")


def plain_spaces(c: Column | str, unicode_snob: bool = False) -> Column:
    """Non-breaking spaces as the finished text has them."""
    return _text(c) if unicode_snob else F.translate(_text(c), " ", " ")


# -- entities


def _constant(table: dict[str, str]) -> Column:
    """A map of literals, folded when the query is planned; made of one literal, not of one for each entry."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def character(code: Column, unicode_snob: bool = False) -> Column:
    """The character of a numeric reference, from a long."""
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    code = F.when(valid, code).otherwise(0xFFFD).cast("int")
    table = {k: chr(v) for k, v in T.C1.items()}
    if not unicode_snob:
        stand_ins = T.stand_ins_by_code()
        table = {k: stand_ins.get(v, chr(v)) for k, v in T.C1.items()} | stand_ins
    table[0xFEFF] = "\ufeff"  # which the decoder below would take for a byte order mark
    known = _constant({str(k): v for k, v in table.items()})
    made = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(known, code.cast("string")), made)


def reference_code(body: Column) -> Column:
    """The number in ``#123`` or ``#x7b``; -1 if it is too long to be one."""
    digits = F.regexp_extract(body, r"^#[xX]?0*([0-9a-fA-F]*)$", 1)
    number = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))
    return F.when(F.length(digits) > 8, F.lit(-1)).otherwise(F.coalesce(number.try_cast("long"), F.lit(0))).cast("long")


def entity_text(source: Column, unicode_snob: bool = False) -> Column:
    """The text of a reference such as ``&copy;``; unknown names stay, in lower case."""
    from html.entities import html5

    names = {k[:-1]: v for k, v in html5.items() if k.endswith(";") and k[:-1] == k[:-1].lower()}
    if not unicode_snob:
        names |= T.STAND_INS
    names["nbsp"] = " "
    known = _constant(names)
    body = F.substring(source, F.lit(2), F.length(source) - 2)
    lower = F.lower(body)
    named = F.coalesce(F.try_element_at(known, lower), F.concat(F.lit("&"), lower, F.lit(";")))
    return F.when(body.startswith("#"), character(reference_code(body), unicode_snob)).otherwise(named)


ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]+);"


def decode_entities(c: Column | str, unicode_snob: bool = False) -> Column:
    """All references that end in a semicolon, decoded piece by piece."""
    parts = F.regexp_extract_all(_text(c), F.lit(f"{ENTITY}|[^&]+|&"), F.lit(0))
    decoded = F.transform(parts, lambda p: F.when((F.length(p) > 2) & p.startswith("&") & p.endswith(";"), entity_text(p, unicode_snob)).otherwise(p))
    return F.when(F.instr(_text(c), "&") > 0, F.array_join(decoded, "")).otherwise(_text(c))


# -- predicates


def heading_level(tag: Column | str) -> Column:
    t = _text(tag)
    return F.when(t.rlike("^h[1-9]$"), F.substring(t, 2, 1).cast("int")).otherwise(0)


def is_absolute(url: Column | str) -> Column:
    return _text(url).rlike(T.ABSOLUTE_URL)


def keeps_line(line: Column | str, wrap_links: bool = True, wrap_list_items: bool = False, wrap_tables: bool = False) -> Column:
    """Is a line left as it is by the wrapping? The first rule that applies decides."""
    c = _text(line)
    bare = left_trimmed(c)
    out = F.when(F.lit(not wrap_links) & c.rlike(T.LINK_IN_TEXT), True)
    out = out.when(c.startswith("    ") | c.startswith("\t"), True)
    out = out.when(bare.rlike(r"(?s)^--[^-]"), False)
    out = out.when(bare.startswith("-") | (bare.startswith("*") & ~bare.startswith("**")), not wrap_list_items)
    out = out.when(F.lit(not wrap_tables) & c.contains(" | "), True)
    return out.otherwise(bare.rlike(rf"^(?:[0-9]+\.{_ASCII_SPACE}|[-*+]{_ASCII_SPACE})"))


def hyphen_breaks(c: Column | str) -> Column:
    """How many hyphens of a text stand between letters or digits."""
    return F.size(F.regexp_extract_all(_text(c), F.lit(r"(?<=[\p{L}\p{N}])-(?=[\p{L}\p{N}])"), F.lit(0)))


# -- addresses

_URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://((?:[^@/?#]*@)?(?:\[[^\]/?#]*\]|[^:/?#]*)(?::[0-9]{0,5})?))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def normal_path(path: Column | str) -> Column:
    c = _text(path)
    parts = F.filter(F.split(c, "/"), lambda s: ~s.isin("", "."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    out = F.concat(F.when(c.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(c.endswith("/") & (out != "/"), F.concat(out, F.lit("/"))).otherwise(out)


def build_url(scheme: Column, authority: Column, path: Column) -> Column:
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit("://"))).otherwise(""), authority, path)


def join_url(base: Column | str, link: Column | str) -> Column:
    """A link as seen from a base, null for a base that is none; the base's query stays if the link has none."""
    base, link = _text(base), _text(link)
    scheme, site, path, query = (F.regexp_extract(base, _URL, i) for i in (1, 2, 3, 4))
    rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1)
    tail = F.regexp_extract(link, r"(?s)^[^?#]*(\?[^#]*)", 1)
    fragment = F.regexp_extract(link, r"(?s)(#.*)$", 1)
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    whole = normal_path(F.when(rest.startswith("/"), rest).otherwise(F.concat(folder, rest)))
    tail = F.when((tail == "") & (query != ""), F.concat(F.lit("?"), query)).otherwise(tail)
    port = F.regexp_replace(site, ":$", "")
    joined = build_url(scheme, port, F.concat(whole, tail, fragment))
    return (
        F.when(link == "", base).when((base == "") | link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), link).when((scheme == "") & (site == ""), F.lit(None))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"(?s)^([^#]*)", 1), link))
        .when(link.startswith("?"), build_url(scheme, port, F.concat(F.when(path == "", "/").otherwise(path), link)))
        .when(link.startswith("//"), F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), link)).otherwise(joined)
    )


# -- styles


def _last_wins(entries: Column) -> Column:
    """A map of an array of (key, value); of equal keys the last, whatever the session's policy."""
    kept = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(kept)


def properties(style: Column | str) -> Column:
    """``a: b; c: d`` as a map."""
    parts = F.filter(F.split(_text(style), ";"), lambda p: p.contains(":"))
    pair = lambda p: F.struct(F.lower(trimmed(F.substring_index(p, ":", 1))).alias("key"), F.lower(trimmed(F.substring(p, F.instr(p, ":") + 1, F.length(p)))).alias("value"))
    return _last_wins(F.transform(parts, pair))


def rules(css: Column | str) -> Column:
    """Selector -> properties."""
    blocks = F.filter(F.split(F.regexp_replace(_text(css), r"(?s)@import.*?;", ""), r"\}"), lambda b: b.contains("{"))
    pair = lambda b: F.struct(trimmed(F.substring_index(b, "{", 1)).alias("key"), properties(F.substring(b, F.instr(b, "{") + 1, F.length(b))).alias("value"))
    return _last_wins(F.filter(F.transform(blocks, pair), lambda x: x["key"] != ""))


def merged(first: Column, second: Column) -> Column:
    """Two maps; where both have a key, the second's value."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def element_style(parent: Column, classes: Column, known: Column, inline: Column) -> Column:
    """Parent style, then the rules of each class, then the element's own."""
    names = F.filter(F.split(trimmed(classes), rf"{_ASCII_SPACE}+"), lambda c: c != "")
    of_class = F.aggregate(names, parent, lambda acc, c: merged(acc, F.coalesce(F.try_element_at(known, F.concat(F.lit("."), c)), F.create_map().cast("map<string,string>"))))
    return merged(of_class, properties(inline))


def _value(style: Column, key: str) -> Column:
    return F.try_element_at(style, F.lit(key))


def list_kind(style: Column) -> Column:
    return F.when(F.coalesce(_value(style, "list-style-type").isin("disc", "circle", "square", "none"), F.lit(False)), "ul").otherwise("ol")


def has_height(style: Column) -> Column:
    return F.map_contains_key(style, "height")


def fixed_width(style: Column) -> Column:
    return F.coalesce(_value(style, "font-family"), F.lit("")).isin("courier new", "consolas")


def emphasis_of(style: Column) -> Column:
    return F.array_compact(F.array(*(_value(style, k) for k in ("text-decoration", "font-style", "font-weight"))))


def nesting(style: Column, indent: int = 36) -> Column:
    number = F.regexp_extract(F.coalesce(trimmed(_value(style, "margin-left")), F.lit("")), r"^(-?[0-9]+(?:\.[0-9]+)?)(?:[pP][xXtT])?$", 1)
    if indent <= 0:
        return F.lit(0)
    return F.when(number == "", 0).otherwise(F.greatest(F.lit(0), F.floor(F.round(number.try_cast("double")) / indent).cast("int")))


def list_start(start: Column | str) -> Column:
    c = trimmed(F.coalesce(_text(start), F.lit("")))
    return F.when(c.rlike("^-?[0-9]+$"), F.coalesce(c.try_cast("int") - 1, F.lit(0))).otherwise(0)


# -- tables


def align_table(lines: Column, margin: int = 1) -> Column:
    """Pad the cells of an array of pipe-separated lines to the width of their column."""
    rows = F.transform(lines, lambda line: F.transform(F.split(line, r"\|"), lambda c: F.rtrim(c, F.lit(_TRIM))))
    most = F.array_max(F.transform(rows, F.size))
    width = F.transform(F.sequence(F.lit(0), most - 1), lambda i: F.array_max(F.transform(rows, lambda r: F.coalesce(F.length(F.get(r, i)), F.lit(0)))) + margin)

    def shown(line: Column, row: Column) -> Column:
        fill = F.when(trimmed(line).rlike(r"^[-|]+$"), "-").otherwise(" ")
        cells = F.transform(row, lambda c, i: F.rpad(c, F.get(width, i), fill))
        return F.concat(F.lit("|"), fill, F.array_join(cells, "|"), F.lit("|"))

    return F.when(F.size(lines) > 0, F.zip_with(lines, rows, shown)).otherwise(F.array().cast("array<string>"))
