"""Scalar text functions in plain Python: what the writer calls.

Their native twins over columns are in pagemill.functions.columns.
"""

from __future__ import annotations

import re
import unicodedata
from html.entities import html5

from pagemill.functions import tables as T

try:
    import regex
except ImportError:  # then characters are told apart near enough
    regex = None

NBSP = ""  # stands for a non-breaking space until the text is finished (a private character)
_BY_CODE = T.stand_ins_by_code()
_SPACE = " \t\n\r\f\v"
_PHP_TRIM = " \t\n\r\0\v"


def code_point(text: str, hexadecimal: bool, unicode_snob: bool) -> str:
    """The character of a numeric reference."""
    try:
        c = int(text, 16 if hexadecimal else 10)
    except ValueError:
        c = 0
    if c <= 0 or c >= 0x110000 or 0xD800 <= c < 0xE000:
        c = 0xFFFD
    c = T.C1.get(c, c)
    if not unicode_snob and c in _BY_CODE:
        return _BY_CODE[c]
    return chr(c)


def named(name: str, unicode_snob: bool) -> str:
    """The text of a named entity; the name is taken in lower case."""
    name = name.lower()
    if name == "nbsp":
        return NBSP
    if not unicode_snob and name in T.STAND_INS:
        return T.STAND_INS[name]
    return html5.get(f"{name};", f"&{name};")


def entity(source: str, unicode_snob: bool) -> str:
    """The text of a whole reference, such as ``&copy;`` or ``&#x2019;``."""
    body = source[1:-1]
    if body.startswith("#"):
        hexadecimal = body[1] in "xX"
        return code_point(body[2:] if hexadecimal else body[1:], hexadecimal, unicode_snob)
    return named(body, unicode_snob)


def plain(text: str) -> str:
    """Without direction marks, and with the stand-in for non-breaking spaces."""
    return text.replace("‎", "").replace("‏", "").replace(" ", NBSP)


_LINK = re.compile(T.LINK_CHARACTERS)
_ALL = re.compile(T.ALL_CHARACTERS)
_BACKSLASH = re.compile(T.BACKSLASH)
_STARTS = [re.compile(p, re.MULTILINE | re.ASCII) for p in (T.ORDERED_START, T.PLUS_START, T.DASH_START)]


def escape_link(text: str) -> str:
    return _LINK.sub(r"\\\1", text)


def escape(text: str, snob: bool = False) -> str:
    """Escape what Markdown would read in running text."""
    if "\\" in text:
        text = _BACKSLASH.sub(r"\\\1", text)
    if snob:
        text = _ALL.sub(r"\\\1", text)
    for start in _STARTS:
        text = start.sub(r"\1\\\2", text)
    return text


# -- addresses

_SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")
_BASE = re.compile(r"^(?:(?P<scheme>[a-zA-Z][a-zA-Z0-9+.-]*):)?(?://(?:(?P<user>[^:@/?#]*)(?::(?P<password>[^@/?#]*))?@)?(?P<host>\[[^\]/?#]*\]|[^:/?#]*)(?::(?P<port>\d{0,5}))?(?=[/?#]|$))?(?P<path>[^?#]*)(?:\?(?P<query>[^#]*))?(?:#(?P<fragment>.*))?$", re.DOTALL)


def normal_path(path: str) -> str:
    """Without empty, ``.`` and ``..`` segments; slashes at the ends stay."""
    kept: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if kept:
                kept.pop()
        elif part not in ("", "."):
            kept.append(part)
    out = ("/" if path.startswith("/") else "") + "/".join(kept)
    return out + "/" if path.endswith("/") and out != "/" else out


def join_url(base: str, link: str) -> str:
    """A link as seen from a base; the base's query stays if the link has none."""
    if not link:
        return base
    if not base or _SCHEME.match(link):
        return link
    m = _BASE.match(base)
    if m is None or not (m["scheme"] or m["host"]):
        raise ValueError(f"invalid base URL: {base}")
    if link[0] == "#":
        return base.partition("#")[0] + link
    user = "" if m["user"] is None else m["user"] + ("" if m["password"] is None else f":{m['password']}") + "@"
    site = (f"{m['scheme']}://" if m["scheme"] else "") + user + (m["host"] or "") + (f":{m['port']}" if m["port"] else "")
    if link[0] == "?":
        return site + (m["path"] or "/") + link
    if link.startswith("//"):
        return (f"{m['scheme']}:" if m["scheme"] else "") + link
    link, hash_mark, fragment = link.partition("#")
    link, question, query = link.partition("?")
    if not link.startswith("/"):
        folder = m["path"] or "/"
        link = (folder[: folder.rfind("/") + 1] or "/") + link
    tail = question + query or (f"?{m['query']}" if m["query"] else "")
    return site + normal_path(link) + tail + hash_mark + fragment


# -- styles

Style = dict[str, str]


def properties(text: str) -> Style:
    """``a: b; c: d`` as a dict, both sides trimmed and in lower case; the later wins."""
    out: Style = {}
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        if colon:
            out[name.strip(_PHP_TRIM).lower()] = value.strip(_PHP_TRIM).lower()
    return out


def rules(css: str) -> dict[str, Style]:
    """Selector -> properties. Imports are skipped; lists of selectors are not split."""
    while True:
        head, at, rest = css.partition("@import")
        if not at or ";" not in rest:
            break
        css = head + rest.partition(";")[2]
    out = {}
    for block in css.split("}"):
        selector, brace, body = block.partition("{")
        if brace and selector.strip(_PHP_TRIM):
            out[selector.strip(_PHP_TRIM)] = properties(body)
    return out


def element_style(attrs: dict[str, str], known: dict[str, Style], parent: Style) -> Style:
    """Of the parent, the classes and the element itself, the later ones first."""
    out = dict(parent)
    for name in attrs.get("class", "").split():
        out |= known.get(f".{name}", {})
    return out | properties(attrs.get("style", ""))


def list_kind(style: Style) -> str:
    return "ul" if style.get("list-style-type") in ("disc", "circle", "square", "none") else "ol"


def emphasis_of(style: Style) -> list[str]:
    return [style[k] for k in ("text-decoration", "font-style", "font-weight") if k in style]


def fixed_width(style: Style) -> bool:
    return style.get("font-family", "") in ("courier new", "consolas")


_MARGIN = re.compile(r"(-?\d+(?:\.\d+)?)(?:px|pt)?", re.IGNORECASE | re.ASCII)


def nesting(style: Style, indent: int) -> int:
    m = _MARGIN.fullmatch(style.get("margin-left", "").strip(_PHP_TRIM))
    if m is None or indent <= 0:
        return 0
    margin = float(m[1])
    rounded = int(abs(margin) + 0.5) * (1 if margin >= 0 else -1)  # halves away from zero
    return max(0, rounded // indent)


def list_start(attrs: dict[str, str]) -> int:
    """The number before that of the first item."""
    m = re.fullmatch(r"-?[0-9]+", attrs.get("start", "").strip(_PHP_TRIM))
    return int(m[0]) - 1 if m else 0


def heading_level(tag: str) -> int:
    return int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456789" else 0


# -- wrapping

_LINK_IN_TEXT = re.compile(T.LINK_IN_TEXT)
_ITEM = re.compile(r"\d+\.\s|[-*+]\s", re.ASCII)


def keeps_line(line: str, wrap_links: bool, wrap_list_items: bool, wrap_tables: bool) -> bool:
    """Is a line left as it is by the wrapping?"""
    if not wrap_links and _LINK_IN_TEXT.search(line):
        return True
    if line.startswith(("    ", "\t")):
        return True
    bare = line.lstrip(_PHP_TRIM)
    if bare[:2] == "--" and len(bare) > 2 and bare[2] != "-":
        return False
    if bare[:1] == "-" or bare[:1] == "*" and bare[:2] != "**":
        return not wrap_list_items
    if not wrap_tables and " | " in line:
        return True
    return _ITEM.match(bare) is not None


def graphemes(text: str) -> list[str]:
    """User-perceived characters; without the module regex near enough: marks, joiners and modifiers stay with what they follow."""
    if text.isascii():
        return list(text)
    text = unicodedata.normalize("NFC", text)
    if regex is not None:
        return regex.findall(r"\X", text)
    out: list[str] = []
    for c in text:
        joined = out and (unicodedata.category(c) in ("Mn", "Me", "Mc") or c in "\u200d\ufe0f" or "\U0001f3fb" <= c <= "\U0001f3ff" or out[-1].endswith("\u200d"))
        if joined:
            out[-1] += c
        else:
            out.append(c)
    return out


def wrap(text: str, width: int = 75, cut: bool = False) -> list[str]:
    """Greedy lines of at most ``width`` characters, broken at spaces and after inner hyphens.

    Long words stay whole, unless ``cut``; a hyphen stays at the end of its line, which
    may then be one character longer.
    """
    if width <= 0:
        return [text]
    out: list[str] = []
    for line in text.split("\n"):
        chars = graphemes(line)
        if len(chars) <= width:
            out.append("".join(chars))
            continue
        word = [c[0].isalpha() or c[0].isnumeric() for c in chars]
        begin, space = 0, 0  # of the line; the last place where it may break
        for i, c in enumerate(chars):
            breaks = c == " " or c == "-" and 0 < i < len(chars) - 1 and word[i - 1] and word[i + 1]
            if breaks:
                if i - begin >= width:
                    out.append("".join(chars[begin : i + (c == "-")]))
                    begin = i + 1
                space = i
            elif i - begin >= width and begin < space:
                out.append("".join(chars[begin : space + (chars[space] == "-")]))
                begin = space = space + 1
            elif cut and i - begin >= width:
                out.append("".join(chars[begin:i]))
                begin = space = i
        out.append("".join(chars[begin:]))
    return out


def align_table(lines: list[str], margin: int = 1) -> list[str]:
    """Pad the cells of pipe-separated lines to the width of their column."""
    rows = [[c.rstrip(_PHP_TRIM) for c in line.split("|")] for line in lines]
    width: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            if i == len(width):
                width.append(0)
            width[i] = max(width[i], len(cell) + margin)
    out = []
    for line, row in zip(lines, rows, strict=True):
        bare = line.strip(_PHP_TRIM)
        fill = "-" if bare and not bare.strip("-|") else " "
        out.append(f"|{fill}" + "|".join(cell + fill * (width[i] - len(cell)) for i, cell in enumerate(row)) + "|")
    return out


TABLE_MARK = "table"  # a line with it opens or closes a table to be aligned


def align_tables(text: str, margin: int = 1, mark: str = TABLE_MARK) -> str:
    """Align the lines between marks; a table that is not closed ends with the text."""
    out: list[str] = []
    table: list[str] | None = None
    for line in text.split("\n"):
        if mark in line:
            if table is None:
                table = []
            else:
                out += [*align_table(table, margin), ""]
                table = None
        elif table is None:
            out.append(line)
        else:
            table.append(line)
    return "\n".join(out + (align_table(table, margin) if table else []))
