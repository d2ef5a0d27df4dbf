"""Conversion of one HTML text to Markdown: composed, laid out, wrapped."""

from __future__ import annotations

import re

from pagemill.functions import text as X
from pagemill.operators.compose import compose
from pagemill.operators.layout import Layout, Piece
from pagemill.options import DEFAULTS, Options

_SPACE_PLUS = re.compile(r"[ \t\n\r\f\v]\+")  # lines with it are lost with the option compat


def _wrapped(text: str, o: Options) -> str:
    if not o.body_width:
        return X.align_tables(text) if o.pad_tables else text
    out: list[str] = []
    blank, fenced = 0, False
    for line in text.split("\n"):
        if o.backquote_code_style and line.lstrip().startswith("```"):
            fenced = not fenced
        if fenced:
            out.append(line + "\n")
            blank = 1
        elif not line:
            if blank < 2:
                out.append("\n")
                blank += 1
        elif X.keeps_line(line, o.wrap_links, o.wrap_list_items, o.wrap_tables):
            if o.compat and _SPACE_PLUS.search(line):
                continue
            out.append(line + "\n")
            blank = 1
        else:
            indent = "    " if line.startswith("  " + o.ul_item_mark) else "> " if line.startswith("> ") else ""
            hard = line.endswith("  ")
            lines = [x.rstrip(" \t") for x in X.wrap(line, o.body_width)]
            body = lines[0] + "".join("\n" + indent + x for x in lines[1:]) + ("  " if hard else "")
            blank = 1 if hard or indent else 2
            out.append(body + "\n" * blank)
    text = "".join(out)
    return X.align_tables(text) if o.pad_tables else text


def convert(source: str | None, options: Options = DEFAULTS) -> str | None:
    """The Markdown of an HTML text; null stays null."""
    if source is None:
        return None
    source = source.strip(" \t\n\r\0\v")
    if not source:
        return ""
    c, layout = compose(source, options), Layout(options)
    for piece in [*c.pieces, Piece("line")]:
        layout.add(piece)
    return _wrapped(layout.end(c.abbreviations).replace(X.NBSP, "\u00a0" if options.unicode_snob else " "), options)
