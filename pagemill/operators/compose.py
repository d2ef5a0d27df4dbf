"""From an HTML tree to the pieces of a Markdown document (layout.py writes them).

Each element has a rule: a generator that adds the pieces of its start, yields while
the content is composed, and then adds those of its end.  What a rule must know at
the end it keeps in its own variables; the composer holds what crosses elements.  The
yield gives back whether the source had an end tag.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Generator
from dataclasses import dataclass, field

from pagemill.functions import text as X
from pagemill.functions.tables import ABSOLUTE_URL
from pagemill.operators import html_tree
from pagemill.operators.layout import NOTE, REQUESTS, Piece, Place
from pagemill.options import DEFAULTS, Options

_ABSOLUTE = re.compile(ABSOLUTE_URL)
_FIRST = re.compile(r"[^\[\](){}\s.!?]")
_TRIM = " \t\n\r\0\v"
_PUNCTUATION = frozenset("!\"#%&'()*,-./:;?@[\\]_{}")
_BLANK = frozenset(" \t\n\r\f\v")
# A link's bracket is not written for these: the text that follows decides.
_BEFORE_BRACKET = frozenset("p div style dl dt".split())
Attributes = dict[str, str]
Work = Generator[None, bool, None]


@dataclass
class Element:
    tag: str
    attrs: Attributes
    style: X.Style = field(default_factory=dict)
    parent: X.Style = field(default_factory=dict)  # the style around it


@dataclass
class List:
    kind: str
    number: int


class Composer:
    """Collects the pieces of one document."""

    def __init__(self, options: Options = DEFAULTS):
        self.o = options
        self.pieces: list[Piece] = []
        self.abbreviations: list[tuple[list[Piece], str]] = []
        self.tag = ""
        self.open: list[list[Work]] = []  # the work left for the end of each open element
        self.quiet = self.in_style = self.quotes = self.link_depth = 0
        self.in_code = self.in_pre = self.in_heading = self.in_quotation = False
        self.indent = ""
        self.said = ""  # the text composed last
        self.stress = ""  # "opened" after the mark of an emphasis, "begun" after its first text
        self.due: str | None = None  # the address of a link whose bracket is still to come
        self.bare = False  # nothing of that link has been written
        self.lists: list[List] = []
        self.after_list = False
        self.short: list[Piece] | None = None  # what an abbreviation consists of
        self.styles: list[X.Style] = []
        self.sheet: dict[str, X.Style] = {}
        self.emphasised = self.expecting = 0  # open emphasis by style; marks that wait for text
        self.head_row = self.next_cell = False
        self.cells = 0

    # -- pieces

    def ask(self, request: str) -> None:
        self.pieces.append(Piece(request))

    def write(self, text: str, kind: str = "mark", link: Attributes | None = None) -> None:
        if self.short is not None:
            self.short.append(Piece(kind, text, link=link))
        if self.quiet:
            if link is not None:
                self.pieces.append(Piece("unseen", link=link))
            return
        if self.o.google_doc and self.expecting:
            bare = text.lstrip(_TRIM)
            if not (self.in_pre or self.in_code):
                text = bare
            if bare:
                self.expecting = 0
        self.pieces.append(Piece(kind, text, Place(self.quotes, self.indent, self.in_pre), link))

    def bracket(self) -> None:
        self.write("[")
        self.due, self.bare = None, False

    def bracket_last(self) -> int | None:
        """The place of the last piece that is not blank, if that is a bracket."""
        for i in range(len(self.pieces) - 1, -1, -1):
            p = self.pieces[i]
            blank = p.kind in REQUESTS or p.kind != "stop" and not (p.text.strip(" \t\n\r\f\v") if p.kind == "text" and not p.place.code else p.text)
            if not blank:
                return i if p.text == "[" else None
        return None

    # -- the tree

    def start(self, tag: str, attrs: Attributes) -> None:
        self.tag = tag
        if self._swallowed(tag, attrs, True):
            self.open.append([])
            return
        if self.due is not None and tag not in _BEFORE_BRACKET and (tag != "img" or self.o.ignore_images):
            self.bracket()
        e = Element(tag, attrs)
        work: list[Work] = []
        if self.o.google_doc:
            e.parent = self.styles[-1] if self.styles else {}
            e.style = X.element_style(attrs, self.sheet, e.parent)
            work.append(_styled(self, e))
        heading = X.heading_level(tag)
        rule = RULES.get(tag)
        if heading:
            work.append(_heading(self, heading))
        if rule and tag in _OUTSIDE_STYLE:
            work.append(rule(self, e))
        if self.o.google_doc:
            work.append(_style_marks(self, e))
        if rule and tag not in _OUTSIDE_STYLE:
            work.append(rule(self, e))
        self.open.append([w for w in work if next(w, w) is not w])
        self.after_list = tag in ("ol", "ul")

    def end(self, tag: str, explicit: bool = True) -> None:
        self.tag, work = tag, self.open.pop()
        if self._swallowed(tag, {}, False):
            return
        for w in work:
            try:
                w.send(explicit)
            except StopIteration as done:
                if done.value:  # the rest of the work is left out
                    return
        self.after_list = tag in ("ol", "ul")

    def _swallowed(self, tag: str, attrs: Attributes, opens: bool) -> bool:
        return self.o.tag_callback is not None and self.o.tag_callback(self, tag, attrs, opens) is True

    def text(self, segments: list[html_tree.Piece]) -> None:
        for s, is_entity in segments:
            self.push(X.entity(s, self.o.unicode_snob) if is_entity else X.plain(s), is_entity)

    def push(self, s: str, entity: bool = False) -> None:
        """Compose a segment of text."""
        if not s:
            return
        s = self._spaced(s)
        if self.in_style:
            self.sheet |= X.rules(s)
        if self.due is not None:
            if self.due == s and self.o.use_automatic_links and _ABSOLUTE.match(s):
                self.bare = False
                self.write(f"<{s}>")
                return
            self.bracket()
        if not (entity or self.in_pre or self.in_code):
            s = X.escape(s, self.o.escape_snob)
        self.said, self.bare = s, False
        self.write(s, "text")

    def _spaced(self, s: str) -> str:
        """No space just inside a mark, and one before a word that follows what is emphasised."""
        stress, self.stress = self.stress, ""
        if stress == "opened":
            self.stress = "begun"
            return s.strip(_TRIM)
        glued = stress == "begun" and _FIRST.match(s) and self.tag not in ("a", "code", "pre") and not X.heading_level(self.tag)
        return f" {s}" if glued else s


# -- rules: blocks


def _heading(c: Composer, level: int) -> Work:
    marks = "#" * level + " "
    c.in_heading = True
    at = c.bracket_last() if c.link_depth else None
    if not c.link_depth:
        c.ask("block")
        c.write(marks)
    elif at is not None and not c.quiet:  # the marks go before the link
        c.write(marks)
        *rest, shown = c.pieces[at + 1 :]
        c.pieces[at:] = [*(p for p in rest if p.kind in REQUESTS), shown, c.pieces[at]]
    yield
    c.in_heading = False
    c.ask("no line" if c.link_depth else "block")
    return True


def _paragraph(c: Composer, e: Element) -> Work:
    def edge(opens: bool) -> None:
        if c.o.google_doc:
            c.ask("block" if opens and "height" in e.style else "hard line")
        elif not (c.link_depth or c.next_cell):
            c.ask("block")

    edge(True)
    yield
    edge(False)


def _line_break(c: Composer, e: Element) -> Work:
    c.ask("no space")
    c.write("  \n> " if c.quotes > 0 else "  \n")
    yield


def _thematic_break(c: Composer, e: Element) -> Work:
    c.ask("block")
    c.write("* * *")
    c.ask("block")
    yield


def _hidden(c: Composer, e: Element) -> Work:
    c.quiet += 1
    c.in_style += e.tag == "style"
    yield
    c.quiet -= 1
    c.in_style -= e.tag == "style"


def _body(c: Composer, e: Element) -> Work:
    c.quiet = 0
    yield
    c.quiet = 0


def _blockquote(c: Composer, e: Element) -> Work:
    c.ask("block")
    c.write("> ", "quote")
    c.ask("nothing")
    c.quotes += 1
    yield
    c.quotes -= 1
    c.ask("block")


def _preformatted(c: Composer, e: Element) -> Work:
    c.in_pre = True
    c.ask("code")
    c.ask("block")
    yield
    c.in_pre = False
    c.pieces.append(Piece("stop"))
    c.ask("block")


def _definitions(c: Composer, e: Element) -> Work:
    if e.tag == "dl":
        c.ask("block")
    elif e.tag == "dd":
        c.write("    ")
    yield
    if e.tag != "dl":
        c.ask("line")


# -- rules: spans


def _stressed(c: Composer, mark: str, apart: bool) -> Work:
    if apart:
        c.said += " "
    c.write(f" {mark}" if apart else mark)
    c.stress = "opened"
    yield
    c.write(mark)


def _emphasis(c: Composer, e: Element) -> Work:
    if not c.o.ignore_emphasis:
        last = c.said[-1:]
        # A character beyond ASCII counts as a letter here, whatever it is.
        yield from _stressed(c, c.o.emphasis_mark, bool(last) and last not in _BLANK and last not in _PUNCTUATION)


def _strong(c: Composer, e: Element) -> Work:
    if not c.o.ignore_emphasis:
        mark = c.o.strong_mark
        yield from _stressed(c, mark, mark != "" and c.said.endswith(mark[:1]))


def _struck(c: Composer, e: Element) -> Work:
    yield from _stressed(c, "~~", c.said.endswith("~"))


def _code(c: Composer, e: Element) -> Work:
    def switch() -> None:
        if not c.in_pre:
            c.write("`")
            c.in_code = not c.in_code

    switch()
    yield
    switch()


def _abbreviation(c: Composer, e: Element) -> Work:
    c.short = []
    yield
    if "title" in e.attrs and c.short is not None:
        c.abbreviations.append((c.short, e.attrs["title"]))
    c.short = None


def _quotation(c: Composer, e: Element) -> Work:
    def switch() -> None:
        c.write(c.o.close_quote if c.in_quotation else c.o.open_quote)
        c.in_quotation = not c.in_quotation

    switch()
    yield
    switch()


def _raised(c: Composer, e: Element) -> Work:
    if c.o.include_sup_sub:
        c.write(f"<{e.tag}>")
        yield
        c.write(f"</{e.tag}>")


# -- rules: links and images


def _anchor(c: Composer, e: Element) -> Work:
    o, href = c.o, e.attrs.get("href")
    if o.ignore_anchors:
        return
    shown = href is not None and not (o.skip_internal_links and href.startswith("#")) and not (o.ignore_mailto_links and href.startswith("mailto:"))
    link = e.attrs | {"href": f"<{href}>" if o.protect_links else href} if shown else {}
    c.link_depth += 1
    if shown:
        c.due, c.bare = link["href"], True
    yield
    c.link_depth -= 1
    if c.due is not None and not c.bare:  # written as an automatic link
        c.due = None
    elif shown:
        if c.bare:
            c.bracket()
        if o.inline_links:
            c.ask("no line")
            title = X.escape_link(link.get("title", ""))
            shown_title = f' "{title}"' if title.strip() else ""
            c.write(f"]({X.escape_link(X.join_url(o.base_url, link['href']))}{shown_title})")
        else:
            c.write(f"][{NOTE}]", link=link)


def _image(c: Composer, e: Element) -> Work:
    source, o = e.attrs.get("src", ""), c.o
    if source and not o.ignore_images:
        alt = e.attrs.get("alt", o.default_image_alt)
        if o.images_as_html or o.images_with_size and ("width" in e.attrs or "height" in e.attrs):
            c.write(f"<img src='{source}' ")
            for name, value in (("width", e.attrs.get("width")), ("height", e.attrs.get("height")), ("alt", alt)):
                if value:
                    c.write(f"{name}='{value}' ")
            c.write("/>")
        else:
            _as_markdown(c, e, source, X.escape_link(alt))
    yield


def _as_markdown(c: Composer, e: Element, source: str, alt: str) -> None:
    if c.due is not None and c.o.images_to_alt and alt == c.due and _ABSOLUTE.match(alt):
        c.write(f"<{alt}>")
        c.bare = False
        return
    if c.due is not None:
        c.bracket()
    if c.o.images_to_alt:
        c.write(alt)
    elif c.o.inline_links:
        c.write(f"![{alt}]")
        c.write(f"({X.escape_link(X.join_url(c.o.base_url, source))})")
    else:
        c.write(f"![{alt}]")
        c.write(f"[{NOTE}]", link=e.attrs | {"href": source})


# -- rules: lists and tables


def _list(c: Composer, e: Element) -> Work:
    if not c.lists and not c.after_list:
        c.ask("block")
    c.lists.append(List(X.list_kind(e.style) if c.o.google_doc else e.tag, X.list_start(e.attrs)))
    yield
    c.lists.pop()
    if not c.lists and not c.o.google_doc:
        c.write("\n")


def _item(c: Composer, e: Element) -> Work:
    c.ask("line")
    mine = c.lists[-1] if c.lists else List("ul", 0)
    if c.o.google_doc:
        indent, c.indent = "  " * X.nesting(e.style, c.o.google_list_indent), ""
    else:
        indent = c.indent = "  " + "".join("   " if x.kind == "ol" else "  " for x in c.lists[:-1])
    if mine.kind == "ol":
        mine.number += 1
    mark = f"{mine.number}. " if mine.kind == "ol" else f"{c.o.ul_item_mark} "
    c.write(indent)
    c.indent += "   " if mine.kind == "ol" else "  "
    c.write(mark)
    c.ask("nothing")
    yield
    c.indent = ""  # also that of an item around it
    c.ask("line")


def _table(c: Composer, e: Element) -> Work:
    def edge() -> None:
        if c.o.pad_tables:
            c.write(X.TABLE_MARK)
            c.write("  \n")

    c.head_row = True
    edge()
    yield
    if c.o.pad_tables:
        c.ask("hard line")
    edge()


def _row(c: Composer, e: Element) -> Work:
    c.cells = 0
    explicit = yield
    if explicit:  # a row without an end tag runs on
        c.next_cell = False
        c.ask("hard line")
        if c.head_row:
            if c.cells:
                c.write("|".join(["---"] * c.cells))
            c.ask("hard line")
        c.head_row = False


def _cell(c: Composer, e: Element) -> Work:
    if c.next_cell:
        c.write("| ")
    c.next_cell = True
    c.cells += 1
    yield


def _of_table(c: Composer, e: Element) -> Work:
    """An element of a table: its tags are left out, kept as they are, or become Markdown."""
    if c.o.ignore_tables:
        yield
        if e.tag == "tr":
            c.ask("hard line")
    elif c.o.bypass_tables:
        cell = e.tag in ("td", "th")
        c.ask("hard line")
        c.write(f"<{e.tag}>" + "\n\n" * cell)
        yield
        c.write("\n" * cell + f"</{e.tag}>")
    else:
        yield from {"table": _table, "tr": _row}.get(e.tag, _cell)(c, e)


# -- styled documents


def _styled(c: Composer, e: Element) -> Work:
    c.styles.append(e.style)
    yield
    c.styles.pop()


def _style_marks(c: Composer, e: Element) -> Work:
    if c.in_heading:
        return
    mine, above = X.emphasis_of(e.style), X.emphasis_of(e.parent)
    struck = "line-through" in mine and c.o.hide_strikethrough
    italic = "italic" in mine and "italic" not in above
    bold = any(v in mine and v not in above for v in c.o.bold_text_style_values)
    fixed = X.fixed_width(e.style) and not X.fixed_width(e.parent)
    marks = [mark for on, mark in ((italic, c.o.emphasis_mark), (bold, c.o.strong_mark), (fixed and not c.in_pre, "`")) if on]
    c.emphasised += bool(marks)
    c.quiet += struck
    for mark in marks:
        c.write(mark)
        c.expecting += 1
    c.in_code |= fixed and not c.in_pre
    yield
    if c.in_heading:
        return
    if fixed and c.in_pre:
        marks = marks[:-1] if marks and marks[-1] == "`" else marks
    if marks:
        c.emphasised -= 1
        c.ask("no space")
    for mark in reversed(marks):
        if c.expecting:  # nothing was emphasised
            c.expecting -= 1
        else:
            c.write(mark)
        c.in_code &= mark != "`"
    if (bold or italic) and not c.emphasised:
        c.write(" ")
    c.quiet -= struck


Rule = Callable[[Composer, Element], Work]
RULES: dict[str, Rule] = {
    tag: rule
    for tags, rule in {
        "p div": _paragraph, "br": _line_break, "hr": _thematic_break, "head style script": _hidden, "body": _body, "blockquote": _blockquote, "pre": _preformatted, "dl dt dd": _definitions,
        "em i u": _emphasis, "strong b": _strong, "del strike s": _struck, "kbd code tt": _code, "abbr": _abbreviation, "q": _quotation, "sup sub": _raised,
        "a": _anchor, "img": _image, "ol ul": _list, "li": _item, "table tr td th": _of_table,
    }.items()
    for tag in tags.split()
}
# Their pieces come outside the marks that their style asks for at the start, and before these at the end.
_OUTSIDE_STYLE = frozenset("p div br hr head style script body blockquote em i u strong b del strike s".split())


def compose(source: str, options: Options) -> Composer:
    """The pieces of an HTML text."""
    c = Composer(options)
    decoded = lambda pieces: "".join(X.entity(s, options.unicode_snob) if e else X.plain(s) for s, e in pieces)
    for kind, tag, more in html_tree.events(html_tree.parse(source)):
        if kind == "text":
            c.text(more)
        elif kind == "end":
            c.end(tag, more)
        else:
            c.start(tag, {k: decoded(v) for k, v in more.items()})
    return c
