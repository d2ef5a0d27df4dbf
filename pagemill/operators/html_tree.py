"""From HTML text to a tree, by the tree-construction rules of the HTML standard.

The subset: implied html, head and body; optional end tags; reopened formatting
elements with the adoption agency and the cap of three equal ones; table content and foster parenting; raw text elements.  Unlike a browser's, an anchor may hold an anchor, as in the
source: Markdown can show it.  Entities
that end in a semicolon are kept apart from the text around them, since the writer
escapes text but not what stood as an entity.  Nothing here raises on any input.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

Piece = tuple[str, bool]  # a run of a text; whether it is an entity (then "&...;" as it stands)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea plaintext".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title noframes style script template noscript".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = frozenset("address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = frozenset("caption col colgroup tbody tfoot thead tr td th".split())
SECTIONS = frozenset("tbody tfoot thead".split())

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)|</[^a-zA-Z>][^>]*>?|</>|<([a-zA-Z][^\s/>]*)", re.DOTALL)
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?)")
ENTITY = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]+));")
_BARE = re.compile(r"&[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9=;])")


class Node:
    """An element; children are nodes and lists of pieces (a text)."""

    __slots__ = ("attrs", "children", "explicit", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, list[Piece]] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None
        self.explicit = False  # ended by its own end tag

    def append(self, child: Node | list[Piece]) -> None:
        self.insert(len(self.children), child)

    def insert(self, at: int, child: Node | list[Piece]) -> None:
        if isinstance(child, Node):
            if child.parent is not None:
                child.parent.children.remove(child)
            child.parent = self
        elif at and isinstance(self.children[at - 1], list):
            self.children[at - 1].extend(child)
            return
        self.children.insert(at, child)

    def copy(self) -> Node:
        return Node(self.tag, self.attrs)

    def __eq__(self, other: object) -> bool:
        return self is other

    __hash__ = object.__hash__


def pieces(text: str, attribute: bool = False) -> list[Piece]:
    """Cut at entities that end in a semicolon; bare ones are decoded as HTML does."""
    out, last = [], 0
    for m in ENTITY.finditer(text):
        if m.start() > last:
            out.append((_bare(text[last : m.start()], attribute), False))
        out.append((m[0], True))
        last = m.end()
    if last < len(text):
        out.append((_bare(text[last:], attribute), False))
    return out


def _bare(text: str, attribute: bool) -> str:
    if "&" not in text:
        return text
    return _BARE.sub(lambda m: html.unescape(m[0]), text) if attribute else html.unescape(text)


def tokens(source: str) -> Iterator[tuple[str, str, object]]:
    """("text", text, None), ("open", tag, (attributes, self-closing)) and ("close", tag, None)."""
    source = source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    at, n = 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            yield "text", source[at:], None
            return
        if m.start() > at:
            yield "text", source[at : m.start()], None
        at = m.end()
        name = m[1] or m[2]
        if not name:
            continue
        attrs: dict[str, list[Piece]] = {}
        closed = False
        while at < n:
            a = _ATTRIBUTE.match(source, at)
            if a is None:
                at = n
                break
            if a[1]:
                closed = source[a.start() : a.end()].rstrip(">").endswith("/")
                at = a.end()
                break
            at = max(a.end(), at + 1)
            value = next((v for v in (a[3], a[4], a[5]) if v is not None), "")
            attrs.setdefault(a[2].lower(), pieces(value, attribute=True))
        else:
            return  # a tag that never ends is dropped
        name = name.lower()
        if m[1]:
            yield "close", name, None
            continue
        yield "open", name, (attrs, closed)
        if name in RAW and not closed:
            end = None if name == "plaintext" else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(source, at)
            stop = end.start() if end else n
            if stop > at:
                yield "raw", source[at:stop], name
            at = stop


class Builder:
    """Feeds tokens into a tree. ``root`` is the html element."""

    def __init__(self):
        self.root, self.head, self.body = Node("html"), None, None
        self.open = [self.root]
        self.active: list[Node | None] = []  # None is a marker
        self.foster = False
        self.after_head = False
        self.skip_newline = False

    # -- stack

    def _in_scope(self, tags: frozenset[str] | set[str], extra: frozenset[str] = frozenset()) -> bool:
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if node.tag in SCOPE or node.tag in extra:
                return False
        return False

    def _in_table(self, *tags: str) -> bool:
        """Is one of the tags open since the innermost table (or the table itself)?"""
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if node.tag in ("html", "table", "template"):
                return False
        return False

    def _pop_to(self, tags: frozenset[str] | set[str]) -> None:
        while len(self.open) > 1:
            if self.open.pop().tag in tags:
                return

    def _imply(self, but: str = "") -> None:
        while self.open[-1].tag in IMPLIED_END and self.open[-1].tag != but:
            self.open.pop()

    def _close_p(self) -> None:
        if self._in_scope({"p"}, frozenset({"button"})):
            self._imply("p")
            self._pop_to({"p"})

    def _place(self) -> tuple[Node, int]:
        """Where the next node goes: under foster parenting, before the table."""
        now = self.open[-1]
        if self.foster and now.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag == "table":
                    table = self.open[i]
                    if table.parent is not None:
                        return table.parent, table.parent.children.index(table)
                    return self.open[i - 1], len(self.open[i - 1].children)
        return now, len(now.children)

    def _element(self, tag: str, attrs: dict | None = None, push: bool = True) -> Node:
        node = Node(tag, attrs)
        parent, at = self._place()
        parent.insert(at, node)
        if push:
            self.open.append(node)
        return node

    # -- formatting

    def _format(self, node: Node) -> None:
        same = 0
        for i in range(len(self.active) - 1, -1, -1):
            other = self.active[i]
            if other is None:
                break
            if other.tag == node.tag and other.attrs == node.attrs:
                same += 1
                if same == 3:
                    del self.active[i]
                    break
        self.active.append(node)

    def _reopen(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.open:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and self.active[i - 1] not in self.open:
            i -= 1
        for k in range(i, len(self.active)):
            self.active[k] = self._element(self.active[k].tag, self.active[k].attrs)

    def _adopt(self, tag: str) -> None:
        if self.open[-1].tag == tag and self.open[-1] not in self.active:
            self.open.pop()
            return
        for _ in range(8):
            wanted = None
            for node in reversed(self.active):
                if node is None:
                    break
                if node.tag == tag:
                    wanted = node
                    break
            if wanted is None:
                self._end_other(tag)
                return
            if wanted not in self.open:
                self.active.remove(wanted)
                return
            place = self.open.index(wanted)
            if any(n.tag in SCOPE for n in self.open[place + 1 :]):
                return
            block = next((n for n in self.open[place + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                del self.open[place:]
                self.active.remove(wanted)
                return
            ancestor = self.open[place - 1]
            mark = self.active.index(wanted)
            last, i = block, self.open.index(block)
            count = 0
            while True:
                count += 1
                i -= 1
                node = self.open[i]
                if node is wanted:
                    break
                if count > 3 and node in self.active:
                    if self.active.index(node) < mark:
                        mark -= 1
                    self.active.remove(node)
                if node not in self.active:
                    del self.open[i]
                    continue
                fresh = node.copy()
                self.active[self.active.index(node)] = fresh
                self.open[i] = fresh
                if last is block:
                    mark = self.active.index(fresh) + 1
                fresh.append(last)
                last = fresh
            if ancestor.tag in ("table", "tbody", "tfoot", "thead", "tr"):
                was, self.foster = self.foster, True
                stack, self.open = self.open, self.open[: place]
                parent, at = self._place()
                self.open, self.foster = stack, was
                parent.insert(at, last)
            else:
                ancestor.append(last)
            fresh = wanted.copy()
            for child in list(block.children):
                if isinstance(child, Node):
                    fresh.append(child)
                else:
                    block.children.remove(child)
                    fresh.append(child)
            block.append(fresh)
            old = self.active.index(wanted)
            del self.active[old]
            self.active.insert(mark - (old < mark), fresh)
            self.open.remove(wanted)
            self.open.insert(self.open.index(block) + 1, fresh)

    # -- tokens

    def _into_body(self) -> None:
        if self.body is None:
            if self.head is None:
                self._start_head()
            self._end_head()
            self.body = Node("body")
            self.root.append(self.body)
            self.open = [self.root, self.body]

    def _start_head(self, attrs: dict | None = None) -> None:
        self.head = Node("head", attrs)
        self.root.append(self.head)
        self.open = [self.root, self.head]

    def _end_head(self) -> None:
        self.after_head = True
        self.open = [self.root]

    def text(self, data: str, raw: bool = False) -> None:
        if not data:
            return
        if raw:
            self.open[-1].append([(data, False)] if self.open[-1].tag in ("script", "style", "xmp", "iframe", "noembed", "noframes", "plaintext") else pieces(data))
            return
        if self.body is None:
            stripped = data.lstrip(" \t\n\f")
            if not stripped:
                return
            data = stripped
            self._into_body()
        if self.skip_newline:
            self.skip_newline = False
            data = data.removeprefix("\n")
            if not data:
                return
        now = self.open[-1].tag
        in_table = now in ("table", "tbody", "tfoot", "thead", "tr")
        if now == "colgroup" and data.strip(" \t\n\f"):
            self.open.pop()
            in_table = True
        if in_table and not data.strip(" \t\n\f"):
            self.open[-1].append([(data, False)])
            return
        self.foster = in_table
        self._reopen()
        parent, at = self._place()
        parent.insert(at, pieces(data))
        self.foster = False

    def start(self, tag: str, attrs: dict, closed: bool) -> None:
        self.skip_newline = False
        if tag == "html":
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if self.body is None:
            if tag == "head":
                if self.head is None:
                    self._start_head(attrs)
                return
            if tag in HEAD_ONLY and not (tag == "noscript" and self.after_head):
                if self.head is None:
                    self._start_head()
                holder = self.head
                if tag == "noscript":
                    self.open = [self.root, holder]
                elif self.open[-1].tag not in ("head", "noscript"):
                    self.open = [self.root, holder]
                self._element(tag, attrs, push=tag not in VOID)
                return
            if tag == "body":
                if self.head is None:
                    self._start_head()
                self._end_head()
                self.body = Node("body", attrs)
                self.root.append(self.body)
                self.open = [self.root, self.body]
                return
            self._into_body()
        elif tag == "body":
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)
            return
        elif tag == "head":
            return
        if self._table(tag, attrs):
            return
        now = self.open[-1].tag
        self.foster = now in ("table", "tbody", "tfoot", "thead", "tr")
        self._body(tag, attrs)
        self.foster = False

    def _clear_to(self, tags: set[str]) -> None:
        while self.open[-1].tag not in tags and len(self.open) > 1:
            self.open.pop()

    def _close_cell(self) -> None:
        self._imply()
        self._pop_to({"td", "th"})
        self._unmark()

    def _unmark(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def _table(self, tag: str, attrs: dict) -> bool:
        """Start tags that belong to tables; False if it is for the body."""
        inside = self._in_table("table")
        if tag == "table":
            if self.open[-1].tag in ("table", "tbody", "tfoot", "thead", "tr"):
                self._pop_to({"table"})
            return False
        if tag not in TABLE_PARTS:
            return False
        if not inside:
            return True  # ignored outside a table
        if self._in_table("caption"):
            self._imply()
            self._pop_to({"caption"})
            self._unmark()
        if self._in_table("td", "th"):
            self._close_cell()
        if tag in ("caption", "colgroup", "col") or tag in SECTIONS:
            self._clear_to({"table", "html", "template"} | ({"colgroup"} if tag == "col" else set()))
            if tag == "col":
                if self.open[-1].tag != "colgroup":
                    self._element("colgroup")
                self._element(tag, attrs, push=False)
                return True
            self._element(tag, attrs)
            if tag == "caption":
                self.active.append(None)
            return True
        if tag == "tr":
            self._clear_to({"tbody", "tfoot", "thead", "table", "html"})
            if self.open[-1].tag == "table":
                self._element("tbody")
            self._element(tag, attrs)
            return True
        self._clear_to({"tr", "tbody", "tfoot", "thead", "table", "html"})
        if self.open[-1].tag == "table":
            self._element("tbody")
        if self.open[-1].tag != "tr":
            self._element("tr")
        self._element(tag, attrs)
        self.active.append(None)
        return True

    def _body(self, tag: str, attrs: dict) -> None:
        if tag in CLOSES_P:
            self._close_p()
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self.open.pop()
            self._element(tag, attrs, push=tag not in VOID)
            self.skip_newline = tag in ("pre", "listing")
        elif tag in ("li", "dd", "dt"):
            same = {"li"} if tag == "li" else {"dd", "dt"}
            for node in reversed(self.open):
                if node.tag in same:
                    self._imply(node.tag)
                    self._pop_to({node.tag})
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self._close_p()
            self._element(tag, attrs)
        elif tag == "nobr":
            self._reopen()
            if self._in_scope({"nobr"}):
                self._adopt("nobr")
                self._reopen()
            self._format(self._element(tag, attrs))
        elif tag in FORMATTING:
            self._reopen()
            self._format(self._element(tag, attrs))
        elif tag in ("applet", "marquee", "object"):
            self._reopen()
            self._element(tag, attrs)
            self.active.append(None)
        elif tag in ("option", "optgroup"):
            if self.open[-1].tag == "option":
                self.open.pop()
            self._reopen()
            self._element(tag, attrs)
        elif tag == "button":
            if self._in_scope({"button"}):
                self._imply()
                self._pop_to({"button"})
            self._reopen()
            self._element(tag, attrs)
        elif tag in RAW:
            if tag == "xmp":
                self._close_p()
            self._element(tag, attrs)
        elif tag == "image":
            self._body("img", attrs)
        else:
            if tag not in HEAD_ONLY and tag not in ("param", "source", "track"):
                self._reopen()
            self._element(tag, attrs, push=tag not in VOID)

    def _end_other(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            node = self.open[i]
            if node.tag == tag:
                self._imply(tag)
                del self.open[i:]
                return
            if node.tag in SPECIAL:
                return

    def end(self, tag: str) -> None:
        self.skip_newline = False
        if self.body is None:
            if tag == "head" and self.head is not None:
                self._end_head()
                return
            if self.open[-1].tag == tag and tag not in ("html", "head"):
                self.open.pop()
                return
            if tag not in ("body", "html", "br"):
                return
            self._into_body()
        if tag in ("body", "html", "head"):
            return  # what follows still goes into the body
        if tag == "br":
            self._reopen()
            self._element("br", push=False)
            return
        if tag == "table":
            if self._in_table("table"):
                if self._in_table("td", "th"):
                    self._close_cell()
                self._pop_to({"table"})
            return
        if tag in ("td", "th", "caption"):
            if self._in_table(tag):
                self._imply()
                self._pop_to({tag})
                self._unmark()
            return
        if tag in TABLE_PARTS:
            if tag != "col" and self._in_table(tag):
                if self._in_table("td", "th"):
                    self._close_cell()
                next(n for n in reversed(self.open) if n.tag == tag).explicit = True
                self._pop_to({tag})
            return
        if tag in RAW and self.open[-1].tag == tag:
            self.open.pop()
        elif tag in FORMATTING:
            self._adopt(tag)
        elif tag == "p":
            if not self._in_scope({"p"}, frozenset({"button"})):
                self._element("p")
            self._close_p()
        elif tag == "li":
            if self._in_scope({"li"}, frozenset({"ol", "ul"})):
                self._imply("li")
                self._pop_to({"li"})
        elif tag in ("dd", "dt"):
            if self._in_scope({tag}):
                self._imply(tag)
                self._pop_to({tag})
        elif tag in HEADINGS:
            if self._in_scope(HEADINGS):
                self._imply()
                self._pop_to(HEADINGS)
        elif tag in ("applet", "marquee", "object"):
            if self._in_scope({tag}):
                self._imply()
                self._pop_to({tag})
                self._unmark()
        elif tag in CLOSES_P or tag == "button":
            if self._in_scope({tag}):
                self._imply()
                self._pop_to({tag})
        else:
            self._end_other(tag)


def parse(source: str) -> Node:
    """The html element of a text."""
    b = Builder()
    for kind, value, more in tokens(source):
        if kind == "text":
            b.text(value)
        elif kind == "raw":
            b.text(value, raw=True)
        elif kind == "open":
            b.start(value, *more)
        else:
            b.end(value)
    b._into_body()
    return b.root


Event = tuple[str, str, object]  # ("start", tag, attributes), ("end", tag, whether by its own tag), ("text", "", pieces)


def events(root: Node) -> Iterator[Event]:
    """The tree in document order; without recursion, so that depth has no limit."""
    stack: list[tuple[Node, int]] = [(root, 0)]
    yield "start", root.tag, root.attrs
    while stack:
        node, i = stack.pop()
        if i == len(node.children):
            yield "end", node.tag, node.explicit
            continue
        stack.append((node, i + 1))
        child = node.children[i]
        if isinstance(child, Node):
            yield "start", child.tag, child.attrs
            stack.append((child, 0))
        else:
            yield "text", "", child
