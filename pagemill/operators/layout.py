"""From a sequence of pieces to Markdown.

A document is composed (compose.py) as pieces of output and, between them, requests:
for a line or a block, for a space, or to do without.  All requests between two
pieces make up their joint, and what is written there follows from the joint, the
end of what stands before, and the place of the piece that comes: how deep in
quotations it is, how far its list item is indented, whether it is code.  References
are numbered here, in the order in which they are written, and their notes follow
where they are due.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

from pagemill.functions import text as X
from pagemill.options import Options

_SPACES = re.compile(r"[ \t\n\r\f\v]+")
NOTE = "\0note"  # in a piece's text, where the number of its reference goes


class Place(NamedTuple):
    """Where a piece stands."""

    quotes: int = 0
    indent: str = ""
    code: bool = False


class Piece(NamedTuple):
    """``kind``: text (its white space collapses), mark (as it is), quote (opens a quotation), stop (ends code), unseen (a reference that is numbered only), or a request."""

    kind: str
    text: str = ""
    place: Place = Place()
    link: dict[str, str] | None = None


REQUESTS = frozenset(["block", "line", "hard line", "no line", "no space", "nothing", "code"])


@dataclass
class Joint:
    """What is asked for between two pieces."""

    lines: int = 0
    hard: bool = False
    space: bool = False
    nothing: bool = False  # that is, of what was asked for before the next piece
    code: bool = False  # a block of code opens

    def ask(self, request: str, block: int) -> None:
        if request == "block":
            self.lines = block
        elif request in ("line", "hard line"):
            self.lines = max(self.lines, 1)
            self.hard |= request == "hard line"
        elif request == "no line":
            self.lines = 0
        elif request == "no space":
            self.space = False
        else:
            setattr(self, request, True)

    def after(self) -> Joint:
        """What is still asked for when a piece has been written: a hard line waits for the next line."""
        return Joint(hard=self.hard and not self.lines)


@dataclass
class Note:
    number: int
    link: dict[str, str]
    after: int  # pieces written before its reference


@dataclass
class Layout:
    """Writes pieces, one after the other."""

    o: Options
    out: list[str] = field(default_factory=list)
    joint: Joint = field(default_factory=lambda: Joint(nothing=True))
    written: int = 0
    notes: list[Note] = field(default_factory=list)
    numbered: int = 0
    number_of: dict[int, int] = field(default_factory=dict)  # of each reference, by its identity
    code_margin: str = ""

    def add(self, p: Piece) -> None:
        if p.link is not None:
            p = p._replace(text=p.text.replace(NOTE, str(self._number(p.link))))
        if p.kind in REQUESTS:
            if p.kind == "code":
                self.code_margin = ""
            self.joint.ask(p.kind, 1 if self.o.single_line_break else 2)
        elif p.kind == "stop":
            self.out += [f"\n{self.code_margin}```"] * self.o.backquote_code_style + ["\n[/code]"] * self.o.mark_code
        else:
            text = p.text
            if p.kind == "text" and not p.place.code:
                text = _SPACES.sub(" ", text)
                self.joint.space |= text.startswith(" ")
                text = text.removeprefix(" ")
            if text and p.kind != "unseen":
                self._write(text, p)

    def _margin(self, p: Piece, text: str) -> str:
        """What each line at a place starts with."""
        quotes = ">" * p.place.quotes
        if quotes and not (p.kind == "quote" and text.startswith(">")):
            quotes += " "
        if not p.place.code:
            return quotes
        return quotes + p.place.indent + ("" if self.o.backquote_code_style else "    ")

    def _write(self, text: str, p: Piece) -> None:
        joint, margin = self.joint, self._margin(p, text)
        before: list[str] = []
        if joint.code:
            text = text if text.startswith(("\n", "\r\n")) else "\n" + text
            before += ["\n[code]"] * self.o.mark_code
        if p.place.code:
            self.code_margin = margin
            text = text.replace("\n", "\n" + margin)
        if joint.code and self.o.backquote_code_style:
            before.append(f"\n{self.code_margin}```")
        elif joint.code and p.place.indent:
            text = text.removeprefix("\n" + self.code_margin)
        self.out += before
        lines = 0 if before or joint.nothing else joint.lines
        space = joint.space and not joint.nothing
        if lines:
            self.out.append((("  " if joint.hard else "") + "\n" + margin) * lines)
        elif space and not self._at_line_start():
            self.out.append(" ")
        if lines == 2 and self.o.links_each_paragraph:
            self._tell_notes()
        self.out.append(text)
        self.written += 1
        joint.lines = lines
        self.joint = joint.after()

    def _at_line_start(self) -> bool:
        return bool(self.out) and self.out[-1].endswith("\n")

    def _number(self, link: dict[str, str]) -> int:
        """That of an equal link whose note is still due, or the next."""
        same = [n.number for n in self.notes if all(n.link.get(k) == link.get(k) for k in ("href", "title"))]
        if not same:
            self.numbered += 1
            self.notes.append(Note(self.numbered, link, self.written))
        self.number_of[id(link)] = same[0] if same else self.numbered
        return self.number_of[id(link)]

    def _tell_notes(self) -> None:
        due = [n for n in self.notes if n.after < self.written]
        for n in due:
            title = n.link.get("title", "")
            shown = f" ({title})" if title.strip() else ""
            self.out.append(f"   [{n.number}]: {X.join_url(self.o.base_url, n.link.get('href', ''))}{shown}\n")
        if due:
            self.out.append("\n")
            self.notes = [n for n in self.notes if n not in due]

    def end(self, abbreviations: list[tuple[list[Piece], str]]) -> str:
        """All that was written, with notes and abbreviations after it."""
        if self.joint.code:
            self.out += ["\n[code]"] * self.o.mark_code
            self.out += [f"\n{self.code_margin}```"] * self.o.backquote_code_style
        self.out.append("\n")
        if self.notes:
            self.out.append("\n")
            self._tell_notes()
        named = {"".join(p.text if p.link is None else p.text.replace(NOTE, str(self.number_of[id(p.link)])) for p in short): long for short, long in abbreviations}
        self.out += [f"  *[{short}]: {long}\n" for short, long in named.items()]
        self.out += ["\n"] * self.joint.code
        return "".join(self.out)
