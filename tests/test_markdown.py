"""Conversion: golden cases of our own, one or more per rule, and properties."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions import text as X
from pagemill.operators import html_tree
from pagemill.operators.writer import convert
from pagemill.options import Options
from pagemill.plans.golden import CASES

@pytest.mark.parametrize(("html", "options", "want"), [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_golden(html, options, want):
    assert convert(html, Options(**options)).strip("\n").rstrip() == want


def test_exact_ends():
    assert convert("<p>Hi <b>x</b> y</p><ul><li>a</li></ul>") == "Hi **x** y\n\n  * a\n\n"
    assert convert(None) is None
    assert convert(" \n") == ""


def test_callback_swallows_tags_not_text():
    hook = lambda w, tag, attrs, opens: tag == "b"
    assert convert("<b>a</b><i>b</i>", Options(tag_callback=hook)).strip() == "a _b_"
    # An element whose start is swallowed has no end either.
    start = lambda w, tag, attrs, opens: tag == "blockquote" and opens
    assert convert("<blockquote>a</blockquote><p>b", Options(tag_callback=start, body_width=0)).strip() == "a\n\nb"


def test_invalid_base_raises():
    with pytest.raises(ValueError, match="invalid base"):
        convert("<a href='x'>a</a>", Options(base_url="://bad base"))


def test_options_by_name():
    o = Options.from_names({"bodyWidth": "0", "unicodeSnob": "true", "boldTextStyleValues": "a, b", "ul_item_mark": "-"})
    assert (o.body_width, o.unicode_snob, o.bold_text_style_values, o.ul_item_mark) == (0, True, ("a", "b"), "-")
    with pytest.raises(ValueError, match="no such option"):
        Options.from_names({"nope": "1"})
    with pytest.raises(TypeError):
        Options(body_width="3")


soup = st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<a href='/x'>", "</a>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<pre>", "</pre>", "<h2>", "</h2>", "<i>", "</i>", "<br>", "<q>", "&copy;", "&#160;", "text ", "a-b", "<!--", "-->", "<div>", "</div>", "<blockquote>", "</blockquote>", "<style>", "</style>", "<img src=x>", "|", "*"]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(soup | st.text(max_size=60))
def test_never_raises(html):
    for o in (Options(), Options(inline_links=False, pad_tables=True, google_doc=True, backquote_code_style=True)):
        assert isinstance(convert(html, o), str)


@settings(max_examples=100, deadline=None)
@given(soup)
def test_trees_are_sound(html):
    open_tags, seen = [], 0
    for kind, tag, _ in html_tree.events(html_tree.parse(html)):
        if kind == "start":
            open_tags.append(tag)
        elif kind == "end":
            assert open_tags.pop() == tag
        seen += 1
    assert not open_tags
    assert seen >= 4


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab -é", max_size=80), st.integers(1, 12))
def test_wrap_loses_nothing(text, width):
    lines = X.wrap(text, width)
    assert "".join(lines).replace(" ", "") == text.replace(" ", "")
    for line in lines[:-1]:
        assert len(line) <= width or " " not in line.strip() or line.endswith("-")


def test_deep_nesting():
    assert "x" in convert("<div>" * 5000 + "x")
