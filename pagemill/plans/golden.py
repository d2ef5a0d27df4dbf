"""Conversions with the Markdown that must come out: name, HTML, options, Markdown without ends of lines around it."""

from __future__ import annotations

CASES: list[tuple[str, str, dict, str]] = [
    # trees and white space
    ("paragraphs", "<p>One  two\n three<p>Four", {}, "One two three\n\nFour"),
    ("reopened formatting", "<p><b>a<br>x<p>b", {}, "**a  \nx**\n\n**b**"),
    ("unclosed in list", "<ul><li>a<li>b</ul>", {}, "  * a\n  * b"),
    ("comments go", "a<!-- <b>x</b> -->b", {}, "ab"),
    ("scripts and styles go", "<style>p{}</style>a<script>'</p>'</script>b", {}, "ab"),
    ("head is quiet", "<head><title>T</title></head><body>b", {}, "b"),
    ("empty", "", {}, ""),
    # entities
    ("stand-ins", "&copy; &eacute;&Eacute; &mdash; &#8217; &#x93;", {}, "(C) ee -- ' \""),
    ("unicode", "&copy; &eacute; &mdash; &#8217; &#146;", {"unicode_snob": True}, "© é — ’ ’"),
    ("non-breaking", "a&nbsp;b&#160;c", {}, "a b\u00a0c"),
    ("unknown name", "&nosuch; &amp;lt;", {}, "&nosuch; &lt;"),
    ("bad code points", "&#0;&#xD800;&#x110000;", {"unicode_snob": True}, "���"),
    # headings and blocks
    ("headings", "<h1>a</h1><h6>b</h6><h7>c</h7>", {}, "# a\n\n###### b\n\n####### c"),
    ("heading in link", "<a href='/x'><h2>t</h2></a>", {}, "## [t](/x)"),
    ("rule", "a<hr>b", {}, "a\n\n* * *\n\nb"),
    ("quote", "<blockquote>a<blockquote>b</blockquote></blockquote>", {}, "> a\n>\n\n>> b"),
    ("pre", "<pre>a\n  b</pre>c", {}, "    a\n      b\n\nc"),
    ("pre fenced", "<pre>a\nb</pre>", {"backquote_code_style": True}, "```\na\nb\n```"),
    ("pre marked", "<pre>a</pre>", {"mark_code": True}, "[code]\n\n    a\n[/code]"),
    ("single breaks", "<p>a<p>b", {"single_line_break": True, "body_width": 0}, "a\nb"),
    ("definitions", "<dl><dt>a<dd>b</dl>", {}, "a\n\n    b"),
    # spans
    ("emphasis", "x<em>a</em> <i>b</i> <u>c</u>", {}, "x _a_ _b_ _c_"),
    ("strong after star", "<b>a</b>", {"strong_mark": "__"}, "__a__"),
    ("no emphasis", "<em>a</em><b>b</b><del>c</del>", {"ignore_emphasis": True}, "ab~~c~~"),
    ("letters after a mark", "<b>a</b>b", {}, "**a** b"),
    ("code", "<code>a*b</code><kbd>c</kbd>", {}, "`a*b``c`"),
    ("quotation marks", "<q>a</q>", {"open_quote": "«", "close_quote": "»"}, "«a»"),
    ("abbreviation", "<abbr title='World'>W</abbr> x", {}, "W x\n\n  *[W]: World"),
    ("sup", "a<sup>2</sup>", {"include_sup_sub": True}, "a<sup>2</sup>"),
    ("escapes", "1. a \\* [x](y)", {}, "1\\. a \\\\* [x](y)"),
    ("all escapes", "a_b*c#", {"escape_snob": True}, "a\\_b\\*c\\#"),
    # links
    ("link", "<a href='/x' title='t'>a</a>", {}, '[a](/x "t")'),
    ("resolved", "<a href='x?q#f'>a</a>", {"base_url": "http://u:p@h:8/d/e"}, "[a](http://u:p@h:8/d/x?q#f)"),
    ("automatic", "<a href='http://a/'>http://a/</a>", {}, "<http://a/>"),
    ("not automatic", "<a href='http://a/'>http://a/</a>", {"use_automatic_links": False}, "[http://a/](http://a/)"),
    ("internal", "<a href='#x'>a</a>", {}, "a"),
    ("mail", "<a href='mailto:x'>a</a>", {"ignore_mailto_links": True}, "a"),
    ("no anchors", "<a href='/x'>a</a>", {"ignore_anchors": True}, "a"),
    ("protected", "<a href='/x y'>a</a>", {"protect_links": True}, "[a](</x y>)"),
    ("empty link", "<a href='/x'></a>", {}, "[](/x)"),
    ("references", "<a href='/x'>a</a> <a href='/y'>b</a> <a href='/x'>c</a>", {"inline_links": False}, "[a][1] [b][2] [c][1]\n\n   [1]: /x\n\n   [2]: /y"),
    ("nested links", "<a href='/x'><a href='/y'>a</a>b</a>", {"inline_links": False, "body_width": 0}, "[[a][1]b][2]\n\n   [1]: /y\n   [2]: /x"),
    ("footnotes by paragraph", "<p><a href='/x'>a</a><p>b", {"inline_links": False, "links_each_paragraph": True, "body_width": 0}, "[a][1]\n\n   [1]: /x\n\nb"),
    # images
    ("image", "<img src='/i' alt='a]'>", {}, "![a\\]](/i)"),
    ("default alt", "<img src='/i'>", {"default_image_alt": "pic"}, "![pic](/i)"),
    ("no images", "a<img src='/i'>", {"ignore_images": True}, "a"),
    ("image alt", "<img src='/i' alt='b'>", {"images_to_alt": True}, "b"),
    ("image with size", "<img src='/i' width=3 alt='b'>", {"images_with_size": True}, "<img src='/i' width='3' alt='b' />"),
    ("image html", "<img src='/i'>", {"images_as_html": True}, "<img src='/i' />"),
    ("image without source", "a<img alt='b'>", {}, "a"),
    # lists
    ("nested lists", "<ol start=3><li>a<ul><li>b</ul><li>c</ol>", {}, "  3. a\n     * b\n  4. c"),
    ("list mark", "<ul><li>a</ul>", {"ul_item_mark": "-"}, "  - a"),
    # tables
    ("table", "<table><tr><th>a<th>b</tr><tr><td>1<td>2</tr></table>", {}, "a| b  \n---|---  \n1| 2"),
    ("padded", "<table><tr><th>a<th>b</tr><tr><td>111<td>2</tr></table>", {"pad_tables": True}, "| a   | b  |\n|-----|----|\n| 111 | 2  |"),
    ("no tables", "<table><tr><td>a<td>b</tr></table>", {"ignore_tables": True}, "ab"),
    ("table tags", "<table><tr><td>a</td></tr></table>", {"bypass_tables": True, "body_width": 0}, "<table>  \n<tr>  \n<td>\n\na\n</td></tr></table>"),
    # styled documents
    ("styled", "<p style='height:1px'><span style='font-weight:700'>a</span><span style='font-style:italic'>b</span>", {"google_doc": True, "body_width": 0}, "**a** _b_"),
    ("bold values", "<span style='font-weight:600'>a</span>", {"google_doc": True, "bold_text_style_values": ("600",)}, "**a**"),
    ("struck", "a<span style='text-decoration:line-through'>b</span>", {"google_doc": True, "hide_strikethrough": True}, "a"),
    ("list levels", "<ul style='list-style-type:disc'><li style='margin-left:40px'>a</ul>", {"google_doc": True, "google_list_indent": 20, "body_width": 0}, "    * a"),
    # a second case of options that are seldom used
    ("footnotes by paragraph only when due", "<p>a<p><a href='/x'>b</a> c<p>d<p>e", {"inline_links": False, "links_each_paragraph": True, "body_width": 0}, "a\n\n[b][1] c\n\n   [1]: /x\n\nd\n\ne"),
    ("list levels of the default indent", "<ul style='list-style-type:disc'><li style='margin-left:72pt'>a</ul>", {"google_doc": True, "body_width": 0}, "    * a"),
    ("bold value that is not listed", "<span style='font-weight:700'>a</span>", {"google_doc": True, "bold_text_style_values": ("600",), "body_width": 0}, "a"),
    ("no anchors, but images", "<a href='/x'><img src='/i'></a>", {"ignore_anchors": True}, "![](/i)"),
    ("no images in links", "<a href='/x'><img src='/i'>a</a>", {"ignore_images": True}, "[a](/x)"),
    ("no emphasis nested", "<b>a<i>b</i></b>c", {"ignore_emphasis": True}, "abc"),
    ("not automatic in references", "<a href='http://a/'>http://a/</a>", {"use_automatic_links": False, "inline_links": False}, "[http://a/][1]\n\n   [1]: http://a/"),
    ("opening quotation mark", "<q>a</q> <q>b</q>", {"open_quote": "<<"}, "<<a\" <<b\""),
    ("closing quotation mark nested", "<q>a<q>b</q></q>", {"open_quote": "(", "close_quote": ")"}, "(a)b()"),
    ("lines with a plus stay", "<pre>a +b\nc</pre>d", {}, "    a +b\n    c\n\nd"),
    ("lines with a plus are lost", "<pre>a +b\nc</pre>d", {"compat": True}, "    c\n\nd"),
    ("notes of hidden references", "<head><title><a href='/x'>t</a></title></head><body><a href='/y'>a</a>", {"inline_links": False}, "[a][1]\n\n   [1]: /y"),
    ("abbreviation with a reference", "<abbr title='T'><a href='/x'>a</a></abbr>", {"inline_links": False}, "[a][1]\n\n   [1]: /x\n\n  *[[a][1]]: T"),
    ("heading later in a link", "x <a href='/x'>\n<h3>t</h3></a> y", {"body_width": 0}, "x ### [t](/x) y"),
    ("code in a quotation", "<blockquote>a<pre>b\nc</pre></blockquote>", {"body_width": 0}, "> a\n>     \n>     \n>     b\n>     c"),
    ("code in an item", "<ul><li>a<pre>b</pre><li>c</ul>", {"backquote_code_style": True, "body_width": 0}, "  * a\n    ```\n    b\n    ```\n\n  * c"),
    # wrapping
    ("wrapped", "aaa bbb ccc", {"body_width": 7}, "aaa bbb\nccc"),
    ("hyphens", "aaaa-bbbb cc", {"body_width": 6}, "aaaa-\nbbbb\ncc"),
    ("long words stay", "aaaaaaaaaa b", {"body_width": 4}, "aaaaaaaaaa\nb"),
    ("links not wrapped", "aaa <a href='/x'>b</a> ccc", {"body_width": 5, "wrap_links": False}, "aaa [b](/x) ccc"),
]


def named(options: dict) -> dict[str, str]:
    """Options as text, as to_markdown_with() takes them."""
    return {k: ",".join(v) if isinstance(v, tuple) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
