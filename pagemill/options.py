"""Options of the conversion of HTML into Markdown."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

TagHook = Callable[[object, str, dict, bool], bool]


@dataclass(frozen=True)
class Options:
    """All options; from_names() takes their camel-case names."""

    unicode_snob: bool = False  # keep characters that have an ASCII stand-in
    escape_snob: bool = False  # escape all Markdown characters of the text
    links_each_paragraph: bool = False  # footnotes after each paragraph
    body_width: int = 78  # columns; 0 does not wrap
    skip_internal_links: bool = True
    inline_links: bool = True  # else numbered references
    protect_links: bool = False  # <href>
    wrap_links: bool = True
    wrap_list_items: bool = False
    wrap_tables: bool = False
    google_doc: bool = False  # emphasis, lists and breaks by style
    tag_callback: TagHook | None = None  # (writer, tag, attributes, opens); True swallows the tag
    google_list_indent: int = 36  # pixels of a level
    bold_text_style_values: tuple[str, ...] = ("bold", "700", "800", "900")
    ignore_anchors: bool = False
    ignore_mailto_links: bool = False
    ignore_images: bool = False
    images_as_html: bool = False
    images_to_alt: bool = False
    images_with_size: bool = False
    ignore_emphasis: bool = False
    mark_code: bool = False
    backquote_code_style: bool = False
    default_image_alt: str = ""
    pad_tables: bool = False
    use_automatic_links: bool = True
    bypass_tables: bool = False
    ignore_tables: bool = False
    single_line_break: bool = False
    open_quote: str = '"'
    close_quote: str = '"'
    include_sup_sub: bool = False
    base_url: str = ""
    ul_item_mark: str = "*"
    emphasis_mark: str = "_"
    strong_mark: str = "**"
    hide_strikethrough: bool = False
    compat: bool = False  # lose unwrapped lines that hold a space and a plus

    def __post_init__(self):
        for f in fields(self):
            value, default = getattr(self, f.name), f.default
            if f.name == "tag_callback":
                if value is not None and not callable(value):
                    raise TypeError("tag_callback must be callable")
            elif f.name == "bold_text_style_values":
                object.__setattr__(self, f.name, tuple(value))
            elif type(value) is not type(default):
                raise TypeError(f"{f.name} must be {type(default).__name__}, not {type(value).__name__}")

    @classmethod
    def from_names(cls, values: dict[str, object]) -> Options:
        """Options from names such as bodyWidth or body_width; text is read as the field's type."""
        known = {f.name.replace("_", ""): f for f in fields(cls)}
        out = {}
        for name, value in values.items():
            f = known.get(name.replace("_", "").lower())
            if f is None:
                raise ValueError(f"no such option: {name}")
            if isinstance(value, str) and isinstance(f.default, bool):
                value = value.lower() in ("1", "true", "yes", "on")
            elif isinstance(value, str) and isinstance(f.default, int):
                value = int(value)
            elif isinstance(value, str) and isinstance(f.default, tuple):
                value = tuple(x.strip() for x in value.split(","))
            out[f.name] = value
        return replace(cls(), **out)


DEFAULTS = Options()
