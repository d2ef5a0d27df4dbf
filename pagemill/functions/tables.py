"""Fixed values shared by the native functions and the writer."""

# ASCII stand-ins of named entities (nbsp is treated on its own).
STAND_INS = {
    "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"', "copy": "(C)", "mdash": "--",
    "rarr": "->", "larr": "<-", "middot": "*", "ndash": "-", "oelig": "oe", "aelig": "ae",
    "agrave": "a", "aacute": "a", "acirc": "a", "atilde": "a", "auml": "a", "aring": "a",
    "egrave": "e", "eacute": "e", "ecirc": "e", "euml": "e",
    "igrave": "i", "iacute": "i", "icirc": "i", "iuml": "i",
    "ograve": "o", "oacute": "o", "ocirc": "o", "otilde": "o", "ouml": "o",
    "ugrave": "u", "uacute": "u", "ucirc": "u", "uuml": "u", "lrm": "", "rlm": "",
}

# Code points 0x80 to 0x9F as HTML reads them: those of Windows-1252 where it has one.
C1 = {b: ord(bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

# Patterns of Markdown text.
ABSOLUTE_URL = r"^[a-zA-Z+]+://"
LINK_IN_TEXT = r"(\[.*?\] ?\(.*?\))|(\[.*?\]:.*?)"
LINK_CHARACTERS = r"([\\\[\]()])"
ALL_CHARACTERS = r"([`*_{}\[\]()#!])"
BACKSLASH = r"(\\)(?=[\\`*_{}\[\]()#+\-.!])"
ORDERED_START = r"^(\s*\d+)(\.)(?=\s)"
PLUS_START = r"^(\s*)(\+)(?=\s)"
DASH_START = r"^(\s*)(-)(?=\s|-)"


def stand_ins_by_code() -> dict[int, str]:
    """The stand-ins by code point."""
    from html.entities import html5

    return {ord(html5[f"{name};"]): text for name, text in STAND_INS.items()}
