"""Character classes and names of XML as regular expressions, for Python and for Spark's (Java) engine."""

from __future__ import annotations

# Fixed values of the XML 1.0 (fifth edition) and 1.1 recommendations.
NAME_START = ":A-Z_a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c-\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff"
NAME_MORE = "\\-.0-9\u00b7\u0300-\u036f\u203f-\u2040"
NAME = f"[{NAME_START}][{NAME_START}{NAME_MORE}]*"
NMTOKEN = f"[{NAME_START}{NAME_MORE}]+"
NCNAME = f"[{NAME_START[1:]}][{NAME_START[1:]}{NAME_MORE}]*"
SPACE = "[ \\t\\r\\n]"
#: Characters that may not stand in a document, by version.
ILLEGAL_10 = "[^\\t\\n\\r -\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]"
ILLEGAL_11 = "[^\\t\\n\\r -~\u0085\u00a0-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]"
PUBID = "[ \\r\\na-zA-Z0-9\\-'()+,./:=?;!*#@$_%]*"
PREDEFINED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
XML_URI, XMLNS_URI = "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2000/xmlns/"


def legal_reference(code: int, v11: bool) -> bool:
    """Whether a character reference may denote this code point."""
    if v11:
        return 0 < code < 0xD800 or 0xE000 <= code <= 0xFFFD or 0x10000 <= code <= 0x10FFFF
    return code in (9, 10, 13) or 0x20 <= code < 0xD800 or 0xE000 <= code <= 0xFFFD or 0x10000 <= code <= 0x10FFFF
