"""Character classes and lookup strings used by the text functions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

# Fixed values -----------------------------------------------------------------------------------
# White space as Unicode string stripping sees it, and word characters, in Java regex syntax.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WORD = r"\p{L}\p{N}_"

# Runs of these collapse to one blank. U+00A0 and U+1680 are not members.
COLLAPSIBLE = r"\u180E\u2000-\u200B\u202F\u205F\u3000\uFEFF\n\t\x0B\x08\r\f\x07 "

# Markers left behind by deleted and moderated comments.
DELETION_MARKERS = ("[deleted]", "[removed]")

# Quotation marks dropped when raw comments are cleaned.
CLEANED_QUOTES = '"“”‟„⹂〞〟＂❝❞'

# Apostrophe-like characters that become "'".
APOSTROPHES = "'`‘´’‛"

# Quotation marks that become '"'.
QUOTATION_MARKS = '"”“„»«「」『』（）〔〕【】《》〈〉'

# Hyphens whose runs become "-".
HYPHENS = "-–—"

# Character references that are turned into literals: decimal code, name (or None), literal.
ENTITIES = (
    (32, None, " "),
    (38, "amp", "&"),
    (60, "lt", "<"),
    (62, "gt", ">"),
    (160, "nbsp", " "),
    (732, "tilde", "˜"),
    (8194, "ensp", "\u2002"),
    (8195, "emsp", "\u2003"),
    (8201, "thinsp", "\u2009"),
    (8204, "zwnj", "\u200C"),
    (8205, "zwj", "\u200D"),
    (8206, "lrm", "\u200E"),
    (8207, "rlm", "\u200F"),
    (8211, "ndash", "–"),
    (8212, "mdash", "—"),
    (8216, "lsquo", "‘"),
    (8217, "rsquo", "’"),
    (8218, "sbquo", "‚"),
    (8220, "ldquo", "“"),
    (8221, "rdquo", "”"),
    (8222, "bdquo", "„"),
    (8226, "bull", "•"),
    (8230, "hellip", "…"),
    (8242, "prime", "′"),
    (8243, "Prime", "″"),
    (8249, "lsaquo", "‹"),
    (8250, "rsaquo", "›"),
)
# End of fixed values ----------------------------------------------------------------------------


def ascii_class(member: Callable[[str], bool], negate: bool = False) -> str:
    """A regex class naming every ASCII character for which ``member`` holds, one by one.

    Java answers such a class from a bit table; ranges and Unicode properties are tested one after another.
    Only equal to the property it stands for in ASCII text.
    """
    return "[" + ("^" if negate else "") + "".join(f"\\x{i:02X}" for i in range(128) if member(chr(i))) + "]"


def is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def entity_codes() -> list[tuple[str, str]]:
    """``(code, literal)`` pairs in the order they are applied."""
    pairs = []
    for number, name, literal in ENTITIES:
        pairs.append((f"&#{number};", literal))
        if name:
            pairs.append((f"&{name};", literal))
    return pairs


@lru_cache(maxsize=1)
def space_characters() -> str:
    """Every character of ``SPACE``, spelled out for functions that take a set of characters."""
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


@lru_cache(maxsize=1)
def ascii_foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Non-ASCII characters whose compatibility decomposition keeps ASCII characters.

    Returns two maps: characters that keep exactly one ASCII character, and those that keep several.
    Computed from the Unicode database; every other non-ASCII character folds to nothing.
    """
    single, several = {}, {}
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        kept = "".join(c for c in unicodedata.normalize("NFKD", char) if c < "\x80")
        if kept:
            (single if len(kept) == 1 else several)[char] = kept
    return single, several
