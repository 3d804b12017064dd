"""String expressions with the whitespace rules of Python's `str` methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character class of all Unicode whitespace; Java's \s alone misses NBSP, NEL and \x1c-\x1f.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"

# The same set spelled out, for trimming in linear time.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# One whitespace character other than a plain space. Replacing these first and then runs of
# spaces is several times faster than one pattern for whole runs.
ODD_SPACE = r"[\t-\r\x1c-\x1f\x85[\p{Z}&&[^ ]]]"

TAG = r"<[^>]+>"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def squeeze(text: Column) -> Column:
    """Whitespace runs become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, ODD_SPACE, " "), " {2,}", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def drop_tags(text: Column, *patterns: str) -> Column:
    """Replaces `pattern, replacement` pairs of tag patterns, which all end in `>`.

    Text after the last `>` holds no tag. Leaving it out keeps a text of many `<` and no `>` from
    being scanned to its end over and over.
    """
    tail = F.substring_index(text, ">", -1)
    head = F.left(text, F.length(text) - F.length(tail))
    for pattern, to in zip(patterns[::2], patterns[1::2]):
        head = F.regexp_replace(head, pattern, to)
    return F.concat(head, tail)


def clean_html(text: Column) -> Column:
    """Drop tags, then decode the handful of entities feeds use, then squeeze.

    `&amp;` is decoded first, so a doubly escaped entity is decoded twice. Decimal character
    references are removed; hexadecimal ones and quotes are left as they are.
    """
    text = F.when(text.contains("<"), drop_tags(text, TAG, "")).otherwise(text)
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return squeeze(F.regexp_replace(text, r"&#\p{Nd}+;", ""))


def escape_html(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    for char, entity in pairs:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit
