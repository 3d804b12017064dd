"""Main text of a page, from one walk along its tags.

A page is split at its tags. Elements count only if they are closed, so a lost end tag hides
nothing; articles and the body also count while open. Text between block tags is a block, and a
block whose characters mostly stand in links is none of the text.

Nesting has no bounded pattern, so the walk runs in Python over Arrow batches; its time is linear
in the page. `plans/oracles.py` spells the same rules out as window functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import config

# Parts that are never text, and parts that are none unless they hold all there is.
HARD_PARTS = ("head", "title", "noscript", "nav", "header", "footer", "aside")
SOFT_PARTS = ("form", "table")
OPEN_PARTS = ("article", "body")
KINDS = (*HARD_PARTS, *SOFT_PARTS, "a")
HEADINGS = tuple(f"h{level}" for level in range(1, 7))
BLOCK_TAGS = (
    "p", "div", "hr", "li", "ul", "ol", "dl", "dt", "dd", *HEADINGS, "section", "main", "blockquote",
    "pre", "figure", "figcaption", "tr", "td", "th", "html", *HARD_PARTS, *SOFT_PARTS, *OPEN_PARTS,
)

NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
REFERENCE = r"#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,30}"
REPLACEMENT = "�"
# Numbers of the C1 block mean the characters that the Windows code page has there.
C1 = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}

_REFERENCE = re.compile(f"&({REFERENCE});")
_COMMENT = re.compile(r"(?s)<!--.*?(?:-->|\Z)")
_RAW = re.compile(r"(?i)<(script|style)\b")
_RAW_END = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
_TAG = re.compile(r"/?[a-zA-Z][a-zA-Z0-9]*")


def _referred(found: re.Match) -> str:
    name = found.group(1)
    if name[0] != "#":
        return NAMED.get(name, found.group())
    number = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    if number == 0 or number > 0x10FFFF or 0xD800 <= number < 0xE000:
        return REPLACEMENT
    return C1.get(number) or chr(number)


def decode_references(text: str) -> str:
    """Decimal, hexadecimal and named character references, each decoded once; others stay."""
    return _REFERENCE.sub(_referred, text) if "&" in text else text


def without_raw(page: str) -> str:
    """The page without comments, scripts and styles; what is never closed goes to the end."""
    page = _COMMENT.sub("", page)
    kept, at = [], 0
    while found := _RAW.search(page, at):
        start = page.find(">", found.end())
        if start < 0:
            break
        kept.append(page[at : found.start()])
        end = _RAW_END[found.group(1).lower()].search(page, start + 1)
        at = end.end() if end else len(page)
    return "".join(kept) + page[at:]


def _pieces(page: str) -> Iterator[tuple[str, str]]:
    """(tag, text after it): tags as `name` or `/name`, in lower case."""
    first, *rest = without_raw(page).split("<")
    yield "", first
    for piece in rest:
        tag = _TAG.match(piece)
        if tag or piece[:1] in ("!", "?", "/"):
            yield tag.group().lower() if tag else "", piece.partition(">")[2]
        else:
            yield "", "<" + piece


def _inside(tags: list[str], kind: str) -> list[bool]:
    """For each piece, whether it stands in a `kind` element that is closed."""
    change, started = [0] * (len(tags) + 1), []
    for k, tag in enumerate(tags):
        if tag == kind:
            started.append(k)
        elif started and tag == f"/{kind}":
            change[started.pop()] += 1
            change[k] -= 1
    return [depth > 0 for depth in accumulate(change[:-1])]


def _started(tags: list[str], kind: str) -> list[bool]:
    """For each piece, whether more `kind` elements have begun than ended; stray ends are ignored."""
    found, depth = [], 0
    for tag in tags:
        depth = depth + 1 if tag == kind else max(0, depth - 1) if tag == f"/{kind}" else depth
        found.append(depth > 0)
    return found


def lines_of(text: str) -> str:
    """Trimmed, non-empty lines."""
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def _weight(text: str) -> int:
    return sum(map(len, text.split()))


def main_text(page: str) -> str:
    """The text of all articles, else of the body, else of all paragraphs, else of the whole body.

    Menus, headers, footers and sidebars are left out throughout; forms and tables are, unless
    nothing is found outside them, as in a page that is wrapped in a form.
    """
    tags, texts = map(list, zip(*_pieces(page)))
    inside = {kind: _inside(tags, kind) for kind in KINDS if kind in tags}
    started = {kind: _started(tags, kind) for kind in OPEN_PARTS if kind in tags}

    def any_of(kinds: tuple[str, ...], k: int) -> bool:
        return any(inside[kind][k] for kind in kinds if kind in inside)

    blocks: list[tuple[int, list[str], list[str]]] = []
    for k, (tag, text) in enumerate(zip(tags, texts)):
        if not blocks or tag.lstrip("/") in BLOCK_TAGS:
            blocks.append((k, [], []))
        text = decode_references(text)
        _, parts, linked = blocks[-1]
        parts.append("\n" + text if tag.lstrip("/") == "br" else text)
        if any_of(("a",), k):
            linked.append(text)
    chances: list[list[str]] = [[], [], [], [], []]
    for k, parts, linked in blocks:
        text = "".join(parts)
        mostly_links = 2 * sum(map(_weight, linked)) > _weight(text)
        if any_of(HARD_PARTS, k) or (mostly_links and tags[k] not in HEADINGS):
            continue
        plain = not any_of(SOFT_PARTS, k)
        article, body = (kind in started and started[kind][k] for kind in OPEN_PARTS)
        for chance, usable in enumerate((article and plain, article, body and plain, tags[k] == "p", body)):
            if usable:
                chances[chance].append(text)
    for texts in chances:
        if found := lines_of("\n".join(texts)):
            return found
    return ""


def page_body(html: Column) -> Column:
    """The main text cut to 8,000 characters; null if there is none."""

    most = config.PAGE_BODY_CHARS

    @F.pandas_udf("string")
    def bodies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            texts = [None if page is None else main_text(page)[:most] for page in pages]
            yield pd.Series([text or None for text in texts], dtype=object)

    # Else a filter on the result would be pushed down with a second copy of the walk.
    return bodies.asNondeterministic()(html)
