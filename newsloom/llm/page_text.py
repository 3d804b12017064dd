"""Main text of web pages: markup zones, and a suffix array over the pages of each host.

A page is read once, tag by tag, into blocks of text. Blocks inside the article are the main text,
blocks inside menus, headers, footers, sidebars, notices, adverts, forms and comments are not.
What is neither is open, and markup alone cannot tell a page's own words from its site's.

For that the token streams of everything outside articles are concatenated host by host, and a
suffix array over them finds the runs of RUN tokens or more that stand on two distinct pages. In a
page without an article, tokens that such runs cover are boilerplate; the unique runs are its text.

The token streams of the articles are searched in the same way. Copies and quotations repeat there
too, and stay: the site's words are only runs that most articles of the host share, such as a
notice in each of them. Blocks that such runs cover from end to end are not part of the article.

A host may be far larger than a task. Its pages are dealt into segments of bounded length, each
with a suffix array of its own; hosts of several segments then compare the windows that their
segments hold, by digest, with the counts added up before they are shuffled.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, stored

# Tokens that a run needs to count as long.
RUN = 5
# Tokens of one suffix array; a host of more has several.
SEGMENT = 1_000_000
# Articles of a host that share a run, at least, before it may be the site's.
SITE = 5

# Zones, by how little they belong to the main text. Parts that a lost end tag may leave open
# (LOOSE) do not hold an article back, others (CHROME) do.
ARTICLE, MAIN, OPEN, FORM, LOOSE, CHROME = range(6)

# Elements, roles and class words by what they hold.
RAW = frozenset({"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"})
VOID = frozenset({
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
})
INLINE = frozenset({
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font",
    "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
    "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
# An element of a group ends one before it that was left open.
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
    "tr": ("td", "th", "tr"),
}
ZONE_OF_TAG = {
    **dict.fromkeys(("form",), FORM),
    **dict.fromkeys(("nav", "header", "menu", "head"), LOOSE),
    **dict.fromkeys((
        "footer", "aside", "noscript", "template", "button", "select", "option", "datalist", "object", "applet",
        "svg", "canvas", "audio", "video", "map", "dialog",
    ), CHROME),
}
CHROME_ROLES = frozenset({
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu",
})
CHROME_WORDS = frozenset({
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promoted",
    "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup",
    "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "paywall", "nav", "navbar", "navigation",
    "menu", "menus", "breadcrumb", "breadcrumbs", "masthead", "header", "footer", "sidebar", "aside", "related",
    "recommended", "recommendations", "share", "sharing", "social", "comment", "comments", "commentlist", "disqus", "reply",
    "replies", "widget", "toolbar", "pagination", "pager", "login", "search", "skip",
})
# Articles of these classes are comments and the like.
LESSER_ARTICLES = frozenset({"comment", "comments", "reply", "replies", "teaser", "related", "ad", "advert", "sponsored", "promo"})

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r"=\s*([\"'])|>")
_ATTRIBUTE = re.compile(
    r"(?<![^\s/\"'])([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str:
    """The lower-case host; empty if there is none."""
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else ""


class _Reader:
    """One pass over a page; its time is linear in the page, whatever is left open."""

    def __init__(self, page: str):
        self.page = page
        self.stack: list[tuple[str, int]] = []  # open elements and the zone inside them
        self.count: dict[str, int] = {}
        self.containers: list[int] = []  # places in the stack of what is neither inline nor a paragraph
        self.paragraphs: list[int] = []
        self.pieces: list[tuple[int, str]] = []
        self.blocks: list[tuple[int, str]] = []
        self.last = {quote: page.rfind(quote) for quote in "\"'"}

    def zone(self) -> int:
        return self.stack[-1][1] if self.stack else OPEN

    def text(self, piece: str) -> None:
        self.pieces.append((self.zone(), html.unescape(piece) if "&" in piece else piece))

    def flush(self) -> None:
        """Ends a block. What it holds of another zone, such as an advert in a line, is a block of its own."""
        by_zone: dict[int, list[str]] = {}
        for zone, piece in self.pieces:
            by_zone.setdefault(zone, []).append(piece)
        for zone, pieces in by_zone.items():
            words = "".join(pieces).split()
            if words:
                self.blocks.append((zone, " ".join(words)))
        self.pieces = []

    def push(self, name: str, zone: int) -> None:
        if name == "p":
            self.paragraphs.append(len(self.stack))
        elif name not in INLINE:
            self.containers.append(len(self.stack))
        self.stack.append((name, zone))
        self.count[name] = self.count.get(name, 0) + 1

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.count[self.stack.pop()[0]] -= 1
        for places in (self.containers, self.paragraphs):
            while places and places[-1] >= depth:
                places.pop()

    def tag_end(self, at: int) -> int:
        """The place behind the tag whose attributes start at `at`; a `>` in quotes does not end it."""
        while True:
            found = _QUOTE_OR_END.search(self.page, at)
            if not found:
                return len(self.page)
            quote, at = found.group(1), found.end()
            if quote is None:
                return at
            if self.last[quote] >= at:  # else it is never closed: an ordinary character
                at = self.page.index(quote, at) + 1

    def close(self, name: str) -> None:
        if name not in INLINE:
            self.flush()
        if self.count.get(name):
            depth = len(self.stack) - 1
            while self.stack[depth][0] != name:
                depth -= 1
            self.pop_to(depth)

    def open(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self.flush()
            if self.paragraphs and self.paragraphs[-1] > (self.containers[-1] if self.containers else -1):
                self.pop_to(self.paragraphs[-1])
            while self.containers and self.stack[self.containers[-1]][0] in SIBLINGS.get(name, ()):
                self.pop_to(self.containers[-1])
        elif name == "br":
            self.text(" ")
        if name not in VOID:
            self.push(name, self.zone_in(name, attributes))

    def zone_in(self, name: str, attributes: str) -> int:
        """The zone inside a new element."""
        around = self.zone()
        values: dict[str, str] = {}
        if "=" in attributes:
            for key, *forms in _ATTRIBUTE.findall(attributes):
                values.setdefault(key.lower(), "".join(forms))
        words = {w.lower() for key in ("class", "id") for w in _WORDS.findall(values.get(key, ""))}
        role = values.get("role", "").strip().lower()
        if around == CHROME or name in ("html", "body"):
            return CHROME if around == CHROME else OPEN
        if name == "article" or role == "article":
            return CHROME if words & LESSER_ARTICLES else ARTICLE
        if name == "main" or role == "main":
            return min(around, MAIN)
        if name in HEADINGS and around == LOOSE and any(zone == ARTICLE for _, zone in self.stack[-2:]):
            return ARTICLE  # the headline in an article's own header
        if words & CHROME_WORDS or role in CHROME_ROLES:
            return LOOSE if words & CHROME_WORDS == {"header"} else CHROME
        return max(around, ZONE_OF_TAG.get(name, ARTICLE))

    def read(self) -> list[tuple[int, str]]:
        """The blocks of the page, in order, with their zones."""
        page, at = self.page, 0
        while at < len(page):
            tag = page.find("<", at)
            if tag < 0:
                tag = len(page)
            if tag > at:
                self.text(page[at:tag])
            name = _NAME.match(page, tag + 1)
            if name:
                at = self.tag_end(name.end())
                tag_name = name.group().lower()
                if tag_name in RAW:
                    end = re.compile(f"</{tag_name}(?![^\\s/>])", re.I).search(page, at)
                    at = self.tag_end(end.end()) if end else len(page)
                else:
                    self.open(tag_name, page[name.end() : at])
            elif page.startswith("</", tag) and (name := _NAME.match(page, tag + 2)):
                at = self.tag_end(name.end())
                self.close(name.group().lower())
            elif page.startswith("<!--", tag):
                end = page.find("-->", tag + 2)
                at = end + 3 if end >= 0 else len(page)
            elif page.startswith(("<!", "<?", "</"), tag):
                end = page.find(">", tag)
                at = end + 1 if end >= 0 else len(page)
            else:
                self.text(page[tag : tag + 1])
                at = tag + 1
        self.flush()
        return self.blocks


def page_blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page, in order."""
    return _Reader(page or "").read()


def main_zone(blocks: list[tuple[int, str]]) -> int | None:
    """The zone that holds the main text: the article, the main element, else what is unmarked.

    A form counts only if all running text is in it, as where it wraps the page.
    """
    zones = {zone for zone, text in blocks if zone < FORM or (zone == FORM and text.count(" ") >= RUN - 1)}
    return min(zones, default=None)


def _digest(text: str) -> int:
    own = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8)
    return int.from_bytes(own.digest(), "little", signed=True)


def _source(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )


def _article(blocks: list[tuple[int, str]]) -> str | None:
    """The blocks of the article as lines; none of them holds a line break."""
    return "\n".join(text for zone, text in blocks if zone == ARTICLE) or None


def _n_tokens(text: str) -> int:
    return text.count(" ") + text.count("\n") + 1


def read_pages(pages: DataFrame) -> DataFrame:
    """Each page with what the suffix arrays read of it, but for the text of its article.

    host, digest, tokens (how many), outside (texts of all blocks outside articles, in page order)
    and mine (which of them are the page's main zone) describe the blocks outside articles, article
    and article_tokens the article, by its digest. They are null without one.
    """

    def task(batches):
        for batch in batches:
            out = {n: [] for n in ("host", "digest", "tokens", "article", "article_tokens", "outside", "mine")}
            for url, page in zip(batch["url"], batch["html"]):
                blocks = page_blocks(page)
                zone = main_zone(blocks)
                outside = [(text, z == zone) for z, text in blocks if z != ARTICLE]
                texts = [text for text, _ in outside]
                article = _article(blocks)
                out["host"].append(host_of(url))
                out["digest"].append(_digest("\n".join(texts)))
                out["tokens"].append(sum(map(_n_tokens, texts)))
                out["article"].append(None if article is None else _digest(article))
                out["article_tokens"].append(None if article is None else _n_tokens(article))
                out["outside"].append(texts)
                out["mine"].append([own_block for _, own_block in outside])
            yield {"page_id": batch["page_id"], "url": batch["url"], **out}

    rows = _source(pages)
    kind = dict(rows.dtypes)["page_id"]
    return arrow_rows(rows, task, (
        f"page_id {kind}, url string, host string, digest long, tokens long, article long, article_tokens long, "
        "outside array<string>, mine array<boolean>"
    ))


def read_articles(pages: DataFrame, distinct: bool = False) -> DataFrame:
    """The pages that have an article, with its text and digest.

    A page is read again for it: a second reading costs less than keeping all texts on disk beside
    what is shuffled. `distinct` leaves out repeats of a host's article within a task.
    """

    def task(batches):
        seen = set()
        for batch in batches:
            out = {n: [] for n in ("page_id", "url", "host", "digest", "article")}
            for page_id, url, page in zip(batch["page_id"], batch["url"], batch["html"]):
                article = _article(page_blocks(page))
                if article is None:
                    continue
                row = (page_id, url, host_of(url), _digest(article), article)
                if distinct:
                    if row[2:4] in seen:
                        continue
                    seen.add(row[2:4])
                for values, value in zip(out.values(), row):
                    values.append(value)
            yield out

    rows = _source(pages)
    kind = dict(rows.dtypes)["page_id"]
    return arrow_rows(rows, task, f"page_id {kind}, url string, host string, digest long, article string")


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].reshape(-1).astype(np.int64)


def suffix_keys(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Numbers that order every suffix by its first `depth` tokens, by prefix doubling.

    Suffixes of equal numbers agree in `depth` tokens. A suffix beyond the end is the least. Tokens
    are numbers below their count.
    """
    keys, length = tokens.astype(np.int64), 1
    while length < depth:
        ranks = _ranks(keys) if length > 1 else keys
        step = min(length, depth - length)
        after = np.zeros(len(ranks), np.int64)
        after[: max(len(ranks) - step, 0)] = ranks[step:] + 1
        keys = ranks * (len(ranks) + 1) + after
        length += step
    return keys


def window_pages(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """For each token, on how many pages the `run` tokens from it on start.

    `page` numbers the tokens' pages, ascending; tokens that end a page are unique, so no window leaves one.
    """
    keys = suffix_keys(tokens, run)
    order = np.argsort(keys, kind="stable")  # the suffix array, to the depth of a run
    ranked, pages = keys[order], page[order]
    other = np.r_[True, ranked[1:] != ranked[:-1]]
    first = np.flatnonzero(other)
    other[1:] |= pages[1:] != pages[:-1]
    found = np.zeros(len(tokens), np.int64)
    found[order] = np.repeat(np.add.reduceat(other.astype(np.int64), first), np.diff(np.r_[first, len(order)]))
    return found


def _joined(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pages' tokens as small numbers, one after the other, each page ended by a token of its own; and their pages."""
    lengths = np.array([len(t) for t in tokens])
    page = np.repeat(np.arange(len(tokens)), lengths + 1)
    ids = np.unique(np.concatenate(tokens), return_inverse=True)[1].reshape(-1) + len(tokens)
    return np.insert(ids, np.cumsum(lengths), np.arange(len(tokens))), page


def page_tokens(host: str, blocks: list[str]) -> np.ndarray:
    """Digests of a page's tokens, different from host to host."""
    seed = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))
    digest = xxhash.xxh64_intdigest
    words = " ".join(blocks).encode("utf-8", "surrogatepass").split(b" ") if blocks else []
    return np.array([digest(word, seed) for word in words], np.uint64)


def _spans(starts: np.ndarray, run: int) -> list[int]:
    """Windows that start at ascending places, united to spans: first, end, first, end..."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > run)
    first, end = np.r_[starts[0], starts[cut + 1]], np.r_[starts[cut], starts[-1]] + run
    return np.stack([first, end], axis=1).ravel().tolist()


def _by_segment(judged: Callable[[list[tuple]], dict[str, list]], segment: int):
    """A task that gives `judged` the rows of whole segments, a suffix array's worth at once."""

    def task(batches):
        held, size, group = [], 0, None
        for batch in batches:
            for row in zip(*batch.values()):
                host, _, _, part, texts = row
                if size >= segment and (host, part) != group:
                    yield judged(held)
                    held, size = [], 0
                group = (host, part)
                held.append(row)
                size += sum(map(_n_tokens, texts))
        if held:
            yield judged(held)

    return task


def host_runs(read: DataFrame, run: int = RUN, segment: int = SEGMENT) -> DataFrame:
    """(host, digest, spans): the tokens of each page that long runs cover, as flat (first, end).

    `read` has the rows of `read_pages`. A run counts if pages of one host with different outside
    blocks share it; equal ones are one page here, however many rows they have.
    """
    streams = read.filter("tokens >= %d" % run).groupBy("host", "digest").agg(
        F.first("tokens").alias("tokens"), F.first("outside").alias("outside")
    )
    streams = stored(streams, "pages-streams")
    large = streams.groupBy("host").agg(F.sum("tokens").alias("all")).filter(F.col("all") > segment)
    large = large.select("host", F.ceil(F.col("all") / segment).alias("segments"))
    dealt = streams.join(large, "host", "left").withColumn("segments", F.coalesce("segments", F.lit(1)))
    dealt = dealt.withColumn("segment", F.pmod(F.xxhash64("digest"), F.col("segments")))
    dealt = dealt.repartition("host", "segment").sortWithinPartitions("host", "segment")

    def judged(rows: list[tuple]) -> dict[str, list]:
        tokens = [page_tokens(host, outside) for host, _, _, _, outside in rows]
        found = window_pages(*_joined(tokens), run) > 1
        out = {n: [] for n in ("host", "digest", "segment", "spans", "windows")}
        at = 0
        for (host, digest, segments, part, _), own in zip(rows, tokens):
            n = len(own)
            out["host"].append(host)
            out["digest"].append(digest)
            out["segment"].append(part)
            out["spans"].append(_spans(np.flatnonzero(found[at : at + n]), run))
            out["windows"].append(_window_digests(own, run).tolist() if segments > 1 else [])
            at += n + 1
        return out

    parts = stored(arrow_rows(
        dealt.select("host", "digest", "segments", "segment", "outside"), _by_segment(judged, segment),
        "host string, digest long, segment long, spans array<int>, windows array<long>",
    ), "pages-runs")
    # Between the segments of a large host: the places whose window another segment holds too.
    places = parts.filter(F.size("windows") > 0).select(
        "host", "digest", "segment", F.posexplode("windows").alias("at", "window")
    )
    ends = places.groupBy("host", "window").agg(F.min("segment").alias("low"), F.max("segment").alias("high"))
    across = places.join(ends.filter("low < high"), ["host", "window"]).groupBy("host", "digest").agg(
        F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + run))).alias("more")
    )
    # A page's places are at most its tokens, so the list is no larger than the page.
    both = parts.join(across, ["host", "digest"], "left")
    return both.select("host", "digest", F.concat("spans", F.coalesce("more", F.array().cast("array<int>"))).alias("spans"))


def site_runs(pages: DataFrame, read: DataFrame, run: int = RUN, segment: int = SEGMENT, least: int = SITE) -> DataFrame:
    """(host, windows): digests of the runs that most articles of a host share, and `least` of them.

    `read` has the rows of `read_pages`. Equal articles of a host are one article here. What more
    than half of a host's articles share, more than half of those in one of its segments do: such
    runs are no more than twice the tokens of an article, and only they are counted over segments.
    """
    own = read.filter("article is not null").groupBy("host", "article").agg(F.first("article_tokens").alias("tokens"))
    hosts = own.groupBy("host").agg(F.count("*").alias("articles"), F.ceil(F.sum("tokens") / segment).alias("segments"))
    hosts = stored(hosts.filter(F.col("articles") >= least), "pages-hosts")
    dealt = read_articles(pages, distinct=True).join(hosts, "host")
    dealt = dealt.withColumn("segment", F.pmod(F.xxhash64("digest"), F.col("segments")))
    dealt = dealt.withColumn("article", F.split("article", "\n"))
    dealt = dealt.select("host", "digest", "segments", "segment", "article")
    dealt = dealt.repartition("host", "segment").sortWithinPartitions("host", "segment")

    def judged(rows: list[tuple]) -> dict[str, list]:
        rows = list({row[:2]: row for row in rows}.values())
        groups = Counter((host, part) for host, _, _, part, _ in rows)
        tokens = [page_tokens(host, article) for host, _, _, _, article in rows]
        found = window_pages(*_joined(tokens), run)
        shared: dict[tuple, set[int]] = {}
        at = 0
        for (host, _, segments, part, _), own in zip(rows, tokens):
            count = found[at : at + max(len(own) - run + 1, 0)]
            common = 2 * count > groups[host, part]
            if segments == 1:
                common &= count >= least
            if common.any():
                shared.setdefault((host, segments, part), set()).update(_window_digests(own, run)[common].tolist())
            at += len(own) + 1
        return {
            "host": [host for host, _, _ in shared], "segments": [n for _, n, _ in shared],
            "windows": [list(windows) for windows in shared.values()],
        }

    parts = stored(arrow_rows(
        dealt, _by_segment(judged, segment), "host string, segments long, windows array<long>"
    ), "pages-site")
    few = parts.filter("segments = 1").select("host", "windows")
    many = parts.filter("segments > 1")
    if many.isEmpty():
        return few

    def present(batches):
        for batch in batches:
            held = [
                np.intersect1d(_window_digests(page_tokens(host, article.split("\n")), run), windows).tolist()
                for host, article, windows in zip(batch["host"], batch["article"], batch["windows"])
            ]
            yield {"host": batch["host"], "digest": batch["digest"], "windows": held}

    many = many.groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("windows"))).alias("windows"))
    held = arrow_rows(
        read_articles(pages, distinct=True).join(many, "host").select("host", "digest", "article", "windows"),
        present, "host string, digest long, windows array<long>",
    ).groupBy("host", "digest").agg(F.first("windows").alias("windows"))
    counted = held.select("host", F.explode("windows").alias("window")).groupBy("host", "window").agg(F.count("*").alias("n"))
    counted = counted.join(hosts, "host").filter((F.col("n") * 2 > F.col("articles")) & (F.col("n") >= least))
    return stored(few.unionByName(counted.groupBy("host").agg(F.collect_list("window").alias("windows"))), "pages-site")


def _window_digests(tokens: np.ndarray, run: int) -> np.ndarray:
    """A digest of the tokens from each place on that has `run` of them."""
    count = max(len(tokens) - run + 1, 0)
    mixed = np.zeros(count, np.uint64)
    for k in range(run):
        mixed = (mixed ^ tokens[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def unique_runs(outside: list[str], mine: list[bool], spans: list[int]) -> str:
    """The own blocks without covered tokens; all of them if nothing else would stay.

    A page of which nothing is left is a copy or a part of another one, with no text of its own
    that would tell the site's words from it.
    """
    blocks = [text.split(" ") for text in outside]
    covered = np.zeros(sum(map(len, blocks)), bool)
    for first, end in zip(spans[::2], spans[1::2]):
        covered[first:end] = True
    kept, at = [], 0
    for words, own in zip(blocks, mine):
        left = [w for w, c in zip(words, covered[at : at + len(words)].tolist()) if not c]
        at += len(words)
        if own and left:
            kept.append(" ".join(left))
    return "\n".join(kept) or "\n".join(text for text, own in zip(outside, mine) if own)


def own_blocks(host: str, article: str, windows: list[int], run: int) -> str:
    """The article without blocks that the site's runs cover from end to end.

    An article that would lose more than half of its tokens stays whole: where most articles of a
    host are versions of one text, what they share is that text.
    """
    blocks = article.split("\n")
    tokens = page_tokens(host, blocks)
    spans = _spans(np.flatnonzero(np.isin(_window_digests(tokens, run), windows)), run)
    covered = np.zeros(len(tokens), bool)
    for first, end in zip(spans[::2], spans[1::2]):
        covered[first:end] = True
    lengths = np.array([_n_tokens(block) for block in blocks])
    site = np.logical_and.reduceat(covered, np.cumsum(lengths) - lengths)
    if 2 * lengths[site].sum() > len(tokens):
        return article
    return "\n".join(block for block, common in zip(blocks, site.tolist()) if not common)


def main_text(pages: DataFrame, run: int = RUN, segment: int = SEGMENT, least: int = SITE) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of `pages`.

    The text has a line for each block, in page order, with references decoded and white space
    made single. A null or empty page, and one without main text, has an empty text. Without a URL
    a page belongs to the nameless host. Repeated rows and ids stay; other columns are not read.
    """
    read = stored(read_pages(pages), "pages-read")
    runs = host_runs(read, run, segment)
    sites = site_runs(pages, read, run, segment, least)

    def task(batches):
        for batch in batches:
            texts = [
                unique_runs(outside, mine, spans or [])
                for outside, mine, spans in zip(batch["outside"], batch["mine"], batch["spans"])
            ]
            yield {"page_id": batch["page_id"], "url": batch["url"], "text": texts}

    def article_task(batches):
        for batch in batches:
            texts = [
                own_blocks(host, article, windows, run) if windows else article
                for host, article, windows in zip(batch["host"], batch["article"], batch["windows"])
            ]
            yield {"page_id": batch["page_id"], "url": batch["url"], "text": texts}

    kind = dict(read.dtypes)["page_id"]
    schema = f"page_id {kind}, url string, text string"
    judged = read.filter("article is null").join(runs, ["host", "digest"], "left")
    judged = arrow_rows(judged.select("page_id", "url", "outside", "mine", "spans"), task, schema)
    articles = read_articles(pages).join(sites, "host", "left")
    articles = arrow_rows(articles.select("page_id", "url", "host", "article", "windows"), article_task, schema)
    return articles.unionByName(judged).withColumn("n_chars", F.length("text").cast("long"))
