"""The whole flow as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.arrays import add_once
from newsloom.lexicon import Lexicon
from newsloom.operators.normalize import normalize_entries, with_empty_enrichment
from newsloom.operators.select import newest_first, select_articles
from newsloom.operators.summaries import page_bodies, resolve_responses, summarize_articles
from newsloom.operators.topics import classify_articles
from newsloom.sources.feeds import from_enabled_feeds

# A cut of at most this many articles is small enough to broadcast its URLs.
BROADCAST_ARTICLES = 10_000

# Adds `category, confidence, all_scores` to articles, as `backends.classify_with_backend` does.
Classifier = Callable[[DataFrame], DataFrame]


def classified_articles(
    entries: DataFrame,
    lexicon: Lexicon,
    as_of: datetime,
    max_articles: int | None = None,
    classify: Classifier | None = None,
) -> DataFrame:
    """Entries to deduplicated, classified articles; `classify` replaces the hybrid scores."""
    articles = select_articles(normalize_entries(entries, as_of), max_articles)
    if max_articles is not None:
        # Text projections must not slip below the limit, where they would run for every row
        # and keep it from being a heap per task.
        articles = add_once(articles, title=F.col("title"))
    articles = with_empty_enrichment(articles)
    return classify_articles(articles, lexicon) if classify is None else classify(articles)


def enrich_articles(
    entries: DataFrame,
    pages: DataFrame,
    responses: DataFrame | None,
    lexicon: Lexicon,
    as_of: datetime,
    max_articles: int | None = None,
    classify: Classifier | None = None,
    registry: DataFrame | None = None,
) -> DataFrame:
    """Entries, page sources and model responses to enriched articles.

    With `max_articles` the newest are cut out before the costly stages and come back newest
    first. None enriches every article and leaves the order open; the dedup, page and response
    stages then all work on one partitioning by `url`. A `registry` of feeds admits entries of its
    enabled feeds only, in its own order; `classify` chooses the backend.
    """
    if registry is not None:
        entries = from_enabled_feeds(entries, registry)
    classified = classified_articles(entries, lexicon, as_of, max_articles, classify)
    if max_articles is not None and max_articles <= BROADCAST_ARTICLES:
        # Pages and responses of other articles are left out before they are parsed.
        urls = F.broadcast(
            select_articles(normalize_entries(entries, as_of), max_articles).select("url")
        )
        pages = pages.join(urls, "url", "left_semi")
        if responses is not None:
            responses = responses.join(urls, "url", "left_semi")
    resolved = None if responses is None else resolve_responses(responses)
    enriched = summarize_articles(classified, page_bodies(pages), resolved)
    return enriched if max_articles is None else newest_first(enriched)
