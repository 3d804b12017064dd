"""The registered queries: each operator over the whole test tables.

Times are rendered as text and scores rounded, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import config
from newsloom.functions.markup import clean_summary, fallback_summary
from newsloom.functions.text import clean_html
from newsloom.lexicon import default_lexicon
from newsloom.operators import (
    accuracy,
    backends,
    cache,
    metrics,
    model,
    normalize,
    report,
    select,
    summaries,
    topics,
    training,
)
from newsloom.plans.enrich import classified_articles, enrich_articles
from newsloom.session import pin_utc, shared_folder
from newsloom.sources import feeds as feed_files
from newsloom.sources import sinks, tables
from newsloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

CUSTOM_LABELS = ("Science", "Technology", "Sports", "Weather")
CATEGORY_RULES = {
    "Technology": ("en.",), "Business": ("fr.",), "Politics": ("de.",), "Sports": ("es.",),
}
KEY = ("feed_ord", "entry_ord")
DIGITS = 6

_QUERIES: dict[str, Query] = {}
_NAMES = {
    f"{name}_text": name for name in ("clean_html", "clean_summary", "fallback_summary")
}


def _query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(pin_utc(spark), sf_dir)

    # Functions named *_text share their operator's name without it.
    _QUERIES[_NAMES.get(fn.__name__, fn.__name__)] = run
    return fn


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def _when(column: str = "published") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised entries, before selection."""
    return normalize.normalize_entries(tables.entries(spark, sf_dir), tables.AS_OF)


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_articles(_articles(spark, sf_dir), None)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.with_classification_text(_articles(spark, sf_dir)).select(*KEY, "text")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_articles(tables.entries(spark, sf_dir), default_lexicon(), tables.AS_OF)


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.page_bodies(tables.web_pages(spark, sf_dir))


def _enriched(spark: SparkSession, sf_dir: str, max_articles: int | None = None) -> DataFrame:
    return enrich_articles(
        tables.entries(spark, sf_dir),
        tables.web_pages(spark, sf_dir),
        tables.responses(spark, sf_dir),
        default_lexicon(),
        tables.AS_OF,
        max_articles,
    )


def _verdict(df: DataFrame, *keys: str) -> DataFrame:
    ranking = F.array_join(F.transform("all_scores", lambda s: s["label"]), ",")
    best = F.get(F.col("all_scores"), F.lit(0))["score"]
    return df.select(
        *keys, "category", "confidence", ranking.alias("ranking"),
        F.round(best, DIGITS).alias("top_score"),
    )


# Sources and sinks


@_query
def feed_xml_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries landed as RSS and Atom files, read back and normalised."""
    raw = tables.document_entries(tables.load(spark, sf_dir, "documents"))
    raw = raw.withColumn("link", normalize.url_of(F.col("link"), F.col("links")))
    root = shared_folder(spark, "feeds")
    feed_files.write_rss(raw.filter("feed_ord % 2 = 0"), f"{root}/rss")
    feed_files.write_atom(raw.filter("feed_ord % 2 = 1"), f"{root}/atom")
    landed = feed_files.read_feeds(spark, f"{root}/rss", f"{root}/atom")
    return normalize.normalize_entries(landed, tables.AS_OF).select(
        "feed_ord", "source", "title", "description", "url", _when()
    )


@_query
def feed_ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.feed_ingest_report(tables.feeds(spark, sf_dir), _articles(spark, sf_dir))


@_query
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classified table written by category and read back."""
    path = shared_folder(spark, "articles")
    sinks.write_articles(_classified(spark, sf_dir), path)
    return _verdict(sinks.read_partitioned(spark, path, "category"), "url")


# Normalisation


@_query
def clean_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.load(spark, sf_dir, "pages")
    return pages.select("page_id", clean_html(F.col("html")).alias("cleaned"))


@_query
def normalize_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).withColumn("published", _when())


@_query
def resolve_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.entries(spark, sf_dir).select(
        *KEY, normalize.url_of(F.col("link"), F.col("links")).alias("url")
    )


@_query
def parse_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).select(*KEY, _when())


@_query
def classification_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir)


# Filters, dedup, sort, limit


@_query
def filter_no_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.with_url(_articles(spark, sf_dir)).select(*KEY, "url")


@_query
def filter_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = select.in_category(_classified(spark, sf_dir), "Technology")
    return found.select("url", "title", "category")


@_query
def dedup_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("url", *KEY, "title")


@_query
def dedup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.dedup_text(training.resolve_headlines(tables.headlines(spark, sf_dir)))


@_query
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = select.newest_first(select.with_url(_articles(spark, sf_dir)))
    return ordered.select(*KEY, "url", _when())


@_query
def top_n_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = select.select_articles(_articles(spark, sf_dir), config.MAX_ARTICLES)
    return top.select(*KEY, "url", "title", _when())


@_query
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.head_n(training.resolve_headlines(tables.headlines(spark, sf_dir)))


# Topics


@_query
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = default_lexicon()
    hits = topics.add_keyword_hits(_texts(spark, sf_dir), lexicon).drop("text")
    return topics.explode_labels(hits, lexicon, "hits").drop("label_ord")


@_query
def keyword_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = default_lexicon()
    hits = topics.add_keyword_hits(_texts(spark, sf_dir), lexicon)
    scored = topics.add_keyword_norm(hits, lexicon).select(*KEY, "keyword")
    rows = topics.explode_labels(scored, lexicon, "keyword")
    return rows.select(*KEY, "label", F.round("keyword", DIGITS).alias("keyword"))


@_query
def ngram_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = topics.add_term_counts(_texts(spark, sf_dir), default_lexicon())
    return counted.select(*KEY, F.inline("term_counts"))


@_query
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = default_lexicon()
    counted = topics.add_term_counts(_texts(spark, sf_dir), lexicon).drop("text")
    return topics.term_weights(counted, lexicon).withColumn("weight", F.round("weight", DIGITS))


@_query
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = default_lexicon()
    counted = topics.add_term_counts(_texts(spark, sf_dir), lexicon)
    scored = topics.add_cosine(counted, lexicon).select(*KEY, "cosine")
    rows = topics.explode_labels(scored, lexicon, "cosine")
    return rows.select(*KEY, "label", F.round("cosine", DIGITS).alias("cosine"))


@_query
def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = default_lexicon()
    scored = topics.score_text(_texts(spark, sf_dir), lexicon).select(*KEY, "combined", "scores")
    rows = topics.explode_labels(scored, lexicon, "combined", "scores")
    return rows.select(
        *KEY, "label", F.round("combined", DIGITS).alias("combined"),
        F.round("scores", DIGITS).alias("score"),
    )


@_query
def classify_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdict(_classified(spark, sf_dir), "url")


@_query
def classify_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without a title cannot be scored; they stay, as Unknown."""
    untitled = _articles(spark, sf_dir).withColumn(
        "title", F.when(F.col("entry_ord") % 11 != 0, F.col("title"))
    )
    return _verdict(topics.classify_articles(untitled, default_lexicon()), *KEY)


@_query
def classify_custom_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = default_lexicon(CUSTOM_LABELS)
    return _verdict(topics.classify_articles(_kept(spark, sf_dir), lexicon), "url")


@_query
def classify_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    def load():
        """A stand-in model: labels score by how often their initial occurs in the text."""

        def score(text: str, labels: list[str]) -> dict:
            low = text.lower()
            weights = [1 + low.count(label[0].lower()) for label in labels]
            total = sum(weights)
            ranked = sorted(zip(labels, weights), key=lambda pair: -pair[1])
            return {
                "labels": [label for label, _ in ranked],
                "scores": [weight / total for _, weight in ranked],
            }

        return score

    scored = backends.classify_with_backend(
        _kept(spark, sf_dir), default_lexicon(), base_scorer=load
    )
    return _verdict(scored, "url")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.document_entries(tables.load(spark, sf_dir, "documents"))
    predicted = topics.classify_articles(
        normalize.normalize_entries(docs, tables.AS_OF), default_lexicon()
    ).withColumnRenamed("entry_ord", "doc_id")
    expected = tables.load(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "Technology").otherwise("Politics").alias("expected")
    )
    return accuracy.score_cases(predicted, expected, "doc_id")


@_query
def accuracy_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir)


@_query
def accuracy_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    overall = accuracy.accuracy(_cases(spark, sf_dir))
    return overall.withColumn("accuracy", F.round("accuracy", DIGITS))


# Summaries


@_query
def extract_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.load(spark, sf_dir, "pages").select("page_id", "html")
    return summaries.extract_body(pages)


@_query
def choose_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = summaries.choose_body(_kept(spark, sf_dir), _bodies(spark, sf_dir))
    return chosen.select("url", "body", "body_source")


@_query
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = summaries.choose_body(_kept(spark, sf_dir), _bodies(spark, sf_dir))
    return summaries.build_prompts(chosen)


@_query
def resolve_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.resolve_responses(tables.responses(spark, sf_dir))


@_query
def attempt_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.attempt_error_classes(tables.responses(spark, sf_dir))


@_query
def clean_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns, with markup put around their sentences."""
    chat = tables.load(spark, sf_dir, "conversations")
    marked = F.concat(
        F.lit("### Notes_on `it`\r\n 1. **"), F.replace(F.col("text"), F.lit(". "), F.lit("**\n - *")),
        F.lit("*\n\n • __end__\t of_it_all"),
    )
    return chat.select("conv_id", "turn", clean_summary(marked).alias("summary"))


@_query
def fallback_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.load(spark, sf_dir, "documents")
    return docs.select("doc_id", fallback_summary(F.col("text")).alias("summary"))


@_query
def summarize_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = summaries.resolve_responses(tables.responses(spark, sf_dir))
    done = summaries.summarize_articles(_kept(spark, sf_dir), _bodies(spark, sf_dir), resolved)
    return done.select("url", "summary", "summary_source", "body_source")


@_query
def summary_cache_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = cache.pending(_kept(spark, sf_dir), tables.cached_summaries(spark, sf_dir))
    return waiting.select("url", "title")


@_query
def summary_cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = summaries.resolve_responses(tables.responses(spark, sf_dir))
    fresh = resolved.select(
        "url", clean_summary(F.col("response_text")).alias("summary"),
        F.lit(config.FROM_MODEL).alias("summary_source"),
        F.lit(config.FEED_DESCRIPTION).alias("body_source"),
        F.col("attempt").cast("long").alias("version"),
    )
    return cache.merge(tables.cached_summaries(spark, sf_dir), fresh)


@_query
def summary_cache_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tables.cached_summaries(spark, sf_dir)
    newest = cache.merge(stored, stored.limit(0))
    shown = cache.with_cached_summary(_kept(spark, sf_dir), newest)
    return shown.select("url", "summary", "summary_source", "body_source")


# Training data


def _headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.resolve_headlines(tables.headlines(spark, sf_dir))


def _topic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.topic_headlines(tables.headlines(spark, sf_dir), n=None)
    return training.nli_pairs(rows)


@_query
def resolve_headline_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headlines(spark, sf_dir)


@_query
def keyword_topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.keyword_topic_filter(_headlines(spark, sf_dir))


@_query
def nli_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topic_pairs(spark, sf_dir)


@_query
def pair_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.pair_class_counts(_topic_pairs(spark, sf_dir))


@_query
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.train_val_split(_topic_pairs(spark, sf_dir))


@_query
def nli_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.with_hypothesis(_topic_pairs(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.map_categories(_headlines(spark, sf_dir), CATEGORY_RULES)


@_query
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = training.nli_pairs(_labelled(spark, sf_dir), target=F.col("category"))
    return training.balanced_sample(pairs.select("text", "category", "label"))


@_query
def train_classifier_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trains on headline categories, evaluates held-out rows, saves, reloads and applies."""
    rows = training.train_val_split(_labelled(spark, sf_dir), by=["text"])
    path = shared_folder(spark, "model")
    fitted = model.train_classifier(rows.filter("split = 'train'"))
    held_out = rows.filter("split = 'validation'")
    measured = model.evaluate_classifier(fitted, held_out)
    model.save_model(fitted, path)
    applied = backends.classify_with_backend(
        held_out.select(F.col("text").alias("title"), F.lit("").alias("description"), "category")
        .withColumnRenamed("category", "expected"),
        default_lexicon(), model_path=path,
    )
    return applied.agg(
        F.count("*").alias("n_validation"),
        F.round(F.avg((F.col("category") == F.col("expected")).cast("int")), 2).alias("reloaded_accuracy"),
    ).withColumns({
        "accuracy": F.round(F.lit(measured["accuracy"]), 2),
        "log_loss": F.round(F.lit(measured["log_loss"]), 2),
    })


# Aggregations and report views


@_query
def overview_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    overall = metrics.overview_metrics(_enriched(spark, sf_dir))
    return overall.withColumn("mean_confidence", F.round("mean_confidence", DIGITS))


@_query
def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.category_distribution(_classified(spark, sf_dir))


@_query
def summary_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary_source_counts(_enriched(spark, sf_dir))


@_query
def tab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tab_counts(_classified(spark, sf_dir))


@_query
def stage_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stage_row_counts(_articles(spark, sf_dir), _enriched(spark, sf_dir))


@_query
def article_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.article_report(_enriched(spark, sf_dir))
    return rows.withColumn("n_lines", F.size("summary_lines")).drop("summary_lines")


@_query
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.score_breakdown(_classified(spark, sf_dir))
    return rows.withColumn("score", F.round("score", DIGITS))


@_query
def summary_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary_paragraphs(_enriched(spark, sf_dir))


# Streaming


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = ingest.stream_table(spark, f"{sf_dir}/documents*.parquet", schema)
    return tables.document_entries(docs)


@_query
def stream_dedup_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = normalize.normalize_entries(_document_stream(spark, sf_dir), tables.AS_OF)
    root = shared_folder(spark, "stream")
    unique = ingest.dedup_stream(articles).select("url")
    ingest.append_stream(unique, f"{root}/urls", f"{root}/state").awaitTermination()
    return spark.read.schema("url string").parquet(f"{root}/urls")


@_query
def stream_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first article of every URL, from a stream with exact state."""
    articles = normalize.normalize_entries(_document_stream(spark, sf_dir), tables.AS_OF)
    root = shared_folder(spark, "stream")
    rows = ingest.first_of_url_stream(articles)
    ingest.append_stream(rows, f"{root}/log", f"{root}/state", state_store=ingest.ROCKS_DB).awaitTermination()
    log = spark.read.schema(rows.schema).parquet(f"{root}/log")
    return ingest.current_firsts(log).select(*KEY, "url", "title", _when())


@_query
def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = default_lexicon()
    root = shared_folder(spark, "stream")
    ingest.enrich_stream(
        _document_stream(spark, sf_dir), f"{root}/articles", f"{root}/state", tables.AS_OF,
        lambda fresh: topics.classify_articles(fresh, lexicon),
    ).awaitTermination()
    return _verdict(spark.read.parquet(f"{root}/articles"), "url")


# The whole flow


@_query
def enriched_top_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow for the newest articles only."""
    return _enriched(spark, sf_dir, config.MAX_ARTICLES).select(
        *KEY, "url", "title", _when(), "category", "summary", "body_source",
    )


@_query
def enriched_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select(
        *KEY, "title", "description", "url", "source", _when(), "category", "confidence",
        "summary", "summary_source", "body_source",
    )


@_query
def enriched_by_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow over the caller's feeds in the caller's order, with a batch scorer that fails at times.

    Feeds that answered with an error are disabled, the others come in reverse; no responses.
    """
    listed = tables.feeds(spark, sf_dir)
    registry = listed.withColumn("enabled", F.col("http_status") == 200).withColumn("feed_ord", 1000 - F.col("feed_ord"))

    def load():
        """A stand-in model: labels score by how often their initial occurs; it takes no odd `q`."""

        def one(text: str, labels: list[str]) -> dict:
            low = text.lower()
            if low.count("q") % 2:
                raise ValueError("odd text")
            weights = [1 + low.count(label[0].lower()) for label in labels]
            ranked = sorted(zip(labels, weights), key=lambda pair: -pair[1])
            return {
                "labels": [label for label, _ in ranked],
                "scores": [weight / sum(weights) for _, weight in ranked],
            }

        return lambda texts, labels: [one(text, labels) for text in texts]

    def classify(articles: DataFrame) -> DataFrame:
        return backends.classify_with_backend(
            articles, default_lexicon(), base_scorer=load, batch_size=64, error_column="classify_error"
        )

    done = enrich_articles(
        tables.entries(spark, sf_dir), tables.web_pages(spark, sf_dir), None, default_lexicon(),
        tables.AS_OF, classify=classify, registry=registry,
    )
    return _verdict(done, *KEY, "url", "classify_error", "summary", "summary_source", "body_source")
