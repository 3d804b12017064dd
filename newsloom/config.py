"""Constants of the article flow."""

from __future__ import annotations

# Results depend on them.
LABELS = ("Technology", "Business", "Politics", "Sports", "Entertainment")
UNKNOWN = "Unknown"
DEFAULT_TITLE = "Untitled"
MAX_ARTICLES = 30
DESCRIPTION_CHARS = 300
CLASSIFY_CHARS = 200
KEYWORD_WEIGHT = 0.6
COSINE_WEIGHT = 0.4
TEMPERATURE = 0.2
CONFIDENCE_DIGITS = 4
PAGE_BODY_CHARS = 8000
FEED_BODY_CHARS = 1200
MAX_ATTEMPTS = 5
MIN_SENTENCE_CHARS = 15
EMPTY_SUMMARY = "No summary available — article description is empty."
SECONDS_PER_SUMMARY = 5
HIGH_CONFIDENCE = 0.70
MEDIUM_CONFIDENCE = 0.50
MAX_HEADLINES = 2000
TOPIC_KEYWORDS = (
    "tech", "technology", "software", "hardware", "internet", "digital",
    "computer", "mobile", "startup", "innovation", "cyber", "ai",
    "artificial intelligence", "science", "gadget", "app", "it ",
)
HEADLINE_TEXT_COLUMNS = ("headline_text", "headline", "title", "text")
HEADLINE_CATEGORY_COLUMNS = ("headline_category", "category", "label", "section")
TARGET_CATEGORY = "Technology"
PAIR_POSITIVE = 2
PAIR_NEGATIVE = 0
VALIDATION_PERCENT = 20
SPLIT_SEED = 42
SAMPLE_PER_CLASS = 500
RATE_LIMIT_MARKS = (
    "429", "quota", "rate limit", "resource_exhausted", "resource exhausted", "too many requests",
)
NOT_FOUND_MARKS = ("model not found", "404")
SUMMARY_MARKS = (r"\*{1,2}([^*]+)\*{1,2}", "_{1,2}([^_]+)_{1,2}", "`([^`]+)`")
HEADING_MARK = "#{1,6}"
NUMBER_MARK = r"\p{Nd}+[.)]"
BULLET_MARK = "[-•*]"
SENTENCE_END = "[.!?]"
# End of fixed values.

# Widest bar of a distribution, in blocks; longer ones are scaled down together.
BAR_WIDTH = 1000

# Names written to `summary_source`, `body_source` and read from `responses.model`.
FROM_MODEL = "model"
FROM_FALLBACK = "fallback"
FULL_ARTICLE = "full_article"
FEED_DESCRIPTION = "rss_description"
PRIMARY_MODEL = "primary"
BACKUP_MODEL = "backup"

INSTRUCTION = (
    "Summarise the news article for a reader who has not seen it. Use plain paragraphs "
    "separated by one blank line, keep names and figures as written, use no lists, headings "
    "or markup, and stay within 100 words."
)
