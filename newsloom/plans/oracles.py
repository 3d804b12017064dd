"""DuckDB SQL for the registered queries, generated from the same constants.

TF-IDF is spelled out the long way here, refitting the small corpus of each article, so it
checks the closed form the Spark side uses.
"""

from __future__ import annotations

import re

from newsloom import config
from newsloom.functions import pages
from newsloom.functions.terms import TOKEN
from newsloom.functions.text import WS_CHARS
from newsloom.lexicon import DEFAULT_PHRASES, default_stop_words
from newsloom.plans.catalog import CATEGORY_RULES, CUSTOM_LABELS

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
DIGITS = 6


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {s(WS_CHARS)})"


def gsub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {s(pattern)}, {to}, 'g')"


def squeeze(x: str) -> str:
    return f"trim({gsub(x, WS + '+', s(' '))})"


def clean(x: str) -> str:
    x = gsub(x, "<[^>]+>", "''")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        x = f"replace({x}, {s(entity)}, {s(char)})"
    return squeeze(gsub(x, r"&#\p{Nd}+;", "''"))


def has_any(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, {s(w)})" for w in words) + ")"


def percent(x: str) -> str:
    return f"cast(cast(round_even({x} * 100, 0) as int) as varchar) || '%'"


def decoded(x: str) -> str:
    """Character references, each looked up in one list of all names."""
    names = "map {" + ", ".join(f"{s(k)}: {s(v)}" for k, v in pages.NAMED.items() if "\0" not in v) + "}"
    c1 = "map {" + ", ".join(f"{n}: {s(c)}" for n, c in pages.C1.items()) + "}"
    ref = f"regexp_extract(pt, {s(f'^({pages.REFERENCE});')}, 1)"
    number = f"try_cast(case when lower({ref}[2]) = 'x' then '0x' || {ref}[3:] else {ref}[2:] end as bigint)"
    char = (
        f"case when {number} = 0 or {number} > 1114111 or {number} between 55296 and 57343 then chr(65533) "
        f"else coalesce({c1}[{number}], chr(cast({number} as int))) end"
    )
    part = (
        f"case when {ref} = '' then '&' || pt when {ref}[1] = '#' then {char} || pt[length({ref}) + 2:] "
        f"else coalesce({names}[{ref}] || pt[length({ref}) + 2:], '&' || pt) end"
    )
    return (
        f"case when contains({x}, '&') then array_to_string(list_transform(string_split({x}, '&'), "
        f"lambda pt, ix: case when ix = 1 then pt else {part} end), '') else {x} end"
    )


def lines_of(x: str) -> str:
    x = gsub(x, r"[\t\x0b-\r\x1c-\x1f\x{85}\p{Z}]+", "' '")
    x = gsub(x, r" *\n[ \n]*", "chr(10)")
    return f"trim({x}, ' ' || chr(10))"


def body_ctes(source: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """CTEs that end in `bodies` (page_id, url, body) from `source` (page_id, url, html).

    Every tag of a page is a row here, and nesting depths are window sums. Depth is counted from
    its lowest point so far, so stray end tags do not matter; a piece is in a closed element if the
    depth falls below its own later on.
    """
    raw = r"(?is)<(?:script\b[^>]*>.*?(?:</script\s*>|\z)|style\b[^>]*>.*?(?:</style\s*>|\z))"
    clean = gsub(gsub("html", r"(?s)<!--.*?(?:-->|\z)", "''"), raw, "''")
    kinds = (*pages.KINDS, *pages.OPEN_PARTS)

    def each(template: str, names=kinds) -> str:
        return ", ".join(template.format(k=k) for k in names)

    def any_of(prefix: str, names) -> str:
        return "(" + " or ".join(f"{prefix}_{k}" for k in names) + ")"

    ways = (
        "start_article and not soft", "start_article", "start_body and not soft", "first_tag = 'p'", "start_body",
    )
    block_tags = ", ".join(map(s, pages.BLOCK_TAGS))
    headings = ", ".join(map(s, pages.HEADINGS))
    pieces = "string_split(clean, '<')"
    letters = r"regexp_replace({x}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g')"
    return {
        "page_pieces": ((source,), f"""
select page_id, url, ord, case when ord = 1 then '' else lower(regexp_extract(piece, '^/?[a-zA-Z][a-zA-Z0-9]*')) end as tag,
  case when ord = 1 then piece when not regexp_matches(piece, '^([!?/]|[a-zA-Z])') then '<' || piece
    when contains(piece, '>') then piece[strpos(piece, '>') + 1:] else '' end as txt
from (select page_id, url, unnest({pieces}) as piece, generate_subscripts({pieces}, 1) as ord
  from (select page_id, url, {clean} as clean from {source}))"""),
        "page_depths": (("page_pieces",), f"""
select *, {each("depth_{k} - least(0, min(depth_{k}) over w) as rise_{k}")} from (
  select *, ltrim(tag, '/') as tag_name, {each("sum(case tag when '{k}' then 1 when '/{k}' then -1 else 0 end) over w as depth_{k}")}
  from page_pieces window w as (partition by page_id order by ord))
window w as (partition by page_id order by ord)"""),
        "page_marks": (("page_depths",), f"""
select page_id, url, ord, tag, tag_name, {decoded("txt")} as txt,
  {each("rise_{k} > min(rise_{k}) over later as in_{k}")}, {each("rise_{k} > 0 as start_{k}", pages.OPEN_PARTS)},
  sum(case when ord = 1 or tag_name in ({block_tags}) then 1 else 0 end) over w as block
from page_depths window w as (partition by page_id order by ord),
  later as (partition by page_id order by ord rows between current row and unbounded following)"""),
        "page_blocks": (("page_marks",), f"""
select page_id, any_value(url) as url, block, string_agg(case when tag_name = 'br' then chr(10) else '' end || txt, '' order by ord) as txt,
  arg_min(tag, ord) as first_tag, arg_min({any_of("in", pages.HARD_PARTS)}, ord) as hard,
  arg_min({any_of("in", pages.SOFT_PARTS)}, ord) as soft, {each("arg_min(start_{k}, ord) as start_{k}", pages.OPEN_PARTS)},
  sum(length({letters.format(x="txt")})) as n, sum(case when in_a then length({letters.format(x="txt")}) else 0 end) as linked
from page_marks group by page_id, block"""),
        "page_lines": (("page_blocks",), "select *, " + lines_of("txt") + f""" as ln from page_blocks
where not hard and (2 * linked <= n or first_tag in ({headings}))"""),
        "bodies": ((source, "page_lines"), f"""
select p.page_id, p.url, left(coalesce({", ".join(f"way_{k}" for k in range(len(ways)))}), 8000) as body
from {source} p left join (select page_id, {", ".join(
    f"string_agg(ln, chr(10) order by block) filter ({way} and ln <> '') as way_{k}" for k, way in enumerate(ways)
)} from page_lines group by page_id) t on t.page_id = p.page_id"""),
    }


def clean_summary(x: str) -> str:
    for mark in config.SUMMARY_MARKS:
        x = gsub(x, mark, r"'\1'")
    x = gsub(x, f"{config.HEADING_MARK}{WS}*", "''")
    line = f"regexp_replace(regexp_replace(ln, {s(f'^{WS}*{config.NUMBER_MARK}{WS}+')}, ''), {s(f'^{WS}*{config.BULLET_MARK}{WS}+')}, '')"
    x = f"array_to_string([{line} for ln in string_split_regex({x}, {s(LINE_BREAK)})], chr(10))"
    blocks = f"[{squeeze('bl')} for bl in string_split_regex({x}, {s(rf'\n{WS}*\n')})]"
    return f"array_to_string([bk for bk in {blocks} if bk <> ''], chr(10) || chr(10))"


def fallback(x: str) -> str:
    marked = gsub(strip(x), f"({config.SENTENCE_END}){WS}+", r"'\1' || chr(31)")
    parts = f"[{strip('pt')} for pt in string_split({marked}, chr(31))]"
    kept = f"array_to_string([sn for sn in {parts} if length(sn) > 15], chr(10) || chr(10))"
    return (
        f"case when coalesce({x}, '') = '' then {s(config.EMPTY_SUMMARY)} "
        f"else coalesce(nullif({kept}, ''), {strip(x)}) end"
    )


def when_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def story(text: str) -> str:
    return f"'https://news.example/story/' || md5(coalesce({text}, ''))"


def event_time(row_id: str) -> str:
    return f"(timestamp '2024-01-01' + to_minutes(cast((({row_id} // 3) * 7919) % 43200 as bigint)))"


FIRST_LINE = "split_part(text, chr(10), 1)"
MAIL = f"strftime({event_time('doc_id')}, '%a, %d %b %Y %H:%M:%S')"
ISO = f"strftime({event_time('doc_id')}, '%Y-%m-%dT%H:%M:%SZ')"


def parsed(x: str) -> str:
    mail = f"replace(regexp_replace({x}, '^[A-Za-z]+, ', ''), 'GMT', '+0000')"
    return (
        f"case when regexp_matches({x}, '^[0-9][0-9][0-9][0-9]-') "
        f"then try_cast({x} as timestamptz) at time zone 'UTC' "
        f"else try_strptime({mail}, '%d %b %Y %H:%M:%S %z') at time zone 'UTC' end"
    )


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: tuple[str, ...], sql: str) -> None:
    CTES[name] = (needs, sql)


_cte("doc_entries", (), f"""
select cast(regexp_extract(source, '([0-9]+)$', 1) as int) as feed_ord, doc_id as entry_ord, source,
  {FIRST_LINE} as title,
  case when doc_id % 4 = 0 then '' else text end as summary,
  case when doc_id % 4 = 0 then text end as description,
  case when doc_id % 17 = 5 then '' when doc_id % 17 <> 3 then {story('text')} end as link,
  case when doc_id % 17 in (3, 5) then {story('text')} end as first_href,
  case when doc_id % 13 = 0 then 'yesterday' when doc_id % 13 = 3 then {MAIL} || ' +0530'
    when doc_id % 13 not in (1, 2) then {MAIL} || ' GMT' end as published,
  case when doc_id % 13 in (0, 1) then {ISO} end as updated
from documents""")
_cte("page_entries", (), f"""
select 1000 as feed_ord, page_id as entry_ord,
  regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as source,
  regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title,
  html as summary, cast(null as varchar) as description,
  url as link, cast(null as varchar) as first_href,
  strftime({event_time('page_id')}, '%Y-%m-%dT%H:%M:%SZ') as published,
  cast(null as varchar) as updated
from pages""")
_cte("entries", ("doc_entries", "page_entries"),
     "select * from doc_entries union all by name select * from page_entries")


def _normalized(source: str) -> str:
    return f"""
select feed_ord, entry_ord, {clean("coalesce(title, 'Untitled')")} as title,
  left({clean("coalesce(nullif(summary, ''), nullif(description, ''), '')")}, 300) as description,
  coalesce(nullif(link, ''), first_href, '') as url, source,
  coalesce({parsed('published')}, {parsed('updated')}, timestamp '2024-03-01') as published
from {source}"""


_cte("articles", ("entries",), _normalized("entries"))
_cte("doc_articles", ("doc_entries",), _normalized("doc_entries"))


def _first_per_url(source: str) -> str:
    return (
        "select * exclude (rn) from (select *, row_number() over "
        f"(partition by url order by feed_ord, entry_ord) as rn from {source} where url <> '') "
        "where rn = 1"
    )


_cte("kept", ("articles",), _first_per_url("articles"))
_cte("doc_kept", ("doc_articles",), _first_per_url("doc_articles"))


def _text(source: str) -> str:
    text = strip("title || '. ' || left(coalesce(description, ''), 200)")
    return f"select *, {text} as text from {source}"


_cte("all_texts", ("articles",), _text("articles"))
_cte("kept_texts", ("kept",), _text("kept"))
_cte("doc_texts", ("doc_articles",), _text("doc_articles"))
_cte("doc_kept_texts", ("doc_kept",), _text("doc_kept"))
_cte("untitled", ("articles",),
     "select * replace (case when entry_ord % 11 <> 0 then title end as title) from articles")
_cte("untitled_texts", ("untitled",), _text("untitled"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(cell) for cell in row) + ")" for row in rows)


def scoring(texts: str, labels=config.LABELS, prefix: str = "") -> dict[str, tuple[tuple[str, ...], str]]:
    """CTEs `hits, keyword, tokens, terms, weights, cosine, scored` over one set of texts."""
    p = prefix
    n_docs = 1 + len(labels)
    label_rows = _values((k, s(label)) for k, label in enumerate(labels))
    phrase_rows = _values(
        (k, j, s(phrase), len(phrase.split()))
        for k, label in enumerate(labels)
        for j, phrase in enumerate(DEFAULT_PHRASES.get(label, ()))
    )
    stop = "[" + ", ".join(s(w) for w in default_stop_words()) + "]"
    found = f"[tk for tk in regexp_extract_all(lower(text), {s(TOKEN)}) if not list_contains({stop}, tk)]"
    grams = "list_concat(toks, [toks[i] || ' ' || toks[i + 1] for i in range(1, len(toks))])"
    return {
        f"{p}labels_": ((), f"select * from (values {label_rows}) as v(label_ord, label)"),
        f"{p}phrases": ((), f"select * from (values {phrase_rows}) as v(label_ord, phrase_ord, phrase, w)"),
        f"{p}texts": ((texts,), f"select * from {texts} where text is not null"),
        f"{p}hits": ((f"{p}texts", f"{p}labels_", f"{p}phrases"), f"""
select feed_ord, entry_ord, l.label_ord, any_value(l.label) as label,
  cast(coalesce(sum(case when contains(lower(text), phrase) then w else 0 end), 0) as double) as hits
from {p}texts cross join {p}labels_ l left join {p}phrases ph on ph.label_ord = l.label_ord
group by feed_ord, entry_ord, l.label_ord"""),
        f"{p}keyword": ((f"{p}hits",), f"""
select *, case when max(hits) over w > 0 then hits / max(hits) over w
  else cast(1.0 as double) / {len(labels)} end as keyword
from {p}hits window w as (partition by feed_ord, entry_ord)"""),
        f"{p}tokens": ((f"{p}texts",), f"""
select feed_ord, entry_ord, unnest({grams}) as term
from (select feed_ord, entry_ord, {found} as toks from {p}texts)"""),
        f"{p}terms": ((f"{p}tokens",),
            f"select feed_ord, entry_ord, term, count(*) as cnt from {p}tokens group by all"),
        f"{p}label_docs": ((f"{p}labels_", f"{p}phrases"), f"""
select l.label_ord, coalesce(string_agg(phrase, ' ' order by phrase_ord), any_value(l.label)) as text
from {p}labels_ l left join {p}phrases ph on ph.label_ord = l.label_ord group by l.label_ord"""),
        f"{p}label_terms": ((f"{p}label_docs",), f"""
select label_ord, term, count(*) as cnt from (
  select label_ord, unnest({grams}) as term from (select label_ord, {found} as toks from {p}label_docs))
group by all"""),
        f"{p}label_df": ((f"{p}label_terms",),
            f"select term, count(*) as d from {p}label_terms group by term"),
        f"{p}weights": ((f"{p}terms", f"{p}label_df"), f"""
select feed_ord, entry_ord, t.term, cnt, coalesce(d, 0) as label_docs,
  (1 + ln(cnt)) * (ln({1 + n_docs}.0 / (2 + coalesce(d, 0))) + 1) as weight
from {p}terms t left join {p}label_df f on f.term = t.term"""),
        f"{p}pairs": ((f"{p}texts", f"{p}label_terms", f"{p}label_df", f"{p}weights"), f"""
select a.feed_ord, a.entry_ord, lt.label_ord, coalesce(w.weight, 0) as text_weight,
  (1 + ln(lt.cnt)) * (ln({1 + n_docs}.0
    / (1 + f.d + case when w.term is null then 0 else 1 end)) + 1) as label_weight
from {p}texts a cross join {p}label_terms lt join {p}label_df f on f.term = lt.term
left join {p}weights w on w.feed_ord = a.feed_ord and w.entry_ord = a.entry_ord and w.term = lt.term"""),
        f"{p}cosine": ((f"{p}texts", f"{p}labels_", f"{p}pairs", f"{p}weights"), f"""
select a.feed_ord, a.entry_ord, l.label_ord, l.label,
  coalesce(dot / nullif(sqrt(text_norm) * sqrt(label_norm), 0), 0) as cosine
from {p}texts a cross join {p}labels_ l
left join (select feed_ord, entry_ord, label_ord, sum(text_weight * label_weight) as dot,
    sum(label_weight * label_weight) as label_norm from {p}pairs group by all) pr
  on pr.feed_ord = a.feed_ord and pr.entry_ord = a.entry_ord and pr.label_ord = l.label_ord
left join (select feed_ord, entry_ord, sum(weight * weight) as text_norm from {p}weights group by all) tn
  on tn.feed_ord = a.feed_ord and tn.entry_ord = a.entry_ord"""),
        f"{p}combined": ((f"{p}keyword", f"{p}cosine"), f"""
select k.feed_ord, k.entry_ord, k.label_ord, k.label,
  cast(0.6 as double) * keyword + cast(0.4 as double) * cosine as combined
from {p}keyword k join {p}cosine c on c.feed_ord = k.feed_ord and c.entry_ord = k.entry_ord
  and c.label_ord = k.label_ord"""),
        f"{p}scored": ((f"{p}combined",), f"""
select *, e / sum(e) over (partition by feed_ord, entry_ord) as score from (
  select *, exp((combined - max(combined) over (partition by feed_ord, entry_ord))
    / cast(0.2 as double)) as e from {p}combined)"""),
        f"{p}ranked": ((f"{p}scored",), f"""
select *, row_number() over (partition by feed_ord, entry_ord
  order by round(score, 12) desc, label_ord) as rnk from {p}scored"""),
        f"{p}verdicts": ((f"{p}ranked",), f"""
select feed_ord, entry_ord, max(case when rnk = 1 then label end) as category,
  round(max(case when rnk = 1 then score end), 4) as confidence,
  string_agg(label, ',' order by rnk) as ranking,
  round(max(case when rnk = 1 then score end), {DIGITS}) as top_score
from {p}ranked group by feed_ord, entry_ord"""),
        f"{p}classified": ((texts, f"{p}verdicts"), f"""
select a.* exclude (text), coalesce(category, 'Unknown') as category,
  coalesce(confidence, 0) as confidence, coalesce(ranking, '') as ranking, top_score
from {texts} a left join {p}verdicts v on v.feed_ord = a.feed_ord and v.entry_ord = a.entry_ord"""),
    }


for _prefix, _texts, _labels in (
    ("all_", "all_texts", config.LABELS),
    ("kept_", "kept_texts", config.LABELS),
    ("doc_", "doc_texts", config.LABELS),
    ("doc_kept_", "doc_kept_texts", config.LABELS),
    ("untitled_", "untitled_texts", config.LABELS),
    ("custom_", "kept_texts", CUSTOM_LABELS),
):
    for _name, (_needs, _sql) in scoring(_texts, _labels, f"{_prefix}s_").items():
        _cte(_name, _needs, _sql)

_cte("page_rows", (), "select page_id, url, html from pages")
for _name, (_needs, _sql) in body_ctes("page_rows").items():
    _cte(_name, _needs, _sql)
_cte("url_bodies", ("bodies",), """
select url, body from (select *, row_number() over (partition by url order by page_id) as rn
  from bodies where body is not null and url not in ('', '#')) where rn = 1""")
_cte("chosen", ("kept", "url_bodies"), f"""
select k.*, coalesce(b.body, left(nullif({strip('description')}, ''), 1200), {strip('title')}, '') as body,
  case when b.body is not null then 'full_article' else 'rss_description' end as body_source
from kept k left join url_bodies b on b.url = k.url""")
_cte("targets_", (), f"""
select page_id * 2 as target, url as target_url from pages
union all select doc_id * 2 + 1, {story('text')} from documents""")
_cte("responses_", ("targets_",), """
select coalesce(target_url, 'https://news.example/story/' || cast(conv_id as varchar)) as url,
  cast(floor((turn + 1) / 2 + conv_id % 4) as int) as attempt,
  case when conv_id % 4 < 2 then 'primary' else 'backup' end as model,
  case when kind >= 4 then '## **Summary**' || chr(10) || chr(10) || '- ' || text
    else ' ' || chr(10) || text end as response_text,
  case when kind = 1 then 'HTTP 404: model not found'
    when kind = 2 then case when turn > 2 then '429 Too Many Requests' else 'connection reset' end
  end as error_text
from (select *, (conv_id * 3 + turn) % 8 as kind from conversations) left join targets_ on target = conv_id""")
_cte("classed", ("responses_",), f"""
select *, case when {has_any('lower(error_text)', config.RATE_LIMIT_MARKS)} then 'rate_limit'
  when {has_any('lower(error_text)', config.NOT_FOUND_MARKS)} then 'model_not_found'
  when error_text is not null then 'other' end as error_class from responses_""")
_cte("resolved", ("classed",), f"""
select url, attempt, {strip('response_text')} as response_text from (
  select c.*, row_number() over (partition by url order by attempt, {strip('response_text')}) as rn
  from classed c where attempt between 1 and 5 and error_text is null
    and {strip('response_text')} <> '') w
where rn = 1 and not exists (select 1 from classed d where d.url = w.url and d.model = 'backup'
  and d.error_class = 'model_not_found' and d.attempt between 1 and 5 and d.attempt <= w.attempt)""")
_cte("summarized", ("chosen", "resolved"), f"""
select * exclude (cleaned, own_text), coalesce(cleaned, {fallback('own_text')}) as summary,
  case when cleaned is not null then 'model' else 'fallback' end as summary_source
from (select c.*, case when length(body) > 0 then nullif({clean_summary('response_text')}, '') end as cleaned,
    coalesce(nullif({strip('description')}, ''), {strip('title')}, '') as own_text
  from chosen c left join resolved r on r.url = c.url)""")
_cte("registry_articles", ("entries",), _normalized("""(
select e.* replace (1000 - r.feed_ord as feed_ord) from entries e join (
  select distinct source, cast(regexp_extract(source, '([0-9]+)$', 1) as int) as feed_ord from documents) r
on r.source = e.source where r.feed_ord % 5 <> 1)"""))
_cte("registry_kept", ("registry_articles",), _first_per_url("registry_articles"))
_cte("registry_texts", ("registry_kept",), _text("registry_kept"))
_cte("registry_scores", ("registry_texts",), f"""
select *, n / sum(n) over (partition by url) as score,
  row_number() over (partition by url order by n desc, label_ord) as rnk
from (select url, label_ord, label, cast(1 + length(lower(text))
    - length(replace(lower(text), lower(left(label, 1)), '')) as double) as n
  from registry_texts cross join (values {_values((k, s(label)) for k, label in enumerate(config.LABELS))}) as v(label_ord, label)
  where (length(lower(text)) - length(replace(lower(text), 'q', ''))) % 2 = 0)""")
_cte("registry_verdicts", ("registry_scores",), f"""
select url, max(case when rnk = 1 then label end) as category,
  round(max(case when rnk = 1 then score end), 4) as confidence,
  string_agg(label, ',' order by rnk) as ranking, round(max(case when rnk = 1 then score end), {DIGITS}) as top_score
from registry_scores group by url""")
_cte("enriched", ("kept_s_classified", "summarized"), """
select c.*, summary, summary_source, body_source from kept_s_classified c
join summarized z on z.url = c.url""")
_cte("cache_", (), f"""
select {story('text')} as url, 'cached ' || cast(doc_id as varchar) as summary,
  case when quality = 1 then 'model' else 'fallback' end as summary_source,
  'rss_description' as body_source, doc_id as version from labels join documents using (doc_id)""")
_cte("headlines_", (), """
select doc_id as row_ord, text, lang || '.' || source as category from documents
where text is not null and lang is not null and source is not null""")
_cte("topic_rows", ("headlines_",), f"""
select * from headlines_ where {has_any('lower(category)', config.TOPIC_KEYWORDS)}
  or {has_any('lower(text)', config.TOPIC_KEYWORDS)}""")
_cte("topic_kept", ("topic_rows",), """
select * exclude (rn) from (select *, row_number() over (partition by text order by row_ord) as rn
  from topic_rows) where rn = 1""")
_PAIR_LABELS = _values((s(label),) for label in config.LABELS)
_cte("pairs_", ("topic_kept",), f"""
select row_ord, text, c.category, case when c.category = 'Technology' then 2 else 0 end as label
from topic_kept cross join (values {_PAIR_LABELS}) as c(category)""")
_RULES = " ".join(
    f"when {has_any('lower(category)', marks)} then {s(label)}" for label, marks in CATEGORY_RULES.items()
)
_cte("labelled", ("headlines_",), f"""
select * from (select row_ord, text, case {_RULES} end as category from headlines_)
where category is not null""")
_cte("cases", ("doc_s_classified",), """
select doc_id, category, confidence, expected, category = expected as correct,
  case when category = expected then '✓' else '✗' end as mark
from doc_s_classified c join (select doc_id, case when quality = 1 then 'Technology'
  else 'Politics' end as expected from labels) l on l.doc_id = c.entry_ord""")


def _ordered(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in CTES and name not in seen:
            for need in CTES[name][0]:
                visit(need)
            seen.append(name)

    for name in names:
        visit(name)
    return seen


def query(body: str) -> str:
    """`body` behind the CTEs it names."""
    used = tuple(name for name in CTES if re.search(rf"\b{re.escape(name)}\b", body))
    parts = [f"{name} as materialized ({CTES[name][1]})" for name in _ordered(used)]
    return f"with {', '.join(parts)} {body}" if parts else body


VERDICT = "category, confidence, ranking, top_score"


def oracles() -> dict[str, str]:
    bodies = {
        "feed_ingest_report": """
select coalesce(f.feed_ord, a.feed_ord) as feed_ord, f.source, http_status, coalesce(retrieved, 0) as retrieved, coalesce(no_url, 0) as no_url,
  coalesce(n_kept, 0) as kept, coalesce(retrieved, 0) - coalesce(no_url, 0) - coalesce(n_kept, 0) as duplicates,
  case when f.feed_ord is null then 'unregistered' when http_status >= 400 and coalesce(retrieved, 0) = 0 then 'skipped'
    when coalesce(retrieved, 0) = 0 then 'empty' when http_status >= 400 then 'kept_despite_error'
    else 'ok' end as status
from (select source, ford as feed_ord, case when ford % 5 = 1 then 403 else 200 end as http_status
    from (select distinct source, cast(regexp_extract(source, '([0-9]+)$', 1) as int) as ford from documents)) f
full join (select feed_ord, count(*) as retrieved, count(*) filter (url = '') as no_url
  from articles group by 1) a on a.feed_ord = f.feed_ord
left join (select feed_ord, count(*) as n_kept from kept group by 1) k on k.feed_ord = a.feed_ord""",
        "sink_roundtrip": f"select url, {VERDICT} from kept_s_classified",
        "feed_xml_entries": f"""
select feed_ord, source, title, description, url, {when_text('published')} as published
from doc_articles""",
        "clean_html": f"select page_id, {clean('html')} as cleaned from pages",
        "normalize_entries": f"select * replace ({when_text('published')} as published) from articles",
        "resolve_url": "select feed_ord, entry_ord, coalesce(nullif(link, ''), first_href, '') as url from entries",
        "parse_published": f"select feed_ord, entry_ord, {when_text('published')} as published from articles",
        "classification_text": "select feed_ord, entry_ord, text from all_texts",
        "filter_no_url": "select feed_ord, entry_ord, url from articles where length(url) > 0",
        "filter_category": "select url, title, category from kept_s_classified where category = 'Technology'",
        "dedup_url": "select url, feed_ord, entry_ord, title from kept",
        "dedup_text": """
select row_ord, text, category from (select *, row_number() over (partition by text order by row_ord) as rn
  from headlines_) where rn = 1""",
        "newest_first": f"""
select feed_ord, entry_ord, url, {when_text('published')} as published from articles a where url <> ''
order by a.published desc, feed_ord, entry_ord""",
        "top_n_articles": f"""
select feed_ord, entry_ord, url, title, {when_text('published')} as published from kept k
order by k.published desc, feed_ord, entry_ord limit 30""",
        "head_n": "select row_ord, text, category from headlines_ order by row_ord limit 2000",
        "keyword_hits": "select feed_ord, entry_ord, label, hits from all_s_hits",
        "keyword_norm": f"select feed_ord, entry_ord, label, round(keyword, {DIGITS}) as keyword from all_s_keyword",
        "ngram_tokens": "select feed_ord, entry_ord, term, cnt from all_s_terms",
        "tfidf_terms": f"""
select feed_ord, entry_ord, term, cnt, label_docs, round(weight, {DIGITS}) as weight from all_s_weights""",
        "tfidf_cosine": f"select feed_ord, entry_ord, label, round(cosine, {DIGITS}) as cosine from all_s_cosine",
        "hybrid_scores": f"""
select feed_ord, entry_ord, label, round(combined, {DIGITS}) as combined, round(score, {DIGITS}) as score
from all_s_scored""",
        "classify_articles": f"select url, {VERDICT} from kept_s_classified",
        "classify_failures": f"select feed_ord, entry_ord, {VERDICT} from untitled_s_classified",
        "classify_custom_labels": f"select url, {VERDICT} from custom_s_classified",
        "classify_backend": f"""
select url, max(case when rnk = 1 then label end) as category,
  round(max(case when rnk = 1 then score end), 4) as confidence,
  string_agg(label, ',' order by rnk) as ranking, round(max(case when rnk = 1 then score end), {DIGITS}) as top_score
from (select *, n / sum(n) over (partition by url) as score,
    row_number() over (partition by url order by n desc, label_ord) as rnk
  from (select url, label_ord, label, cast(1 + length(lower(text))
      - length(replace(lower(text), lower(left(label, 1)), '')) as double) as n
    from kept_texts cross join kept_s_labels_))
group by url""",
        "accuracy_cases": "select * from cases",
        "accuracy_eval": f"""
select count(*) filter (correct) as correct, count(*) as total,
  round(avg(case when correct then 1.0 else 0.0 end), {DIGITS}) as accuracy from cases""",
        "extract_body": "select page_id, body from bodies",
        "choose_body": "select url, body, body_source from chosen",
        "build_prompts": f"""
select url, {s(config.INSTRUCTION)} as instruction,
  case when coalesce(source, '') <> '' then 'Source: ' || source || chr(10) else '' end
  || 'Title: ' || coalesce({strip('title')}, '') || chr(10) || chr(10) || 'Article:' || chr(10) || body as prompt
from chosen where length(body) > 0""",
        "resolve_responses": "select * from resolved",
        "attempt_error_classes": """
select error_class, count(*) as n_attempts from classed where error_text is not null group by 1""",
        "clean_summary": "select conv_id, turn, {} as summary from conversations".format(
            clean_summary(
                "('### Notes_on `it`' || chr(13) || chr(10) || ' 1. **' || replace(text, '. ', '**' || chr(10) "
                "|| ' - *') || '*' || chr(10) || chr(10) || ' • __end__' || chr(9) || ' of_it_all')"
            )
        ),
        "fallback_summary": f"select doc_id, {fallback('text')} as summary from documents",
        "summarize_articles": "select url, summary, summary_source, body_source from summarized",
        "summary_cache_pending": """
select url, title from kept k where not exists (select 1 from cache_ c where c.url = k.url)""",
        "summary_cache_merge": f"""
select url, summary, summary_source, body_source, version from (
  select *, row_number() over (partition by url order by version desc, age) as rn from (
    select *, 1 as age from cache_ union all
    select url, {clean_summary('response_text')}, 'model', 'rss_description', attempt, 0 from resolved))
where rn = 1""",
        "summary_cache_view": """
select k.url, c.summary, c.summary_source, c.body_source from kept k
left join (select *, row_number() over (partition by url order by version desc) as rn from cache_) c
  on c.url = k.url and c.rn = 1""",
        "resolve_headline_columns": "select * from headlines_",
        "keyword_topic_filter": "select * from topic_rows",
        "nli_pairs": "select row_ord, text, category, label from pairs_",
        "pair_class_counts": """
select count(*) filter (label = 2) as positives, count(*) filter (label <> 2) as negatives,
  count(*) as total from pairs_""",
        "train_val_split": """
select row_ord, text, category, label,
  case when cast('0x' || substr(md5('42' || chr(31) || text || chr(31) || category), 1, 8) as bigint) % 100 < 20
    then 'validation' else 'train' end as split from pairs_""",
        "nli_hypothesis": """
select row_ord, text, category, label, 'This text is about ' || category || '.' as hypothesis from pairs_""",
        "balanced_sample": f"""
select text, category, label from (
  select h.text, c.category, case when c.category = h.category then 2 else 0 end as label,
    row_number() over (partition by c.category, c.category = h.category
      order by md5('42' || chr(31) || h.text || chr(31) || c.category)) as rn
  from labelled h cross join (values {_PAIR_LABELS}) as c(category)) where rn <= 500""",
        "overview_metrics": f"""
select count(*) as articles, count(distinct category) as categories,
  round(avg(confidence), {DIGITS}) as mean_confidence, count(summary) as summaries,
  cast(count(summary) as varchar) || '/' || cast(count(*) as varchar) as summarised from enriched""",
        "category_distribution": """
select category, count(*) as n_articles, repeat('█', cast(case when max(count(*)) over () <= 1000 then count(*)
  else ceil(count(*) * 1000.0 / max(count(*)) over ()) end as int)) as bar
from kept_s_classified group by category""",
        "summary_source_counts": "select summary_source, count(*) as n_articles from enriched group by 1",
        "tab_counts": """
select tab_ord, tab, n_articles, case when n_articles = 1 then 'article' else 'articles' end as count_word from (
  select label_ord as tab_ord, label as tab, count(c.url) as n_articles
  from kept_s_labels_ l left join kept_s_classified c on c.category = l.label group by 1, 2
  union all select 5, 'All', count(*) from kept_s_classified)""",
        "stage_row_counts": """
select 0 as stage_ord, 'url_filter' as stage, count(*) as rows_in, count(*) filter (url <> '') as rows_out,
  0 as estimated_seconds from articles
union all select 1, 'dedup', (select count(*) from articles where url <> ''), count(*), 0 from kept
union all select 2, 'classify', count(*), count(*) filter (category <> 'Unknown'), 0 from enriched
union all select 3, 'summarise', count(*), count(summary), count(*) * 5 from enriched""",
        "article_report": f"""
select url, source, category, case when confidence >= 0.7 then 'high' when confidence >= 0.5 then 'medium'
    else 'low' end as band, {percent('confidence')} as confidence_text,
  cast(floor(confidence * 100) as int) as bar_percent,
  strftime(published, '%d %b %Y · %H:%M UTC') as date_text, left(title, 55) as preview_title,
  left(description, 80) as preview_description,
  case when summary_source = 'model' then '★' else '○' end as summary_flag,
  case when summary_source = 'model' then 'Model' else 'Fallback' end as summary_name,
  case when body_source = 'full_article' then 'Full article' else 'RSS description' end as body_name,
  len(string_split(summary, chr(10))) as n_lines from enriched""",
        "score_breakdown": f"""
select c.url, rnk - 1 as rank, label, round(score, {DIGITS}) as score,
  cast(floor(score * 100) as int) as bar_percent, {percent('score')} as score_text,
  label = category as is_top
from kept_s_ranked r join kept_s_classified c on c.feed_ord = r.feed_ord and c.entry_ord = r.entry_ord""",
        "summary_paragraphs": f"""
select url, i - 1 as paragraph, replace(replace(replace(replace(replace(parts[i], '&', '&amp;'), '<', '&lt;'),
  '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as html
from (select url, parts, unnest(range(1, len(parts) + 1)) as i from (
  select url, [pp for pp in [{strip('pt')} for pt in string_split(summary, chr(10) || chr(10))] if pp <> ''] as parts
  from enriched))""",
        "enriched_by_registry": f"""
select k.feed_ord, k.entry_ord, k.url, case when v.url is null then 'ValueError: odd text' end as classify_error,
  {fallback("coalesce(nullif(" + strip("k.description") + ", ''), " + strip("k.title") + ", '')")} as summary,
  'fallback' as summary_source,
  case when b.body is not null then 'full_article' else 'rss_description' end as body_source,
  coalesce(v.category, 'Unknown') as category, coalesce(v.confidence, 0) as confidence,
  coalesce(v.ranking, '') as ranking, v.top_score
from registry_kept k left join registry_verdicts v on v.url = k.url left join url_bodies b on b.url = k.url""",
        "stream_first_rows": f"select feed_ord, entry_ord, url, title, {when_text('published')} as published from doc_kept",
        "stream_dedup_url": "select url from doc_kept",
        "stream_enrich": f"select url, {VERDICT} from doc_kept_s_classified",
        "enriched_top_articles": f"""
select feed_ord, entry_ord, url, title, {when_text('published')} as published, category, summary, body_source
from enriched e order by e.published desc, feed_ord, entry_ord limit {config.MAX_ARTICLES}""",
        "enriched_articles": f"""
select feed_ord, entry_ord, title, description, url, source, {when_text('published')} as published,
  category, confidence, summary, summary_source, body_source from enriched""",
    }
    return {name: query(body) for name, body in bodies.items()}
