"""Personal data: patterns, and terms that reveal a person by what the corpus tells of them.

Patterns find the protected entities: e-mail and network addresses, card and phone numbers. The
corpus then says how much a term beside an entity gives it away. With document frequencies,

    PMI(term, entity) = log(N * df(term, entity) / (df(term) * df(entity)))

is the information they share and IC(entity) = log(N / df(entity)) what there is to know. A term
whose PMI reaches `disclosure` of the IC nearly determines the entity and is protected as well: its
occurrences in the entity's documents become spans of kind `term`. Both are counted over whole texts,
and each distinct text once: copies of a text tell nothing that the text alone does not.

No floor on the number of documents decides, but how likely chance is: with q = df(term, entity) /
df(term) and p = df(entity) / N, at most exp(-df(term) * KL(q || p)). A pair counts if that is at most
CHANCE, shared among the terms that occur with the entity twice or more. A pair in one document
cannot be judged: there any rare word is as near to the entity as a revealing one.

Sanitising writes a kind in place of a span (generalisation), or removes it.

Only documents that share an entity with another text are read again for their pairs. Counts are
summed within tasks before they are shuffled, and a bitmap of fixed size lets through only words,
or pairs, that later joins may ask for.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, documents_of, stored

KINDS = ("email", "ip", "card", "phone", "term")
CHANCE = 0.05
DISCLOSURE = 0.95
HELD_COUNTS = 200_000
# Room for rounding in a bound that leaves out pairs before they are judged.
ROUNDING = 1e-9
# Bits of a bitmap that prunes rows before a shuffle; a fuller one prunes less.
BITMAP = 1 << 23

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match starts at the head of a run of digits, so later starts in it need no trial.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{2,}")


def emails(text: str):
    """Spans of addresses; a run of name characters without an @ is read once."""
    at = text.find("@")
    end = 0
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    digits = part.lstrip("0") or "0"
    return len(digits) <= 3 and int(digits) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for found in ADDRESS.finditer(text):
        if all(map(_small, found.group().split("."))):
            spans.append((1, found.start(), found.end()))
    for found in CARD.finditer(text):
        if found.end() - found.start() >= 16:
            digits = found.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                spans.append((2, found.start(), found.end()))
    if "+" in text:
        for found in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, found.group())) <= 15:
                spans.append((3, found.start(), found.end()))
    return spans


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def entity_key(value: str) -> int:
    """A signed 64-bit key of a protected value, letter case and separators aside."""
    plain = re.sub(r"[\s().-]", "", value).lower()
    return int.from_bytes(hashlib.blake2b(plain.encode("utf-8"), digest_size=8).digest(), "little", signed=True)


def text_key(text: str) -> int:
    """A signed 64-bit key of a whole text."""
    octets = text.encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(octets, digest_size=8).digest(), "little", signed=True)


def free_words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words that touch no span."""
    covered = sorted((a, b) for _, a, b in spans)
    free, at, reach = [], 0, 0
    for m in WORD.finditer(text):
        while at < len(covered) and covered[at][0] < m.end():
            reach = max(reach, covered[at][1])
            at += 1
        if reach <= m.start():
            free.append((m.group().lower(), m.start(), m.end()))
    return free


def find_patterns(docs: DataFrame) -> DataFrame:
    """Pattern spans of every document, and the keys of its protected values."""
    rows = documents_of(docs, F.monotonically_increasing_id().alias("row"))

    def task(batches):
        for batch in batches:
            spans = [pattern_spans(t) for t in batch["text"]]
            counts = [Counter(k for k, _, _ in s) for s in spans]
            yield {
                "row": batch["row"], "doc_id": batch["doc_id"],
                **{f"n_{KINDS[k]}": [c[k] for c in counts] for k in range(4)},
                "base": [[{"kind": k, "start": a, "stop": b} for k, a, b in sorted(s)] for s in spans],
                "entities": [
                    sorted({entity_key(t[a:b]) for _, a, b in s}) for t, s in zip(batch["text"], spans)
                ],
                "digest": [text_key(t) for t in batch["text"]],
            }

    schema = (
        "row long, doc_id long, digest long, n_email long, n_ip long, n_card long, n_phone long, "
        "base array<struct<kind:int,start:int,stop:int>>, "
        "entities array<long>"
    )
    return arrow_rows(rows, task, schema)


def bitmap(rows: DataFrame, *columns: str) -> bytes:
    """BITMAP bits, in which those of all `rows` are set; see `in_bitmap`. Its size is fixed."""
    place = F.crc32(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).cast("binary")) % BITMAP
    words = rows.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).alias("bits")
    )
    found = np.zeros(BITMAP // 64, np.int64)
    for row in words.collect():
        found[row["word"]] = row["bits"]
    return found.tobytes()


def in_bitmap(bits: bytes, key: str) -> bool:
    place = zlib.crc32(key.encode("utf-8")) % BITMAP
    return bool(bits[place >> 3] >> (place & 7) & 1)


def checked(text: str, digest: int) -> str:
    if text_key(text) != digest:
        raise RuntimeError("rows are numbered otherwise than before; read them from files")
    return text


def term_frequencies(docs: DataFrame, found: DataFrame, wanted: bytes) -> DataFrame:
    """(term, df): the distinct texts that hold a word, of the words in the bitmap `wanted`."""

    def task(batches):
        counts = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(t for t in set(WORD.findall(text.lower())) if in_bitmap(wanted, t))
                if len(counts) >= HELD_COUNTS:
                    yield {"term": list(counts), "df": list(counts.values())}
                    counts.clear()
        yield {"term": list(counts), "df": list(counts.values())}

    texts = documents_of(docs, F.monotonically_increasing_id().alias("row")).select("row", "text")
    repeated = found.filter("not evidence").select("row")
    rows = arrow_rows(texts.join(repeated, "row", "left_anti").select("text"), task, "term string, df long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"))


def shared_entities(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, df_entity) of entities in two distinct texts or more, and who holds them.

    The latter has row, digest, evidence (whether the row stands for its text) and entity.
    """
    held = found.select("row", "digest", "evidence", F.explode("entities").alias("entity"))
    shared = held.groupBy("entity").agg(F.count_if("evidence").alias("df_entity")).filter("df_entity > 1")
    shared = stored(shared, "pii-entities")
    return shared, stored(held.join(shared.select("entity"), "entity"), "pii-holders")


def _pairs(docs: DataFrame, holders: DataFrame, task, schema: str) -> DataFrame:
    """`task` over row, digest, text and the shared entities of the rows that hold any."""
    texts = documents_of(docs, F.monotonically_increasing_id().alias("row")).select("row", "text")
    # A row's entities are bounded by its text.
    listed = holders.groupBy("row", "digest").agg(F.collect_list("entity").alias("entities"))
    return arrow_rows(texts.join(listed, "row").select("row", "digest", "text", "entities"), task, schema)


def pair_counts(docs: DataFrame, holders: DataFrame) -> DataFrame:
    """(entity, term, df_both): distinct texts that hold both, two or more.

    Rows without an entity tell how many of the distinct texts with shared entities hold a term.
    """

    def task(batches):
        counts = Counter()

        def out():
            return {
                "entity": [e for e, _ in counts], "term": [t for _, t in counts], "df": list(counts.values()),
            }

        for batch in batches:
            for text, digest, entities in zip(batch["text"], batch["digest"], batch["entities"]):
                terms = {t for t, _, _ in free_words(checked(text, digest), pattern_spans(text))}
                counts.update((None, t) for t in set(WORD.findall(text.lower())) & terms)
                for entity in entities:
                    counts.update((entity, t) for t in terms)
                    if len(counts) >= HELD_COUNTS:
                        yield out()
                        counts.clear()
        yield out()

    counted = _pairs(docs, holders.filter("evidence"), task, "entity long, term string, df long")
    return counted.groupBy("entity", "term").agg(F.sum("df").alias("df_both")).filter("df_both > 1")


def revealing_pairs(docs: DataFrame, found: DataFrame, shared: DataFrame, holders: DataFrame, disclosure: float) -> DataFrame:
    """(entity, term) pairs whose PMI reaches `disclosure` of the entity's information content.

    The texts that hold shared entities bound a term's frequency from below, and so its PMI from
    above. Words that are too common by that bound, which most texts hold, are not counted in all texts.
    """
    counted = stored(pair_counts(docs, holders), "pii-pairs")
    both = counted.filter("entity is not null")
    judged = both.groupBy("entity").agg(F.count("*").alias("judged"))
    n = F.lit(float(found.filter("evidence").count()))
    by_chance = F.col("df_entity") / n
    held = counted.filter("entity is null").select("term", F.col("df_both").alias("df_held"))
    joined = both.join(shared.join(judged, "entity"), "entity").join(held, "term", "left")
    most = F.log(F.col("df_both") / F.coalesce("df_held", F.lit(1)) / by_chance)
    joined = stored(joined.filter(most >= -F.log(by_chance) * disclosure - ROUNDING).drop("df_held"), "pii-judged")
    wanted = bitmap(joined.select("term"), "term")
    joined = joined.join(term_frequencies(docs, found, wanted).filter("df > 1"), "term")
    seen = F.col("df_both") / F.col("df")
    shared_bits, known = F.log(seen / by_chance), -F.log(by_chance)
    rest = F.when(seen < 1, (1 - seen) * F.log((1 - seen) / (1 - by_chance))).otherwise(0.0)
    unlikely = F.col("df") * (seen * shared_bits + rest) >= F.log(F.col("judged") / CHANCE)
    kept = joined.filter((by_chance < 1) & (shared_bits >= disclosure * known) & unlikely)
    return stored(kept.select("entity", "term"), "pii-revealing")


def term_spans(docs: DataFrame, holders: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row, terms): the places of revealing terms in the documents of their entities.

    The pairs may be many for a frequent entity, so they are not gathered: documents send the pairs
    that they hold, if the bitmap of all revealing pairs has them, and a join keeps the true ones.
    """
    wanted = bitmap(pairs, "entity", "term")

    def task(batches):
        for batch in batches:
            out = {n: [] for n in ("row", "entity", "term", "places")}
            for row, digest, text, entities in zip(batch["row"], batch["digest"], batch["text"], batch["entities"]):
                places: dict[str, list[dict]] = {}
                for term, a, b in free_words(checked(text, digest), pattern_spans(text)):
                    places.setdefault(term, []).append({"kind": 4, "start": a, "stop": b})
                for entity in entities:
                    for term, spans in places.items():
                        if in_bitmap(wanted, f"{entity} {term}"):
                            out["row"].append(row)
                            out["entity"].append(entity)
                            out["term"].append(term)
                            out["places"].append(spans)
            yield out

    span = "array<struct<kind:int,start:int,stop:int>>"
    sent = _pairs(docs, holders, task, f"row long, entity long, term string, places {span}")
    true = sent.join(pairs, ["entity", "term"], "left_semi").select("row", F.explode("places").alias("span"))
    return true.groupBy("row").agg(F.sort_array(F.collect_set("span")).alias("terms"))


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """All spans of every document, as an array `found` of (kind, start, stop).

    Also row, doc_id, n_<kind> of the patterns, and `base`, the pattern spans alone. Null texts
    are empty and have no spans. Repeated rows, and other copies, each have the spans of their text,
    which counts once as evidence; an empty table gives no rows. `docs` must give rows the same
    places in each pass, as tables read from files do; another order is an error.
    """
    found = stored(find_patterns(docs), "pii-patterns")
    firsts = found.groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    # Rows that do not stand for their text are few: those of texts that occur twice or more.
    first = firsts.filter("copies > 1").select("digest", F.col("row").alias("first"))
    flags = found.join(first, "digest").filter("row <> first").select("row")
    flags = stored(flags.withColumn("evidence", F.lit(False)), "pii-copies")
    light = found.select("row", "digest", "entities").join(flags, "row", "left")
    light = light.withColumn("evidence", F.coalesce("evidence", F.lit(True)))
    shared, holders = shared_entities(light)
    pairs = revealing_pairs(docs, light, shared, holders, disclosure)
    terms = term_spans(docs, holders, pairs)
    joined = found.drop("entities", "digest").join(terms, "row", "left")
    spans = F.concat("base", F.coalesce("terms", F.array()))
    return joined.withColumn("found", spans).drop("terms")


def digests(found: DataFrame) -> DataFrame:
    """Counts, the digest of the pattern spans and all spans as text."""
    names = F.array(*map(F.lit, KINDS))

    def text(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")
        )), ",")

    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(text("base"), 256).alias("base_sha256"), text("found").alias("spans"),
    )


def mask(text: str, spans: list[tuple[int, int, int]], remove: bool = False) -> str:
    """A text with the kind of each span in its place, or nothing; of overlapping spans one mark."""
    parts, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            parts.append(text[at:a])
            if not remove:
                parts.append(f"<{KINDS[kind].upper()}>")
        at = max(at, b)
    parts.append(text[at:])
    return "".join(parts)


def sanitise(docs: DataFrame, remove: bool = False) -> DataFrame:
    """The documents with personal data generalised, or removed; all columns and rows stay.

    Only documents with spans of terms need a second look: patterns are found again in the pass
    that rewrites the texts. A null text stays null. Columns may have any names: they travel as
    one struct.
    """
    names = docs.columns
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*names).alias("held"))
    keyed = stored(keyed, "pii-documents")
    plain = keyed.select(F.col("row").alias("doc_id"), F.col("held")["text"].alias("text"))
    found = find_personal_data(plain)
    terms = found.filter(F.size("found") > F.size("base")).select(
        F.col("doc_id").alias("row"), F.filter("found", lambda s: s["kind"] == 4).alias("terms")
    )

    def run(batches):
        for batch in batches:
            held, texts = batch.column("held"), []
            place = held.type.get_field_index("text")
            for text, spans in zip(held.field(place).to_pylist(), batch.column("terms").to_pylist()):
                if text is None:
                    texts.append(None)
                    continue
                all_spans = pattern_spans(text) + [(s["kind"], s["start"], s["stop"]) for s in spans or []]
                texts.append(mask(text, all_spans, remove))
            columns = held.flatten()
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return keyed.join(terms, "row", "left").select("held", "terms").mapInArrow(run, docs.schema)
