"""Publish-time parsing. Needs a UTC session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import strip

# Zone names of RFC 822 dates, and the English months.
ZONES = {
    "GMT": "+00:00", "UTC": "+00:00", "UT": "+00:00", "Z": "+00:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_CLOCK = r"(\d{1,2}):(\d\d)(?::(\d\d))?"
# Day, month, year, and perhaps a clock time and a zone: RFC 822 and RFC 850.
MAIL = rf"^(?:\p{{L}}+,?\s+)?(\d{{1,2}})[\s-]+(\p{{L}}{{3}})\p{{L}}*\.?[\s-]+(\d{{4}}|\d\d)(?:\s+{_CLOCK}\s*(\S*))?$"
# Month, day, clock time, year: asctime.
ASCTIME = rf"^(?:\p{{L}}+,?\s+)?(\p{{L}}{{3}})\p{{L}}*\.?\s+(\d{{1,2}})\s+{_CLOCK}\s+(\d{{4}})$"


def _mail_date(text: Column) -> Column:
    """Text whose parts stand in a known order, put together as ISO text and cast once.

    A year of two digits is one of 1950 to 2049. Without a clock time it is midnight, without a
    zone UTC; an unknown month or zone gives null.
    """
    asctime = text.rlike(ASCTIME)

    def part(in_mail: int, in_asctime: int) -> Column:
        return F.when(asctime, F.regexp_extract(text, ASCTIME, in_asctime)).otherwise(
            F.regexp_extract(text, MAIL, in_mail)
        )

    year, zone = part(3, 6), F.when(asctime, "").otherwise(F.regexp_extract(text, MAIL, 7))
    century = F.when(F.length(year) == 4, "").when(year < "50", "20").otherwise("19")
    months = F.create_map(*[F.lit(x) for k, name in enumerate(MONTHS) for x in (name, f"{k + 1:02d}")])
    zones = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    offset = (
        F.when(zone == "", "+00:00")
        .when(zone.rlike(r"^[+-]\d\d:?\d\d$"), F.regexp_replace(zone, r"^(...):?(..)$", "$1:$2"))
        .otherwise(F.try_element_at(zones, zone))
    )

    def digits(value: Column) -> Column:
        return F.lpad(value, 2, "0")

    iso = F.concat(
        century, year, F.lit("-"), F.try_element_at(months, F.lower(part(2, 1))), F.lit("-"), digits(part(1, 2)),
        F.lit("T"), digits(part(4, 3)), F.lit(":"), digits(part(5, 4)), F.lit(":"), digits(part(6, 5)), offset,
    )
    return F.when(asctime | text.rlike(MAIL), iso.try_cast("timestamp"))


def parse_when(text: Column) -> Column:
    """RFC 822, RFC 850, asctime or ISO 8601 text to a timestamp; null when it is none of them."""
    text = strip(text)
    # The date guard also keeps a bare clock time from being read as "today".
    iso = text.rlike(r"^\d{4}-\d")
    parsed = F.when(iso, text.try_cast("timestamp")).otherwise(_mail_date(text))
    return F.date_trunc("second", parsed)


def published_at(published: Column, updated: Column, as_of: Column) -> Column:
    """The first of the two texts that parses, else the time of the run."""
    return F.coalesce(parse_when(published), parse_when(updated), as_of)
