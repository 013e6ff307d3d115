"""Restore state of archived objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalog_engine.functions.text import epoch_text

_DAY = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_LONG_DAY = "(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
_MONTH = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_CLOCK = r"(\d{1,2}:\d\d:\d\d)"

# The three HTTP date forms, each with its rewriting to day, month, year and
# clock. Two-digit years from 69 on are of the last century. The mark tells a rewritten
# date from any other text.
_MARK = "\x01"
_FORMS = (
    (rf"(?i)\A{_DAY}, (\d\d) {_MONTH} (\d{{4}}) {_CLOCK} GMT\z", "$1 $2 $3 $4"),
    (rf"(?i)\A{_LONG_DAY}, (\d\d)-{_MONTH}-([7-9]\d|69) {_CLOCK} [A-Z]{{3,4}}\z", "$1 $2 19$3 $4"),
    (rf"(?i)\A{_LONG_DAY}, (\d\d)-{_MONTH}-([0-6]\d) {_CLOCK} [A-Z]{{3,4}}\z", "$1 $2 20$3 $4"),
    (rf"(?i)\A{_DAY} {_MONTH} +(\d{{1,2}}) {_CLOCK} (\d{{4}})\z", "$2 $1 $4 $3"),
)
# Only the form with a long weekday names its zone; the others are UTC.
_NAMED_ZONE = rf'(?i)expiry-date="{_LONG_DAY}, \d\d-[^"]* ([A-Z]{{3,4}})"'

NOT_ARCHIVED = "object is not archived"
NO_HEAD = "no response for this version"


def _http_date(text: Column) -> Column:
    """Epoch seconds of an HTTP date, null where it is none.

    A chain of rewritings, so that the text is taken from its header once.
    """
    for pattern, parts in _FORMS:
        text = F.regexp_replace(text, pattern, _MARK + parts)
    stamp = F.concat(text, F.lit(" GMT"))
    return F.unix_seconds(F.try_to_timestamp(stamp, F.lit(f"'{_MARK}'d MMM yyyy H:mm:ss zzz")))


def parse_restore_header(header: Column) -> Column:
    """Struct ``restored, expiry, zone, error`` of a restore header.

    ``expiry`` is null where the header has none or a malformed date; a null header is an
    object that is not archived.
    """
    seconds = _http_date(F.regexp_extract(header, r'expiry-date="([^"]+)"', 1))
    named = F.upper(F.regexp_extract(header, _NAMED_ZONE, 1))
    zone = F.when(named == "", F.lit("UTC")).otherwise(named)
    return F.struct(
        F.coalesce(F.contains(header, F.lit('ongoing-request="false"')), F.lit(False)).alias(
            "restored"
        ),
        seconds.alias("expiry"),
        F.when(seconds.isNotNull(), zone).alias("zone"),
        F.when(header.isNull(), F.lit(NOT_ARCHIVED)).alias("error"),
    )


def status_text(restored: Column, expiry: Column, error: Column, zone: Column | None = None) -> Column:
    """One line of text per object; a missing expiry leaves its clause out."""
    zone = F.lit("UTC") if zone is None else F.coalesce(zone, F.lit("UTC"))
    expires = F.concat(F.lit(", Expires on "), epoch_text(expiry), F.lit(" "), zone)
    return (
        F.when(error.isNotNull(), F.concat(F.lit("Error retrieving status: "), error))
        .when(restored, F.concat(F.lit("Restored"), F.coalesce(expires, F.lit(""))))
        .otherwise(F.lit("Not Restored"))
    )
