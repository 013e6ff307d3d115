"""Text, time and digest expressions."""

from __future__ import annotations

import posixpath
import re
import time
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = re.compile(
    r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", re.ASCII
)


def as_of_seconds(moment: int | str | None = None) -> int:
    """Epoch seconds of an RFC 3339 text, an integer, or now."""
    if moment is None:
        return int(time.time())
    if isinstance(moment, int):
        return moment
    if not _RFC3339.fullmatch(moment):
        raise ValueError(f"invalid time format: {moment!r}")
    # Whole seconds first: a fraction is cut towards the past, never rounded up.
    whole = re.sub(r"\.\d+", "", moment)
    return int(datetime.fromisoformat(whole).timestamp())


def clean_path(path: str) -> str:
    """A path without ``.``, empty and resolvable ``..`` segments."""
    return re.sub(r"\A/+", "/", posixpath.normpath(path))


def normalize_dir(directory: str) -> str:
    """A walked directory as a prefix that does not cover its siblings."""
    cleaned = clean_path(directory)
    return cleaned if cleaned.endswith("/") else cleaned + "/"


def _java_quote(char: str) -> str:
    if char.isascii() and char.isalnum():
        return char
    return f"\\x{{{ord(char):X}}}"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_TO_LOWER, _TO_UPPER = str.maketrans(_UPPER, _LOWER), str.maketrans(_LOWER, _UPPER)


def folded(column: Column) -> Column:
    """A text with its ASCII letters in lower case, and no others."""
    return F.translate(column, _UPPER, _LOWER)


def prefix_stem(prefix: str) -> tuple[str, str | None]:
    """The part of a ``like`` prefix before its first wildcard, folded, and a pattern for texts that
    begin with it; none where the stem is the whole prefix."""
    stem = re.split("[%_]", prefix, maxsplit=1)[0]
    if stem == prefix:
        return stem.translate(_TO_LOWER), None
    wildcards = {"%": ".*", "_": "."}
    pattern = r"(?is)\A" + "".join(wildcards.get(c) or _java_quote(c) for c in prefix)
    return stem.translate(_TO_LOWER), pattern


def _after(text: str) -> str | None:
    """The least text above all that begin with ``text``."""
    for end in range(len(text), 0, -1):
        code = ord(text[end - 1]) + 1
        if code <= 0x10FFFF:
            return text[: end - 1] + chr(0xE000 if 0xD800 <= code <= 0xDFFF else code)
    return None


def prefix_condition(column: Column, prefix: str, match: str = "like") -> Column:
    """True where ``column`` starts with ``prefix``.

    ``like``: ASCII letters match in either case, ``%`` and ``_`` in the prefix are
    wildcards without an escape. ``literal``: byte for byte, which reaches the Parquet scan.
    In ``like`` mode the scan is given one range: all spellings of the prefix, or of the part before
    its first wildcard, lie between that in upper and that in lower case. A pattern is tried only
    where there is a wildcard.
    """
    if match not in ("like", "literal"):
        raise ValueError(f"unknown match mode: {match!r}")
    if prefix == "":
        return F.lit(True)
    if match == "literal":
        return column.startswith(prefix)
    stem, pattern = prefix_stem(prefix)
    if pattern is None and not re.search("[a-z]", stem):
        return column.startswith(prefix)
    terms = []
    if stem:
        if re.search("[a-z]", stem):
            terms.append(column >= stem.translate(_TO_UPPER))
            terms += [column < after for after in [_after(stem)] if after]
            terms.append(folded(column).startswith(stem))
        else:
            terms.append(column.startswith(stem))
    if pattern is not None:
        terms.append(column.rlike(pattern))
    return reduce(lambda a, b: a & b, terms)


def trim_space(column: Column) -> Column:
    """Strip Unicode white space, line ends included, from both ends."""
    return F.regexp_replace(column, r"(?U)\A\s+|\s+\z", "")


def clean_details(column: Column) -> Column:
    """Blank details become null; any other text is kept as it is."""
    return F.when(~column.rlike(r"(?U)\A\s*\z"), column)


def epoch_text(column: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the session time zone."""
    seconds = F.pmod(column, F.lit(86400))
    days = F.call_function("div", column - seconds, F.lit(86400)).cast("int")
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return (start + F.make_dt_interval(days, F.lit(0), F.lit(0), seconds)).cast("string")


def hex_digest(column: Column) -> Column:
    """Lower-case SHA-256 hex of a binary or string column."""
    return F.sha2(column, 256)
