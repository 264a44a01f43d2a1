"""Column expressions that the jobs share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_handle(handle: Column) -> Column:
    """Handle without its leading @ signs, lower-cased."""
    return F.lower(F.regexp_replace(handle, "^@+", ""))


def at_handle(handle: Column) -> Column:
    """Handle with exactly one leading @, case kept."""
    return F.concat(F.lit("@"), F.regexp_replace(handle, "^@+", ""))


def truthy(number: Column) -> Column:
    """NULL where the number is 0: zero counts as missing."""
    return F.nullif(number, F.lit(0))


def cap_of(note: Column) -> Column:
    """The number of a note's "CAP at N", else NULL."""
    return F.nullif(F.regexp_extract(note, r"CAP at\s+(\d+)", 1), F.lit("")).try_cast("int")


def ms_of(seconds: Column) -> Column:
    """Seconds as whole milliseconds, half to even."""
    return F.rint(seconds * 1000).cast("long")


def base_language(code: Column) -> Column:
    """The language without its region: en for en-US."""
    return F.split_part(code, F.lit("-"), F.lit(1))


def canonical_json(payload: Column) -> Column:
    """JSON text with sorted keys; NULL where the text is no JSON."""
    return F.to_json(F.try_parse_json(payload))


def content_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a pipe."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def day_start(now: Column) -> Column:
    return F.date_trunc("day", now)


def month_start(now: Column) -> Column:
    return F.date_trunc("month", now)
