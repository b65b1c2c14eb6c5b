"""Time parsing, time buckets and their text forms, as columns.

Everything stays in ``timestamp_ntz`` so that results do not depend on the
session time zone. Text forms are cut from the cast, which always reads
``YYYY-MM-DD HH:MM:SS[.ffffff]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def to_ntz(col) -> Column:
    return F.col(col).cast(NTZ) if isinstance(col, str) else col.cast(NTZ)


# The two forms of a line's time. Short: severity letter, month, day,
# hour and minute, no year. Long: date and time with a fraction, ended by a blank.
_SHORT = r"[IWEF]\d{4}\s+\d{2}:\d{2}"
_LONG = r"\s*\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}(?=\s|$)"


def line_stamp(line: Column) -> Column:
    """The text of a raw line's time, '' when there is none: one regex for both forms."""
    return F.regexp_extract(line, f"^({_SHORT}|{_LONG})", 1)


def stamp_time(stamp: Column, reference_year) -> Column:
    """Time of a ``line_stamp``, null when it is not a real time.

    ``I1231 10:30`` has minute precision and no year: ``reference_year`` (a
    number or a column) supplies it. The other form is taken as it is.
    """
    year = reference_year if isinstance(reference_year, Column) else F.lit(int(reference_year))
    short = F.concat(
        F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.substring(stamp, 2, 2), F.lit("-"),
        F.substring(stamp, 4, 2), F.lit(" "), F.right(stamp, F.lit(5)), F.lit(":00"),
    )
    text = F.when(is_short_form(stamp), short).otherwise(F.regexp_replace(F.trim(stamp), r"\s+", " "))
    return F.when(stamp != "", text.try_cast(NTZ))


def log_timestamp(line: Column, reference_year) -> Column:
    """Time of a raw log line, null when there is none."""
    return stamp_time(line_stamp(line), reference_year)


def is_short_form(line: Column) -> Column:
    """Lines that start with a severity letter carry no year."""
    return F.substring(line, 1, 1).isin("I", "W", "E", "F")


def bucket_start(ts, minutes: int) -> Column:
    """Start of the N-minute bucket; N divides 60, so buckets restart every hour."""
    if minutes < 1 or 60 % minutes:
        raise ValueError("bucket length must divide 60 minutes")
    return F.window(ts, f"{minutes} minutes")["start"]


def minute_key(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:00Z``"""
    return F.concat(F.replace(_head(ts, 16), F.lit(" "), F.lit("T")), F.lit(":00Z"))


def interval_key(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:00``"""
    return F.concat(_head(ts, 16), F.lit(":00"))


def iso_second(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ``"""
    return F.concat(F.replace(_head(ts, 19), F.lit(" "), F.lit("T")), F.lit("Z"))


def listing_minute(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM``"""
    return _head(ts, 16)


def second_text(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``"""
    return _head(ts, 19)


def _head(ts: Column, length: int) -> Column:
    return F.substring(ts.cast(NTZ).cast("string"), 1, length)


def parse_minute_key(key: Column) -> Column:
    """Inverse of ``minute_key``/``iso_second``; null for null, 'null' or malformed keys."""
    valid = key.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z$")
    return F.when(valid, F.rtrim(key, F.lit("Z")).try_cast(NTZ))


def parse_interval_key(key: Column) -> Column:
    """Inverse of ``interval_key``."""
    return F.when(key.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), key.try_cast(NTZ))


def parse_tolerant(text: Column) -> Column:
    """ISO time with or without Z, or ``YYYY-MM-DD HH:MM:SS...``; anything else is null."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.rtrim(text, F.lit("Z")).try_cast(NTZ))
    plain = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"), F.substring(text, 1, 19).try_cast(NTZ))
    return F.coalesce(iso, plain)
