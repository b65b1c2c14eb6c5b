"""Small scalar conversions of the tablet tables, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")


def format_bytes(size: Column) -> Column:
    """``0B``, ``512.0B``, ``1.5KB`` ...; two decimals, ties to even."""
    value = size.cast("double")
    power = F.when(value > 0, F.least(F.floor(F.log(1024.0, value)), F.lit(len(SIZE_UNITS) - 1))).otherwise(0)
    number = F.bround(value / F.pow(F.lit(1024.0), power), 2)
    unit = F.element_at(F.array(*[F.lit(u) for u in SIZE_UNITS]), power.cast("int") + 1)
    return F.when(value.isNull() | (value == 0), F.lit("0B")).otherwise(F.concat(number.cast("string"), unit))


def decode_uuid(text: Column) -> Column:
    """Base64 to hex; null for null or '', the input itself when it is not base64."""
    given = F.nullif(text, F.lit(""))
    return F.coalesce(F.lower(F.hex(F.try_to_binary(given, F.lit("base64")))), given)


def decode_partition_key(text: Column, default_hex: str) -> Column:
    """Base64 to ``0x..``; the default when empty or not base64."""
    given = F.nullif(text, F.lit(""))
    decoded = F.lower(F.hex(F.try_to_binary(given, F.lit("base64"))))
    return F.concat(F.lit("0x"), F.coalesce(decoded, F.lit(default_hex)))


def strip_dashes(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(""))


def lenient_int(value: Column) -> Column:
    """Whole number, 0 for null and for anything that is not one."""
    return F.coalesce(F.trim(value.cast("string")).try_cast("bigint"), F.lit(0).cast("bigint"))


def yes_no(flag: Column) -> Column:
    """'Yes' for true/1 in any of their forms, '' for null, 'No' otherwise."""
    return F.when(flag.isNull(), F.lit("")).when(flag.cast("string").isin("true", "1"), F.lit("Yes")).otherwise("No")


def placement(cloud: Column, region: Column, zone: Column) -> Column:
    """``cloud.region.zone``, null when a part is."""
    return F.concat(cloud, F.lit("."), region, F.lit("."), zone)
