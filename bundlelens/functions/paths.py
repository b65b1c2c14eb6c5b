"""Facts carried by the path of a log file, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path parts that name a node, in order of preference.
NODE_PATTERNS = (
    r"/(yb-[^/]*n\d+)/",
    r"/(yb-(?:master|tserver)-\d+_[^/]+)/",
    r"/([^/]+-node-\d+)/",
)

# Part of the lower-cased file name, log type.
LOG_TYPES = (
    ("postgres", "postgres"),
    ("controller", "yb-controller"),
    ("tserver", "yb-tserver"),
    ("master", "yb-master"),
    ("application", "YBA"),
)

# Names of files taken as logs.
DISCOVERED_SERVERS = ("tserver", "master", "postgres")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def node_name(path: Column) -> Column:
    found = [F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in NODE_PATTERNS]
    return F.coalesce(*found, F.lit("unknown"))


def log_type(path: Column) -> Column:
    name = F.lower(file_name(path))
    return F.coalesce(
        *[F.when(name.contains(part), F.lit(value)) for part, value in LOG_TYPES], F.lit("unknown")
    )


def sub_type(path: Column) -> Column:
    name = file_name(path)
    severity = [F.when(F.upper(name).contains(s), F.lit(s)) for s in ("INFO", "WARN", "ERROR", "FATAL")]
    quiet = [F.when(F.lower(name).contains(s), F.lit("INFO")) for s in ("postgres", "application")]
    return F.coalesce(*severity, *quiet, F.lit("unknown"))


def is_log_file(path: Column, servers=DISCOVERED_SERVERS) -> Column:
    name = F.lower(file_name(path))
    named = reduce(lambda a, b: a | b, [name.contains(s) for s in servers])
    return named & name.contains("log")


def host_of(address: Column) -> Column:
    """The part of ``ip:port`` before the colon."""
    return F.split_part(address, F.lit(":"), F.lit(1))
