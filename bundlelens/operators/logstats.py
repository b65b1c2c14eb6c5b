"""Statistics and histograms of pattern hits.

``minute_stats`` is the one shuffle over the hits (partial aggregation first, so
a hot node or pattern sends at most one row per minute and task). Statistics and
histograms regroup its small result: write it once when both are wanted.
``hit_stats`` is the shorter way when only statistics are.
``by`` names extra leading keys, such as ``support_bundle`` when many bundles
are analysed together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.functions.timestamps import iso_second, minute_key, parse_tolerant, to_ntz

GROUP = ("node_name", "log_type")


def filter_logs(
    logs: DataFrame,
    start=None,
    end=None,
    nodes: Sequence[str] | None = None,
    log_types: Sequence[str] | None = None,
    ts: str = "timestamp",
) -> DataFrame:
    """Rows with a time inside [start, end], of the given nodes and log types.

    Node names are given lower-cased by the caller's list and compared exactly;
    log types may be given by alias.
    """
    from bundlelens.sources.catalog import LOG_TYPE_ALIASES

    rows = logs
    if start is not None or end is not None:
        rows = rows.filter(F.col(ts).isNotNull())
    if start is not None:
        rows = rows.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    if nodes:
        rows = rows.filter(F.col("node_name").isin([n.lower() for n in nodes]))
    if log_types:
        rows = rows.filter(F.col("log_type").isin([LOG_TYPE_ALIASES.get(t.lower(), t.lower()) for t in log_types]))
    return rows


def minute_stats(hits: DataFrame, by: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Hits per (node, log type, pattern, minute) with first and last time.

    Hits without a time count too: their minute and times are null.
    """
    minute = F.expr("_ts - make_dt_interval(0, 0, 0, extract(SECOND FROM _ts))")  # a window would drop null times
    rows = hits.withColumn("_ts", to_ntz(ts)).withColumn("bucket", minute)
    return rows.groupBy(*by, *GROUP, "pattern_id", "bucket").agg(
        F.count("*").alias("count"), F.min("_ts").alias("start_time"), F.max("_ts").alias("end_time")
    )


def hit_stats(hits: DataFrame, by: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Count, first and last time per (node, log type, pattern), straight from the hits.

    Hits without a time count too.
    """
    rows = hits.withColumn("_ts", to_ntz(ts))
    return rows.groupBy(*by, *GROUP, "pattern_id").agg(
        F.count("*").alias("count"), F.min("_ts").alias("start_time"), F.max("_ts").alias("end_time")
    )


def pattern_stats(minutes: DataFrame, by: Sequence[str] = (), pattern=("pattern_id",)) -> DataFrame:
    """Count, first and last time per (node, log type, pattern)."""
    return minutes.groupBy(*by, *GROUP, *pattern).agg(
        F.sum("count").alias("count"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
    )


def minute_histogram(minutes: DataFrame, by: Sequence[str] = (), pattern=("pattern_id",)) -> DataFrame:
    """Count per (node, log type, pattern, minute), minutes as text keys; null for hits without a time."""
    return minutes.select(*by, *GROUP, *pattern, minute_key(F.col("bucket")).alias("minute"), "count")


def merge_stats(partials: DataFrame, by: Sequence[str] = (), pattern=("pattern_name", "pattern")) -> DataFrame:
    """One statistics row per key from the statistics of many files or runs."""
    return pattern_stats(partials, by, pattern)


def merge_histograms(partials: DataFrame, by: Sequence[str] = (), pattern=("pattern_name", "pattern")) -> DataFrame:
    """One histogram from the histograms of many files or runs: counts add up per minute."""
    return partials.groupBy(*by, *GROUP, *pattern, "minute").agg(F.sum("count").alias("count"))


def hit_table(stats: DataFrame, by: Sequence[str] = (), pattern: str = "pattern") -> DataFrame:
    """Flat view: message, first and last occurrence as ISO text, count."""
    return stats.select(
        *by, *GROUP, F.col(pattern).alias("message"),
        iso_second(F.col("start_time")).alias("first_occurrence"),
        iso_second(F.col("end_time")).alias("last_occurrence"),
        "count",
    )


def read_times(table: DataFrame, *columns: str) -> DataFrame:
    """Text times of a stored report as timestamps; malformed ones become null."""
    return table.withColumns({c: parse_tolerant(F.col(c)) for c in columns})
