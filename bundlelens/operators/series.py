"""Shaping stored minute histograms into chart series.

A histogram has the columns ``[by..., node_name, log_type, pattern, minute,
count]`` with ``minute`` as text. Null, 'null' and malformed minutes are
ignored, as in a stored report. ``by`` names the report or bundle when several
are shaped together; bounds are then taken per report, and a missing bundle is one like others. Ranges that depend on the
latest bucket use the histogram twice; Spark shuffles it once and reuses that.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundlelens.functions.timestamps import bucket_start, iso_second, minute_key, parse_minute_key
from bundlelens.operators.joins import null_safe_join
from bundlelens.session import written

INTERVALS = (1, 5, 15, 30, 60)
DEFAULT_RANGE = "7 days"


def with_bucket(hist: DataFrame) -> DataFrame:
    """Adds the minute as a timestamp and drops unusable keys."""
    return hist.withColumn("bucket", parse_minute_key(F.col("minute"))).filter(F.col("bucket").isNotNull())


def latest_bucket(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The latest minute as text; null (without ``by``) when there is none."""
    return (
        with_bucket(hist).groupBy(*by).agg(F.max("bucket").alias("latest"))
        .select(*by, iso_second(F.col("latest")).alias("latest"))
    )


def _counted_bucket() -> Column:
    """The bucket, looked up together with its count.

    So neither the latest bucket nor a range after it can be decided below the histogram's aggregation: both need the same columns
    of it and share its one shuffle.
    """
    return F.when(F.col("count").isNull() | (F.col("count") >= 0), F.col("bucket"))


def _with_latest(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds the latest bucket of the row's report as ``_latest``."""
    latest = F.max(_counted_bucket()).alias("_latest")
    if not by:
        return rows.withColumn("_latest", rows.agg(latest).scalar())
    return null_safe_join(rows, rows.groupBy(*by).agg(latest), by)


def _bound(value: str | datetime | None) -> Column | None:
    """A bound given by the caller; unreadable text means no bound."""
    if value in (None, ""):
        return None
    return parse_minute_key(F.lit(value)) if isinstance(value, str) else F.lit(value).cast("timestamp_ntz")


def time_range(
    hist: DataFrame, start: str | datetime | None = None, end: str | datetime | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Buckets inside [start, end].

    A missing start means seven days before the latest bucket, a missing end the
    latest bucket; each defaults on its own. The start ``all`` keeps every bucket up to the end.
    """
    if start == "all":
        rows, high = with_bucket(hist), _bound(end)
        return rows if high is None else rows.filter((F.col("bucket") <= high) | high.isNull())
    rows, low, high, at = with_bucket(hist), _bound(start), _bound(end), F.col("bucket")
    if low is None or high is None:
        rows, at = _with_latest(rows, by), _counted_bucket()
        low = F.col("_latest") - F.expr(f"INTERVAL {DEFAULT_RANGE}") if low is None else low
        high = F.col("_latest") if high is None else high
    kept = (at >= low) | low.isNull(), (at <= high) | high.isNull()
    return rows.filter(kept[0] & kept[1]).drop("_latest")


def quick_range(hist: DataFrame, code: str, by: Sequence[str] = ()) -> DataFrame:
    """Buckets of a named range counted back from the latest one.

    ``12h``, ``1d`` (24 hours), ``<n>`` or ``<n>d`` days counted inclusively
    (latest - n + 1 days), or ``all``.
    """
    rows = with_bucket(hist)
    if code == "all":
        return rows
    if code == "12h":
        back = "12 hours"
    elif code == "1d":
        back = "24 hours"
    else:
        back = f"{int(code.rstrip('d')) - 1} days"
    rows = _with_latest(rows, by)
    low = F.col("_latest") - F.expr(f"INTERVAL {back}")
    return rows.filter(_counted_bucket().between(low, F.col("_latest"))).drop("_latest")


def rebucket(
    hist: DataFrame,
    interval: int,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    by: Sequence[str] = (),
    keys: Sequence[str] = ("node_name", "log_type", "pattern"),
) -> DataFrame:
    """Counts per N-minute bucket inside the range."""
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {INTERVALS}")
    rows = time_range(hist, start, end, by)
    return (
        rows.withColumn("slot", bucket_start("bucket", interval))
        .groupBy(*by, *keys, "slot").agg(F.sum("count").alias("count"))
        .select(*by, *keys, minute_key(F.col("slot")).alias("minute"), "count")
    )


def drill_down(hist: DataFrame, nodes=None, log_type: str | None = None) -> DataFrame:
    """Only the chosen node or nodes and log type; None or 'all' keeps everything."""
    rows = hist
    if nodes is not None and nodes != "all":
        rows = rows.filter(F.col("node_name").isin([nodes] if isinstance(nodes, str) else list(nodes)))
    if log_type is not None and log_type != "all":
        rows = rows.filter(F.col("log_type") == log_type)
    return rows


def message_totals(hist: DataFrame, nodes=None, log_type=None, by: Sequence[str] = ()) -> DataFrame:
    """Count per (pattern, bucket) over the chosen nodes and log type."""
    return drill_down(hist, nodes, log_type).groupBy(*by, "pattern", "minute").agg(F.sum("count").alias("count"))


def node_series(hist: DataFrame, nodes=None, by: Sequence[str] = ()) -> DataFrame:
    """Count per (pattern, node, bucket) over all log types."""
    return (
        drill_down(hist, nodes).groupBy(*by, "pattern", "node_name", "minute").agg(F.sum("count").alias("count"))
    )


def fill_gaps(
    series: DataFrame, interval: int, by: Sequence[str] = (), keys: Sequence[str] = ("pattern",)
) -> DataFrame:
    """Adds a zero for every bucket between the report's first and last that a series lacks.

    Each series generates its own zero rows, which are added to the counts; no
    join with a spine of buckets is needed. It generates days first and, in other
    tasks, the buckets of a day, so no row holds more than a day's. ``interval`` divides a day.
    The series are written once: names, bounds and counts read them, not the logs behind them.
    """
    if (24 * 60) % interval:
        raise ValueError("the interval must divide a day")
    rows = written(with_bucket(series).select(*by, *keys, "bucket", "count"), "series")
    names = rows.groupBy(*by, *keys).agg(F.min("bucket").alias("_low"), F.max("bucket").alias("_high"))
    bounds = names.groupBy(*by).agg(F.struct(F.min("_low").alias("low"), F.max("_high").alias("high")).alias("_range"))
    if by:
        names = null_safe_join(names, bounds, by)
    else:
        names = names.withColumn("_range", bounds.scalar())
    step = F.expr(f"INTERVAL {int(interval)} MINUTES")
    day = F.expr("INTERVAL 1 DAY")
    days = names.select(
        *by, *keys, F.explode(F.sequence("_range.low", "_range.high", day)).alias("_from"), F.col("_range.high").alias("_high")
    ).repartition(*by, *keys, "_from")
    until = F.least(F.col("_high"), F.col("_from") + day - step)
    zeros = days.select(
        *by, *keys, F.explode(F.sequence(F.col("_from"), until, step)).alias("bucket"), F.lit(0).cast("bigint").alias("count")
    )
    return (
        rows.unionByName(zeros).groupBy(*by, *keys, "bucket").agg(F.sum("count").alias("count"))
        .select(*by, *keys, minute_key(F.col("bucket")).alias("minute"), "count")
    )


def axis_values(hist: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct buckets, nodes or log types over all series (sort at display)."""
    return hist.select(*by, column).filter(F.col(column).isNotNull()).distinct()
