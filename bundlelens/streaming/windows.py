"""Statistics of arriving logs by event time: closed minutes and intervals are appended once and never change.

State holds the open windows only: the watermark closes a window when no line that old is expected any more, which bounds the state
by the lateness allowed, not by the log. Rows that come later than that are dropped and counted by the query's progress
(``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bundlelens.functions.labels import clean_label
from bundlelens.functions.timestamps import NTZ, interval_key, minute_key
from bundlelens.operators.logstats import GROUP
from bundlelens.operators.longops import INTERVAL_MINUTES, labelled_operations
from bundlelens.operators.match import match_all
from bundlelens.sources.catalog import Pattern

LATENESS = "1 hour"


def _watched(logs: DataFrame, lateness: str) -> DataFrame:
    """Rows with a time, watched by it. Watermarks need instants: the cast there and back is the identity in UTC, the session's zone."""
    return logs.filter(F.col("timestamp").isNotNull()).withColumn("_at", F.col("timestamp").cast("timestamp")).withWatermark("_at", lateness)


def closed_minutes(logs: DataFrame, patterns: Sequence[Pattern], by: Sequence[str] = (), lateness: str = LATENESS) -> DataFrame:
    """The rows of ``minute_histogram`` with first and last time, for a stream of logs: a minute's row comes when it is closed.

    Hits without a time belong to no minute and are left out.
    """
    hits = match_all(_watched(logs, lateness), patterns)
    return hits.groupBy(*by, *GROUP, "pattern_id", F.window("_at", "1 minute").alias("_w")).agg(
        F.count("*").alias("count"), F.min("_at").cast(NTZ).alias("start_time"), F.max("_at").cast(NTZ).alias("end_time")
    ).select(*by, *GROUP, "pattern_id", minute_key(F.col("_w.start").cast(NTZ)).alias("minute"), "count", "start_time", "end_time")


def closed_operations(logs: DataFrame, by: Sequence[str] = (), lateness: str = LATENESS) -> DataFrame:
    """The rows of ``long_operations`` for a stream of logs: an interval's row comes when it is closed."""
    rows = labelled_operations(_watched(logs, lateness)).withColumn("prefix", clean_label(F.col("extracted_label")))
    return rows.groupBy(*by, "prefix", F.window("_at", f"{INTERVAL_MINUTES} minutes").alias("_w")).agg(
        F.count("*").alias("c"), F.avg("op_value").alias("avg"), F.max("op_value").alias("max")
    ).select(*by, "prefix", interval_key(F.col("_w.start").cast(NTZ)).alias("bucket"), "c", "avg", "max")


def append_closed(closed: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts writing closed windows to a Parquet folder, each exactly once; ``once`` stops when what is there has been read.

    The checkpoint keeps the open windows for the next start.
    """
    writer = closed.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
