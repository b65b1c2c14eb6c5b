"""Queries over the log as a stream: what is closed by event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from bundlelens.operators import match
from bundlelens.plans import log_queries, longop_queries
from bundlelens.plans.registry import query
from bundlelens.session import shared_dir
from bundlelens.streaming import windows

_CLOSED = "(SELECT max(\"timestamp\") - INTERVAL 1 HOUR FROM log_events)"


def _streamed(v, make):
    """The closed windows of the whole log, taken in file by file as a stream that ends when all is read."""
    source, target, state = (shared_dir(v.spark, name) for name in ("stream", "closed", "state"))
    events = v.log_events()
    events.write.parquet(source)
    query_run = windows.append_closed(make(v.spark.readStream.schema(events.schema).parquet(source)), target, state)
    query_run.awaitTermination()
    return v.spark.read.parquet(target)


@query("streamed_minutes", log_queries.HITS + f"""
    SELECT node_name, log_type, pattern, {log_queries.MINUTE} AS minute, count(*) AS "count" FROM hits
    WHERE date_trunc('minute', "timestamp") + INTERVAL 1 MINUTE <= {_CLOSED} GROUP BY ALL""")
def streamed_minutes(v):
    """A2 by event time: minutes that the watermark has closed"""
    found = _streamed(v, lambda logs: windows.closed_minutes(logs, log_queries.PATTERNS))
    return match.name_patterns(found, log_queries.PATTERNS, ["pattern"]).drop("start_time", "end_time")


@query("streamed_operations", longop_queries._LABELLED + f"""
    SELECT prefix, bucket, {longop_queries._ROUNDED} FROM ops
    WHERE CAST(bucket AS TIMESTAMP) + INTERVAL 10 MINUTE <= {_CLOSED}""")
def streamed_operations(v):
    """A4 by event time: intervals that the watermark has closed"""
    found = _streamed(v, windows.closed_operations)
    return found.withColumns({"avg": F.round("avg", 6), "max": F.round("max", 6)})
