"""Pattern statistics of a growing log folder.

Every micro-batch appends the minute statistics of its new files, computed by the
same functions as in batch; readers add the pieces up. No state is kept between
batches and a repeated batch replaces its own piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bundlelens.operators import logstats, match
from bundlelens.schemas import LOG_EVENTS
from bundlelens.sources.catalog import Pattern

KEYS = ("support_bundle", "node_name", "log_type", "pattern_name", "pattern")


def follow_logs(
    spark: SparkSession, source: str, target: str, checkpoint: str, patterns: Sequence[Pattern], schema: str = LOG_EVENTS
) -> StreamingQuery:
    """Takes in the files that are new in ``source`` and stops; run again for later ones."""
    def save(batch: DataFrame, number: int) -> None:
        minutes = logstats.minute_stats(match.match_all(batch, patterns), ["support_bundle"])
        match.name_patterns(minutes, patterns).write.mode("overwrite").parquet(f"{target}/batch={number}")

    logs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(source)
    return (
        logs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    )


def collected_minutes(spark: SparkSession, target: str) -> DataFrame:
    """The minute statistics of everything taken in so far."""
    return spark.read.parquet(target).groupBy(*KEYS, "bucket").agg(
        F.sum("count").alias("count"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
