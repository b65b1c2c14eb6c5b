"""Long operations: labels, 10-minute series, summaries and stored forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.functions.labels import clean_label, display_label, is_candidate, operation_label
from bundlelens.functions.timestamps import bucket_start, interval_key, to_ntz
from bundlelens.operators.joins import null_safe_join

INTERVAL_MINUTES = 10
POINT = "struct<c: bigint, avg: double, max: double>"
NESTED = f"map<string, map<string, {POINT}>>"
LEGACY = (
    "array<struct<message_prefix: string, time_interval: string, "
    "avg_long_op_value: double, max_long_op_value: double, occurrence_count: bigint>>"
)


def labelled_operations(logs: DataFrame) -> DataFrame:
    """Messages about long operations with ``extracted_label`` and ``op_value``.

    The label leaves through a generator, so that the filter on it does not
    extract it a second time.
    """
    message, first, second = F.col("message"), F.col("long_op_value"), F.col("timing_real_value")
    return (
        logs.filter(is_candidate(message, first, second))
        .select("*", F.explode(F.array(operation_label(message))).alias("extracted_label"))
        .withColumn("op_value", F.coalesce(first, second))
        .filter(F.length(F.trim("extracted_label")) > 0)
    )


def long_operations(logs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, average and maximum per (prefix, 10-minute bucket)."""
    rows = (
        labelled_operations(logs)
        .withColumn("_ts", to_ntz("timestamp"))
        .withColumn("prefix", clean_label(F.col("extracted_label")))
        .withColumn("slot", bucket_start("_ts", INTERVAL_MINUTES))
    )
    return (
        rows.groupBy(*by, "prefix", "slot")
        .agg(F.count("*").alias("c"), F.avg("op_value").alias("avg"), F.max("op_value").alias("max"))
        .select(*by, "prefix", interval_key(F.col("slot")).alias("bucket"), "c", "avg", "max")
    )


def ordered_series(longops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Prefix, then time; for the final export only."""
    return longops.orderBy(*by, "prefix", "bucket")


def result_size(longops: DataFrame) -> DataFrame:
    """Number of interval records and of prefixes."""
    return longops.agg(F.count("*").alias("records"), F.count_distinct("prefix").alias("prefixes"))


def label_sample(logs: DataFrame, rows: int = 50, tie_break: Sequence[str] = ()) -> DataFrame:
    """The first labelled messages by label and time, with a 100-character preview."""
    return (
        labelled_operations(logs)
        .select(
            "timestamp", F.substring("message", 1, 100).alias("message_preview"),
            "long_op_value", "timing_real_value", "extracted_label", "op_value", *tie_break,
        )
        .orderBy("extracted_label", "timestamp", *tie_break).limit(rows)
    )


def label_summary(logs: DataFrame) -> DataFrame:
    """Count, average, maximum and minimum per extracted label, most frequent first."""
    return (
        labelled_operations(logs).groupBy("extracted_label")
        .agg(
            F.count("*").alias("message_count"), F.avg("op_value").alias("avg_duration"),
            F.max("op_value").alias("max_duration"), F.min("op_value").alias("min_duration"),
        )
        .filter(F.col("extracted_label").isNotNull())
        .orderBy(F.desc("message_count"), "extracted_label")
    )


def stored_longops(reports: DataFrame, by: Sequence[str] = ("id",), json: str = "json_report") -> DataFrame:
    """Long rows out of stored reports, whichever of the two forms they hold.

    Nested: ``{prefix: {bucket: {c, avg, max}}}``. Legacy: an array of records;
    a missing prefix reads 'Unknown', missing numbers read 0, and of two records
    for the same bucket the later one counts. A report without the field has no
    rows.
    """
    held = F.variant_get(F.try_parse_json(F.col(json)), "$.long_operations", "variant")
    rows = reports.select(*by, held.alias("_held")).filter(F.col("_held").isNotNull())
    shape = F.schema_of_variant("_held")
    nested = (
        rows.filter(shape.startswith("OBJECT"))
        .select(*by, F.explode(F.variant_get("_held", "$", NESTED)).alias("prefix", "_points"))
        .select(*by, "prefix", F.explode("_points").alias("bucket", "_p"))
        .select(*by, "prefix", "bucket", "_p.c", "_p.avg", "_p.max")
    )
    legacy = (
        rows.filter(shape.startswith("ARRAY"))
        .select(*by, F.posexplode(F.variant_get("_held", "$", LEGACY)).alias("_pos", "_r"))
        .select(
            *by, "_pos",
            F.coalesce(F.nullif("_r.message_prefix", F.lit("")), F.lit("Unknown")).alias("prefix"),
            F.coalesce("_r.time_interval", F.lit("")).alias("bucket"),
            F.coalesce("_r.occurrence_count", F.lit(0)).alias("c"),
            F.coalesce("_r.avg_long_op_value", F.lit(0.0)).alias("avg"),
            F.coalesce("_r.max_long_op_value", F.lit(0.0)).alias("max"),
        )
        .groupBy(*by, "prefix", "bucket").agg(F.max_by(F.struct("c", "avg", "max"), "_pos").alias("_p"))
        .select(*by, "prefix", "bucket", "_p.c", "_p.avg", "_p.max")
    )
    return nested.unionByName(legacy)


def label_rollup(longops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per prefix: its length, intervals, occurrences, maximum and average of averages."""
    return (
        longops.groupBy(*by, "prefix")
        .agg(
            F.count("*").alias("time_interval_count"), F.sum("c").alias("total_occurrences"),
            F.max("max").alias("max_duration"), F.avg("avg").alias("avg_duration"),
        )
        .withColumn("prefix_length", F.length("prefix"))
        .orderBy(F.desc_nulls_last("total_occurrences"), "prefix", *by)
    )


def interval_counts(longops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of intervals per prefix.

    The same rows as a distinct over a window count, without sorting each prefix
    in one task.
    """
    return longops.groupBy(*by, "prefix").agg(F.count("*").alias("time_interval_count"))


def align_series(longops: DataFrame, by: Sequence[str] = (), value: str = "avg") -> DataFrame:
    """Every prefix at every time bucket any prefix of its report has; null, not 0, where it lacks one.

    The time axis is kept per day: a report's days, and the buckets of each, so no row holds more than one of
    these lists. Each prefix generates its empty points day by day and the real ones are laid over them. A missing bundle
    is one like others.
    """
    day = F.substring("bucket", 1, 10).alias("_day")
    axis = longops.filter(F.col("bucket").isNotNull()).groupBy(*by, day).agg(F.collect_set("bucket").alias("_axis"))
    days = axis.groupBy(*by).agg(F.collect_list("_day").alias("_days"))
    names = longops.select(*by, "prefix").distinct()
    names = null_safe_join(names, days, by) if by else names.withColumn("_days", days.scalar())
    by_day = null_safe_join(names.select(*by, "prefix", F.explode("_days").alias("_day")), axis, [*by, "_day"])
    empty = by_day.select(*by, "prefix", F.explode("_axis").alias("bucket"), F.lit(None).cast("double").alias("value"))
    points = longops.select(*by, "prefix", "bucket", F.col(value).cast("double").alias("value"))
    return (
        points.unionByName(empty).groupBy(*by, "prefix", "bucket").agg(F.max("value").alias("value"))
        .withColumn("label", display_label(F.col("prefix")))
    )
