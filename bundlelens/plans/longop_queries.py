"""Queries over long operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from bundlelens.adapters import with_views
from bundlelens.functions.timestamps import second_text
from bundlelens.operators import longops, reports
from bundlelens.plans.registry import query

OPS = """labelled AS (
  SELECT *, coalesce(long_op_value, timing_real_value) AS op_value, trim(coalesce(
    nullif(regexp_extract(message, '((?:\\S+\\s+)?\\S+)\\s+took a long', 1), ''),
    nullif(regexp_extract(message, '^Time spent\\s+(\\S+(?:\\s+\\S+)?)', 1), ''))) AS label
  FROM log_events
  WHERE (long_op_value IS NOT NULL OR timing_real_value IS NOT NULL)
    AND (message LIKE '%took a long%' OR message LIKE 'Time spent%')),
cleaned AS (
  SELECT *, trim(regexp_replace(trim(regexp_replace(label, '\\([^)]+\\)', '', 'g')), '[:;]+$', '')) AS prefix,
    strftime(time_bucket(INTERVAL '10 minutes', "timestamp"), '%Y-%m-%d %H:%M:00') AS bucket
  FROM labelled WHERE length(trim(label)) > 0),
ops AS (
  SELECT prefix, bucket, count(*) AS c, avg(op_value) AS "avg", max(op_value) AS "max"
  FROM cleaned GROUP BY prefix, bucket),
bundle_ops AS (
  SELECT support_bundle, prefix, bucket, count(*) AS c, avg(op_value) AS "avg", max(op_value) AS "max"
  FROM cleaned GROUP BY support_bundle, prefix, bucket)
"""
_LABELLED = with_views("log_events") + ", " + OPS
_LOOSE = _LABELLED.replace(with_views("log_events"), with_views("loose_events")).replace("FROM log_events\n", "FROM loose_events\n")
_ROUNDED = 'c, round("avg", 6) AS "avg", round("max", 6) AS "max"'


def ops(v, by=()):
    return longops.long_operations(v.log_events(), by)


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("long_operations", _LABELLED + f"SELECT prefix, bucket, {_ROUNDED} FROM ops")
def long_operations(v):
    """A4, F7, F8, P7-P10, O3"""
    return longops.ordered_series(_rounded(ops(v), "avg", "max"))


@query("long_operations_by_bundle", _LABELLED + f"SELECT support_bundle, prefix, bucket, {_ROUNDED} FROM bundle_ops")
def long_operations_by_bundle(v):
    """A4 for many bundles at once"""
    return _rounded(ops(v, ["support_bundle"]), "avg", "max")


@query("long_operation_counters", _LABELLED + """
    SELECT count(*) AS records, count(DISTINCT prefix) AS prefixes FROM ops""")
def long_operation_counters(v):
    """A22"""
    return longops.result_size(ops(v))


@query("label_sample", _LABELLED + """
    SELECT event_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS at, substr(message, 1, 100) AS message_preview,
      long_op_value, timing_real_value, label AS extracted_label, op_value
    FROM labelled ORDER BY label, "timestamp", event_id LIMIT 50""")
def label_sample(v):
    """A listing of 50 rows"""
    rows = longops.label_sample(v.log_events(), tie_break=["event_id"])
    return rows.withColumn("at", second_text(F.col("timestamp"))).drop("timestamp")


@query("label_summary", _LABELLED + """
    SELECT label AS extracted_label, count(*) AS message_count, round(avg(op_value), 6) AS avg_duration,
      round(max(op_value), 6) AS max_duration, round(min(op_value), 6) AS min_duration
    FROM labelled GROUP BY label HAVING label IS NOT NULL""")
def label_summary(v):
    """A5, F17, O6"""
    return _rounded(longops.label_summary(v.log_events()), "avg_duration", "max_duration", "min_duration")


def _stored(v, legacy_when=None):
    """Reports that hold the long operations of each bundle as JSON."""
    by = "support_bundle"
    rows = ops(v, [by])
    nested = reports.long_operation_maps(rows, by).select(
        by, F.to_json(F.struct("long_operations")).alias("json_report"))
    if legacy_when is None:
        return nested
    records = rows.groupBy(by).agg(F.collect_list(F.struct(
        F.col("prefix").alias("message_prefix"), F.col("bucket").alias("time_interval"),
        F.col("avg").alias("avg_long_op_value"), F.col("max").alias("max_long_op_value"),
        F.col("c").alias("occurrence_count"))).alias("long_operations"))
    legacy = records.select(by, F.to_json(F.struct("long_operations")).alias("json_report"))
    return nested.filter(~legacy_when).unionByName(legacy.filter(legacy_when))


@query("stored_long_operations", _LABELLED + f"SELECT support_bundle, prefix, bucket, {_ROUNDED} FROM bundle_ops")
def stored_long_operations(v):
    """Written to JSON documents and read back"""
    return _rounded(longops.stored_longops(_stored(v), ["support_bundle"]), "avg", "max")


@query("stored_long_operations_both_forms", _LABELLED + f"SELECT support_bundle, prefix, bucket, {_ROUNDED} FROM bundle_ops")
def stored_long_operations_both_forms(v):
    """M8: bundles below 'bundle-15' in the legacy form, the others nested"""
    documents = _stored(v, F.col("support_bundle") < "bundle-15")
    return _rounded(longops.stored_longops(documents, ["support_bundle"]), "avg", "max")


@query("label_rollup", _LABELLED + """
    SELECT support_bundle, prefix, length(prefix) AS prefix_length, count(*) AS time_interval_count,
      CAST(sum(c) AS BIGINT) AS total_occurrences, round(max("max"), 9) AS max_duration, round(avg("avg"), 9) AS avg_duration
    FROM bundle_ops GROUP BY support_bundle, prefix""")
def label_rollup(v):
    """A6, P25, O4, from stored documents"""
    rows = longops.stored_longops(_stored(v), ["support_bundle"])
    # Averages of averages end in exact halves at the sixth digit, where engines round differently.
    return _rounded(longops.label_rollup(rows, ["support_bundle"]), "max_duration", "avg_duration", digits=9)


@query("label_interval_counts", _LABELLED + """
    SELECT DISTINCT prefix, count(*) OVER (PARTITION BY prefix) AS time_interval_count FROM ops""")
def label_interval_counts(v):
    """W1"""
    return longops.interval_counts(ops(v))


@query("aligned_series", _LABELLED + """, axis AS (SELECT DISTINCT bucket FROM ops), names AS (SELECT DISTINCT prefix FROM ops)
    SELECT names.prefix, regexp_replace(names.prefix, '\\s+took a long\\s*$', '', 'i') AS label, axis.bucket,
      round(ops."avg", 6) AS value
    FROM names CROSS JOIN axis LEFT JOIN ops ON ops.prefix = names.prefix AND ops.bucket = axis.bucket""")
def aligned_series(v):
    """J18, O8, P22"""
    return _rounded(longops.align_series(ops(v)), "value")


@query("aligned_series_by_bundle", _LOOSE + """,
    axis AS (SELECT DISTINCT support_bundle, bucket FROM bundle_ops),
    names AS (SELECT DISTINCT support_bundle, prefix FROM bundle_ops)
    SELECT n.support_bundle, n.prefix, regexp_replace(n.prefix, '\\s+took a long\\s*$', '', 'i') AS label, a.bucket,
      round(o."avg", 6) AS value
    FROM names n JOIN axis a ON a.support_bundle IS NOT DISTINCT FROM n.support_bundle
    LEFT JOIN bundle_ops o ON o.support_bundle IS NOT DISTINCT FROM n.support_bundle AND o.prefix = n.prefix AND o.bucket = a.bucket""")
def aligned_series_by_bundle(v):
    """J18 per bundle, a missing one included"""
    by = ["support_bundle"]
    return _rounded(longops.align_series(longops.long_operations(v.loose_events(), by), by), "value")
