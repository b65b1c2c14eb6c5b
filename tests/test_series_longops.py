from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bundlelens.functions import labels, timestamps
from bundlelens.operators import logstats, longops, series
from tests.conftest import rows

HIST = "node_name string, log_type string, pattern string, minute string, count bigint"


def hist(spark, *points, pattern="p"):
    return spark.createDataFrame([("n1", "yb-tserver", pattern, m, c) for m, c in points], HIST)


def test_rebucket_inside_the_hour(spark):
    h = hist(spark, ("2024-01-01T10:59:00Z", 2), ("2024-01-01T10:31:00Z", 1), (None, 9), ("null", 9), ("x", 9))
    assert rows(series.rebucket(h, 30), "minute", "count") == [("2024-01-01T10:30:00Z", 3)]
    assert rows(series.rebucket(h, 60), "minute", "count") == [("2024-01-01T10:00:00Z", 3)]
    assert rows(series.rebucket(h, 1), "minute", "count") == [("2024-01-01T10:31:00Z", 1), ("2024-01-01T10:59:00Z", 2)]


def test_default_range_is_seven_days(spark):
    h = hist(spark, ("2024-01-01T00:00:00Z", 1), ("2024-01-06T00:00:00Z", 1), ("2024-01-11T00:00:00Z", 1))
    days = lambda df: [r[0][8:10] for r in rows(df, "minute")]
    assert days(series.time_range(h)) == ["06", "11"]
    assert days(series.time_range(h, start="2024-01-01T00:00:00Z")) == ["01", "06", "11"]
    assert days(series.time_range(h, end="2024-01-06T00:00:00Z")) == ["06"]
    assert days(series.time_range(h, start=datetime(2024, 1, 1), end="2024-01-06T00:00:00Z")) == ["01", "06"]
    assert days(series.time_range(h, start="junk", end="2024-01-06T00:00:00Z")) == ["01", "06"]


def test_ranges_per_report(spark):
    h = hist(spark, ("2024-01-01T00:00:00Z", 1), ("2024-01-11T00:00:00Z", 1)).withColumn("id", F.lit("a")).union(
        hist(spark, ("2024-01-01T00:00:00Z", 1)).withColumn("id", F.lit("b")))
    assert rows(series.time_range(h, by=["id"]), "id", "minute") == [("a", "2024-01-11T00:00:00Z"), ("b", "2024-01-01T00:00:00Z")]
    assert rows(series.latest_bucket(h, ["id"])) == [("a", "2024-01-11T00:00:00Z"), ("b", "2024-01-01T00:00:00Z")]
    assert rows(series.latest_bucket(h.limit(0))) == [(None,)]


def test_quick_ranges(spark):
    h = hist(spark, *[(f"2024-01-{d:02d}T00:00:00Z", 1) for d in range(1, 11)], ("2024-01-10T12:00:00Z", 1))
    count = lambda code: series.quick_range(h, code).count()
    assert (count("12h"), count("1d"), count("3"), count("all")) == (2, 2, 3, 11)


def test_gap_filling(spark):
    h = hist(spark, ("2024-01-01T10:00:00Z", 4), ("2024-01-01T10:20:00Z", 5)).union(
        hist(spark, ("2024-01-01T10:10:00Z", 7), pattern="q"))
    got = rows(series.fill_gaps(series.message_totals(h), 10), "pattern", "minute", "count")
    assert [(p, m[11:16], c) for p, m, c in got] == [
        ("p", "10:00", 4), ("p", "10:10", 0), ("p", "10:20", 5), ("q", "10:00", 0), ("q", "10:10", 7), ("q", "10:20", 0)]


def test_gaps_over_days(spark):
    h = hist(spark, ("2024-01-01T23:30:00Z", 1), ("2024-01-04T00:15:00Z", 2))
    got = rows(series.fill_gaps(series.message_totals(h), 15), "minute", "count")
    assert len(got) == 196 == len(set(got)) and sum(c for _, c in got) == 3
    with pytest.raises(ValueError):
        series.fill_gaps(series.message_totals(h), 7)


def test_drill_down(spark):
    h = spark.createDataFrame([("n1", "a", "p", "m", 1), ("n2", "a", "p", "m", 2), ("n2", "b", "p", "m", 4)], HIST)
    total = lambda *a: [r[0] for r in rows(series.message_totals(h, *a), "count")]
    assert (total("all", "all"), total("n2"), total(["n1", "n2"], "a"), total(None, "b")) == ([7], [6], [3], [4])
    assert rows(series.node_series(h, "n2"), "node_name", "count") == [("n2", 6)]
    assert rows(series.axis_values(h, "log_type")) == [("a",), ("b",)]


def test_statistics_add_up(spark):
    hits = spark.createDataFrame(
        [("n1", "t", 0, datetime(2024, 1, 1, 10, 0, s % 60, s)) for s in range(100)] + [("n1", "t", 0, None)],
        "node_name string, log_type string, pattern_id int, timestamp timestamp_ntz")
    minutes = logstats.minute_stats(hits)
    assert minutes.agg(F.sum("count")).first()[0] == 101
    assert rows(logstats.pattern_stats(minutes), "count", "start_time", "end_time") == rows(
        logstats.hit_stats(hits), "count", "start_time", "end_time")
    assert rows(logstats.hit_stats(hits), "count") == [(101,)]
    found = {r.minute: r["count"] for r in logstats.minute_histogram(minutes).collect()}
    assert found == {"2024-01-01T10:00:00Z": 100, None: 1}  # the hit without a time has no minute


def test_an_unbounded_range_keeps_early_buckets(spark):
    h = spark.createDataFrame([("n", "t", "p", m, 1) for m in ("1999-05-01T00:00:00Z", "2024-01-09T00:00:00Z", None)],
                              "node_name string, log_type string, pattern string, minute string, count bigint")
    assert rows(series.rebucket(h, 60, start="all"), "minute") == [("1999-05-01T00:00:00Z",), ("2024-01-09T00:00:00Z",)]
    assert rows(series.rebucket(h, 60, start="all", end="2000-01-01T00:00:00Z"), "minute") == [("1999-05-01T00:00:00Z",)]


def test_filter_by_alias_and_range(spark):
    logs = spark.createDataFrame(
        [("n1", "postgres", datetime(2024, 1, 1)), ("n1", "yb-master", datetime(2024, 1, 2)), ("n2", "odd", None)],
        "node_name string, log_type string, timestamp timestamp_ntz")
    assert logstats.filter_logs(logs, log_types=["pg", "ms"]).count() == 2
    assert logstats.filter_logs(logs, log_types=["odd"]).count() == 1
    assert logstats.filter_logs(logs, start=datetime(2024, 1, 2), end=datetime(2024, 1, 2)).count() == 1
    assert logstats.filter_logs(logs, nodes=["N2"]).count() == 1


def test_time_forms(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05",), ("2024-01-02 03:04:05.9",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(timestamps.iso_second(timestamps.parse_tolerant(F.col("t")))).collect()] == [
        "2024-01-02T03:04:05Z"] * 3 + [None, None]
    read = logstats.read_times(df, "t").schema["t"].dataType.typeName()
    assert read == "timestamp_ntz"


MESSAGES = [
    ("Log callback took a long time", "Log callback"), ("Read took a long", "Read"),
    ("Time spent sync call for /path: real 1.0s", "sync call"), ("Time spent Fsync log took a long time", "Fsync log"),
    ("running LogGCOp(fab8633b) took a long time", "running LogGCOp"), ("UpdateReplica took a long time: 1.5s", "UpdateReplica"),
    ("x … Time spent y", None), ("Took A Long time", None), ("Time spent", None), ("took a long time", None),
    ("a (b) took a long", "a"), ("(b) took a long", ""), ("a b: took a long time", "a b"),
    ("Time spent took a long time", "Time spent"), ("Time spent\tx", "x"),
]


def test_labels(spark):
    df = spark.createDataFrame([(m, 1.0, None) for m, _ in MESSAGES], "message string, long_op_value double, timing_real_value double")
    logs = df.withColumn("timestamp", F.lit(datetime(2024, 1, 1, 10, 17)).cast("timestamp_ntz"))
    got = longops.labelled_operations(logs).withColumn("p", labels.clean_label(F.col("extracted_label")))
    expected = sorted((m, p) for m, p in MESSAGES if p is not None)
    assert rows(got, "message", "p") == expected
    assert longops.long_operations(logs).filter("bucket = '2024-01-01 10:10:00'").agg(F.sum("c")).first()[0] == len(expected)
    nothing = logs.withColumn("long_op_value", F.lit(None).cast("double"))
    assert longops.labelled_operations(nothing).count() == 0


def test_second_measure_is_used_and_sample_is_short(spark):
    logs = spark.createDataFrame(
        [("Read took a long" + "x" * 200, None, 2.0, datetime(2024, 1, 1)), ("Read took a long", 3.0, 9.0, datetime(2024, 1, 1))],
        "message string, long_op_value double, timing_real_value double, timestamp timestamp_ntz")
    assert rows(longops.long_operations(logs), "prefix", "c", "avg", "max") == [("Read", 2, 2.5, 3.0)]
    sample = longops.label_sample(logs)
    assert max(len(r.message_preview) for r in sample.collect()) == 100
    assert rows(longops.label_summary(logs)) == [("Read", 2, 2.5, 3.0, 2.0)]


def test_stored_forms_and_alignment(spark):
    docs = spark.createDataFrame([
        ("a", '{"long_operations": {"Read": {"2024-01-01 10:00:00": {"c": 2, "avg": 1.5, "max": 2}}}}'),
        ("b", '{"long_operations": [{"message_prefix": "Read", "time_interval": "2024-01-01 10:00:00", "avg_long_op_value": 1.0,'
              ' "max_long_op_value": 1.0, "occurrence_count": 1}, {"message_prefix": "Read", "time_interval": "2024-01-01 10:00:00",'
              ' "avg_long_op_value": 1.5, "max_long_op_value": 2.0, "occurrence_count": 2}, {"time_interval": "t"}]}'),
        ("c", '{"nodes": {}}'), ("d", "not json"), ("e", '{"long_operations": null}'), ("f", None),
    ], "id string, json_report string")
    got = longops.stored_longops(docs)
    assert rows(got) == [
        ("a", "Read", "2024-01-01 10:00:00", 2, 1.5, 2.0), ("b", "Read", "2024-01-01 10:00:00", 2, 1.5, 2.0),
        ("b", "Unknown", "t", 0, 0.0, 0.0)]
    ops = spark.createDataFrame([("A took a long", "1", 1, 2.0, 3.0), ("B", "2", 1, 4.0, 5.0)],
                                "prefix string, bucket string, c bigint, avg double, max double")
    assert rows(longops.align_series(ops), "label", "bucket", "value") == [
        ("A", "1", 2.0), ("A", "2", None), ("B", "1", None), ("B", "2", 4.0)]
    assert rows(longops.result_size(ops)) == [(2, 2)]
    assert [r.prefix for r in longops.label_rollup(ops).collect()] == ["A took a long", "B"]


def test_a_missing_bundle_is_one_like_others(spark):
    h = hist(spark, ("2024-01-01T00:00:00Z", 1), ("2024-01-11T00:00:00Z", 1), ("2024-01-11T02:00:00Z", 2))
    both = h.withColumn("id", F.lit(None).cast("string")).union(h.filter("minute < '2024-01-05'").withColumn("id", F.lit("a")))
    assert rows(series.rebucket(both, 60, by=["id"]), "id", "minute", "count") == [
        (None, "2024-01-11T00:00:00Z", 1), (None, "2024-01-11T02:00:00Z", 2), ("a", "2024-01-01T00:00:00Z", 1)]
    assert rows(series.quick_range(both, "1d", ["id"]), "id", "minute") == [
        (None, "2024-01-11T00:00:00Z"), (None, "2024-01-11T02:00:00Z"), ("a", "2024-01-01T00:00:00Z")]
    recent = series.rebucket(both, 60, by=["id"])
    filled = rows(series.fill_gaps(series.message_totals(recent, by=["id"]), 60, ["id"]), "id", "minute", "count")
    assert [(i, m[11:13], c) for i, m, c in filled] == [(None, "00", 1), (None, "01", 0), (None, "02", 2), ("a", "00", 1)]


def test_alignment_with_missing_bundles_and_times(spark):
    points = [(None, "x", "2024-01-01 10:00:00", 1.0), (None, "y", "2024-01-02 10:10:00", 2.0), ("a", "x", "2024-01-01 10:00:00", 3.0),
              ("a", "z", None, 4.0)]
    ops = spark.createDataFrame(points, "id string, prefix string, bucket string, avg double")
    assert rows(longops.align_series(ops, ["id"]), "id", "prefix", "bucket", "value") == [
        (None, "x", "2024-01-01 10:00:00", 1.0), (None, "x", "2024-01-02 10:10:00", None), (None, "y", "2024-01-01 10:00:00", None),
        (None, "y", "2024-01-02 10:10:00", 2.0), ("a", "x", "2024-01-01 10:00:00", 3.0), ("a", "z", None, 4.0), ("a", "z", "2024-01-01 10:00:00", None)]
    assert longops.align_series(ops).count() == 7
    assert longops.align_series(ops.limit(0)).count() == longops.align_series(ops.limit(0), ["id"]).count() == 0
