"""Event-time streams against the batch results, with late lines and restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bundlelens.operators import logstats, longops, match
from bundlelens.sources.catalog import Pattern
from bundlelens.streaming import windows
from tests.conftest import rows

KIND = "timestamp timestamp_ntz, node_name string, log_type string, message string, long_op_value double, timing_real_value double"
PATTERNS = [Pattern("custom", "limit", "limit exceeded"), Pattern("custom", "long", "took a long")]
START = datetime(2024, 1, 5, 10, 0)


def lines(dice, begin, n, minutes):
    out = []
    for _ in range(n):
        at = begin + timedelta(seconds=dice.randint(0, 60 * minutes))
        message = dice.choice(["Soft limit exceeded", "UpdateReplica took a long time", "Log callback took a long time", "nothing", None])
        out.append((at, dice.choice(["n1", "n2", None]), "yb-tserver", message, dice.choice([1.5, None]), dice.choice([0.25, 2.0])))
    return out


@pytest.fixture
def folder(spark, tmp_path):
    root = str(tmp_path / "logs")

    def arrive(rows_of_file):
        spark.createDataFrame(rows_of_file, KIND).coalesce(1).write.mode("append").parquet(root)
    return root, arrive, tmp_path


def streamed(spark, root, tmp_path, make, name):
    logs = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(root)
    query = windows.append_closed(make(logs), str(tmp_path / name), str(tmp_path / f"{name}-state"))
    query.awaitTermination()
    dropped = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    return spark.read.parquet(str(tmp_path / name)), dropped


def test_closed_windows_equal_the_batch(spark, folder):
    root, arrive, tmp_path = folder
    dice = random.Random(3)
    minutes = lambda logs: windows.closed_minutes(logs, PATTERNS, lateness="10 minutes")
    operations = lambda logs: windows.closed_operations(logs, lateness="10 minutes")
    columns = ["node_name", "pattern_id", "minute", "count", "start_time", "end_time"]
    for hour in range(3):  # each file overlaps the one before by less than the lateness
        arrive(lines(dice, START + timedelta(minutes=60 * hour - 5 * (hour > 0)), 200, 60))
        closed, dropped = streamed(spark, root, tmp_path, minutes, "minutes")
        ops, lost = streamed(spark, root, tmp_path, operations, "operations")
        assert dropped == lost == 0
    batch = spark.read.parquet(root)
    stats = logstats.minute_stats(match.match_all(batch, PATTERNS))
    bound = batch.agg(F.max("timestamp")).first()[0] - timedelta(minutes=10)
    whole = stats.filter(F.col("bucket") + F.expr("INTERVAL 1 MINUTE") <= F.lit(bound)).withColumn("minute", logstats.minute_key(F.col("bucket")))
    found = rows(closed, *columns)
    assert found == rows(whole, *columns) and len(found) > 100
    kept = [r for r in rows(longops.long_operations(batch), "prefix", "bucket", "c", "avg", "max")
            if datetime.fromisoformat(r[1]) + timedelta(minutes=10) <= bound]
    assert rows(ops, "prefix", "bucket", "c", "avg", "max") == kept
    # The rest comes when a later line closes it.
    arrive([(START + timedelta(days=1), "n1", "yb-tserver", "nothing", None, None)] * 2)
    closed, _ = streamed(spark, root, tmp_path, lambda logs: windows.closed_minutes(logs, [*PATTERNS[:2]], lateness="10 minutes"), "minutes")
    assert closed.agg(F.sum("count")).first()[0] == match.match_all(batch, PATTERNS).count()


def test_lines_beyond_the_lateness_are_dropped_and_counted(spark, folder):
    root, arrive, tmp_path = folder
    hit = lambda minute, n=1: [(START + timedelta(minutes=minute), "n1", "t", "limit exceeded", None, None)] * n
    make = lambda logs: windows.closed_minutes(logs, PATTERNS, lateness="10 minutes")
    arrive(hit(0) + hit(60))
    streamed(spark, root, tmp_path, make, "out")
    arrive(hit(0, 3) + hit(55, 2))
    _, dropped = streamed(spark, root, tmp_path, make, "out")
    arrive(hit(300))
    found, _ = streamed(spark, root, tmp_path, make, "out")
    assert rows(found, "minute", "count") == [("2024-01-05T10:00:00Z", 1), ("2024-01-05T10:55:00Z", 2), ("2024-01-05T11:00:00Z", 1)]
    assert dropped == 1  # rows are counted after they were added up within a task
