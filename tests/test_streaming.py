from datetime import datetime, timedelta

from bundlelens.operators import logstats, match
from bundlelens.schemas import BUNDLE_FLAGS, BUNDLE_HEADER, LOG_EVENTS, NODE_INVENTORY
from bundlelens.sources import store
from bundlelens.sources.catalog import load_patterns
from bundlelens.streaming.incremental import KEYS, collected_minutes, follow_logs
from tests.conftest import rows


def test_incremental_equals_batch(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    patterns = load_patterns()
    messages = ["Soft memory limit exceeded", "Unable to pick leader", "nothing"]

    def add(first):
        spark.createDataFrame(
            [(datetime(2024, 1, 1) + timedelta(seconds=20 * i), f"n{i % 3}", "yb-master", messages[i % 3], f"b{i % 2}", "f", None, None)
             for i in range(first, first + 50)], LOG_EVENTS).write.mode("append").parquet(source)

    for first in (0, 25, 100):
        add(first)
        query = follow_logs(spark, source, target, checkpoint, patterns)
        assert query.awaitTermination(120)
        hits = match.match_all(spark.read.schema(LOG_EVENTS).parquet(source), patterns)
        batch = match.name_patterns(logstats.minute_stats(hits, ["support_bundle"]), patterns)
        columns = [*KEYS, "bucket", "count", "start_time", "end_time"]
        assert rows(collected_minutes(spark, target), *columns) == rows(batch, *columns)


def test_catalogue_tables(spark, tmp_path):
    for name, schema in (("headers", BUNDLE_HEADER), ("flags", BUNDLE_FLAGS), ("nodes", NODE_INVENTORY)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    assert [t.count() for t in store.read_catalogue(spark, str(tmp_path))] == [0, 0, 0]
