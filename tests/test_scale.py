"""What is computed once, shuffled narrow, and dealt in bounded tasks."""
import os
import re
import uuid
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from bundlelens.operators import flags, pattern_index, series
from bundlelens.plans import tablet_queries
from bundlelens.session import DROPS_SHUFFLES
from bundlelens.sources import tablet_reports
from bundlelens.sources.listing import dealt
from tests.conftest import rows

DAY = datetime(2024, 1, 1)


def watched(df, folder):
    """The rows, in one task that leaves a file each time it runs."""
    folder = str(folder)

    def read(batches):
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        yield from batches
    return df.coalesce(1).mapInArrow(read, df.schema)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (?:hash|range|Round)\w*\(.*", plan)


def replicas(spark):
    return spark.createDataFrame(
        [(f"s{i % 3}", f"t{i}", "tab", "u", "ns", "TABLET_DATA_READY", i, 1, "HAS_LEASE") for i in range(3000)],
        "node_uuid string, tablet_uuid string, table_name string, table_uuid string, namespace string, status string, "
        "sst_size bigint, wal_size bigint, lease_status string")


def servers(spark):
    return spark.createDataFrame([("TSERVER", f"s{i}", "r", f"z{i}", i) for i in range(3)],
                                 "type string, uuid string, region string, zone string, pos int")


def test_report_texts_are_not_shuffled(spark):
    files = tablet_queries._report_files(SimpleNamespace(ts_tablet=lambda: replicas(spark)))
    assert len(exchanges(files)) == 1  # of columns; what is grouped and made to texts after it stays in place
    assert files.count() == 9 and files.filter(F.col("text").contains('"tabletId":"t1001"')).count() == 1


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_texts_leave_no_shuffle_files(spark):
    v = SimpleNamespace(spark=spark, ts_tablet=lambda: replicas(spark), ts_cluster=lambda: servers(spark))
    before = shuffle_files(spark)
    got = tablet_queries.tablets_from_documents(v)
    assert shuffle_files(spark) <= before  # the replicas' shuffle is gone once the entries are stored
    assert spark.conf.get(DROPS_SHUFFLES, None) in (None, "false")
    assert got.count() == 3000 and rows(got.filter("tablet_uuid = 't7'"), "node_uuid", "sst_size") == [("s1", 7)]


def test_reports_are_files_named_by_their_server(spark, tmp_path, monkeypatch):
    v = SimpleNamespace(spark=spark, ts_tablet=lambda: replicas(spark), ts_cluster=lambda: servers(spark))
    monkeypatch.setattr(tablet_queries, "shared_dir", lambda spark, label: f"file://{tmp_path}/{label}")
    want = rows(tablet_queries.tablets_from_documents(v), "node_uuid", "tablet_uuid", "sst_size", "start_key")
    got = tablet_queries.tablets_from_files(v)
    assert rows(got, "node_uuid", "tablet_uuid", "sst_size", "start_key") == want and len(want) == 3000
    assert sorted(os.listdir(tmp_path / "reports")) == [f"s{i}_tablet_report.json.gz" for i in range(3)]
    # the same where Python has no client for the store
    def none(path):
        raise NotImplementedError
    monkeypatch.setattr(tablet_queries, "shared_dir", lambda spark, label: f"file://{tmp_path}/other")
    monkeypatch.setattr(tablet_reports, "located", none)
    assert rows(tablet_queries.tablets_from_files(v), "node_uuid", "tablet_uuid", "sst_size", "start_key") == want


def test_folders_are_listed_in_few_tasks_and_once(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"b{i}").mkdir()
        (tmp_path / f"b{i}" / "n1_tablet_report.json").write_text("{}")
    started = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    before = started()
    entries = tablet_reports.scan_report_files(spark, f"file://{tmp_path}")
    stages = range(before, started())
    tasks = [info.numTasks for i in stages if (info := spark.sparkContext.statusTracker().getStageInfo(i))]
    assert max(tasks) <= 16 * spark.sparkContext.defaultParallelism < 300
    assert entries.count() == 0 and spark.conf.get(tablet_reports.LISTING_TASKS) == "10000"


def test_many_small_files_share_tasks(spark):
    small = spark.createDataFrame([(f"/{i}", 10) for i in range(100)], "path string, length bigint")
    assert dealt(small).rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    large = spark.createDataFrame([(f"/{i}", 1 << 30) for i in range(3)] + [(f"/s{i}", 1) for i in range(50)], "path string, length bigint")
    assert max(dealt(large).filter("length > 1").groupBy(F.spark_partition_id()).count().toPandas()["count"]) == 1
    assert dealt(large).count() == 53 and dealt(small, 30).rdd.getNumPartitions() == 4 and dealt(small.limit(0)).count() == 0


def test_saved_tables_compute_the_replicas_once(spark, tmp_path):
    v = SimpleNamespace(spark=spark, ts_tablet=lambda: watched(replicas(spark), tmp_path), ts_cluster=lambda: servers(spark))
    got = rows(tablet_queries.saved_tablet_tables(v), "name", "n")
    assert ("tablets", 3000) in got and ("tableinfo", 1) in got and len(os.listdir(tmp_path)) == 1


def test_gap_filling_computes_the_series_once(spark, tmp_path):
    h = spark.createDataFrame([("p", "2024-01-01T10:00:00Z", 4), ("p", "2024-01-01T12:00:00Z", 5)], "pattern string, minute string, count bigint")
    got = rows(series.fill_gaps(watched(h, tmp_path), 60), "minute", "count")
    assert [c for _, c in got] == [4, 0, 5] and len(os.listdir(tmp_path)) == 1


def test_flags_travel_with_two_bundle_names(spark):
    steps = flags.snapshot_steps(spark.createDataFrame(
        [(b, c, "o", t) for b, c, t in (("a", "c", DAY + timedelta(1)), ("b", "c", DAY), ("b", "d", DAY + timedelta(1)), ("x", "d", DAY))],
        "support_bundle string, cluster_name string, organization string, timestamp timestamp_ntz"))
    held = spark.createDataFrame([("a", "n", "t", "f", "1"), ("b", "n", "t", "f", "2"), ("b", "n", "t", "g", "1"), ("x", "m", "t", "f", "2")],
                                 "support_bundle string, node_name string, server_type string, gflag string, value string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        payload = flags.diff_payload(held, steps)
        counts = flags.change_counts(flags.flag_history(held, steps))
        for df in (payload, counts):
            assert len(exchanges(df)) == 4 and not any("cluster_name" in e for e in exchanges(df))
        # one bundle in two clusters is compared in each with what comes before it there
        assert rows(counts, "cluster_name", "node_name", "step", "added", "removed", "modified") == [
            ("c", "n", 0, 0, 0, 0), ("c", "n", 1, 1, 0, 1), ("d", "m", 1, 1, 0, 0), ("d", "n", 0, 0, 0, 0), ("d", "n", 1, 0, 2, 0)]
        assert rows(payload.filter("cluster_name = 'd' and step = 1"), "node_name", "removed") == [
            ("m", {}), ("n", {"f": "2", "g": "1"})]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_texts_with_a_space_are_found_by_grams_around_it(spark):
    assert pattern_index._grams("abc def ghi") == ["abc def", "def ghi"] and pattern_index._grams("ab cdefg") == ["ab cde", "b cdef", " cdefg"]
    found = spark.range(1).select(pattern_index._message_grams(F.lit("xabc def  ghij\nk lm"), [pattern_index.JOINT])).first()[0]
    assert sorted(found) == ["abc def", "def  gh", "ef  ghi"]
