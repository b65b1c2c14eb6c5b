"""Publishing several tables as one step."""

import pytest
from pyspark.sql import functions as F

from bundlelens.sources import publish, store
from tests.conftest import rows


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def table(spark, *pairs):
    return spark.createDataFrame(pairs, "report_id string, n int")


def four(spark, n):
    return [spark.createDataFrame([(n, "x")], "n int, uptime string")] * 4


def test_a_report_is_replaced_in_all_tables(spark, root):
    publish.publish(root, {"a": table(spark, ("r1", 1), ("r2", 2)), "b": table(spark, ("r1", 10))})
    publish.publish(root, {"a": table(spark, ("r1", 3)), "b": table(spark)}, table(spark, ("r1", 0)))
    assert rows(publish.read_published(spark, root, "a"), "report_id", "n") == [("r1", 3), ("r2", 2)]
    assert rows(publish.read_published(spark, root, "b"), "report_id", "n") == []
    assert rows(publish.read_published(spark, root, "a", "r2"), "n") == [(2,)]
    assert publish.withdraw(spark, root, "r1") and not publish.withdraw(spark, root, "r1") and not publish.withdraw(spark, root, "r9")
    assert rows(publish.read_published(spark, root, "a"), "report_id") == [("r2",)]
    publish.publish(root, {"a": table(spark, ("r1", 4))})
    assert rows(publish.read_published(spark, root, "a"), "report_id", "n") == [("r1", 4), ("r2", 2)]


def test_a_failure_between_two_tables_leaves_the_old_report(spark, root):
    store.write_tablet_tables(root, "r1", *four(spark, 1), document=spark.createDataFrame([("{}",)], "json_report string"))
    broken = spark.range(1).select(F.raise_error(F.lit("no disk")).cast("int").alias("n"))
    cluster, tablets, _, zones = four(spark, 2)
    with pytest.raises(Exception, match="no disk"):
        store.write_tablet_tables(root, "r1", cluster, tablets, broken, zones)
    for name in store.TABLET_TABLES:
        assert rows(store.read_tablet_table(spark, root, name, "r1"), "n") == [(1,)]
    assert rows(store.read_tablet_table(spark, root, "documents", "r1"), "json_report") == [("{}",)]
    store.write_tablet_tables(root, "r1", *four(spark, 3))
    assert {rows(store.read_tablet_table(spark, root, name), "report_id", "n")[0] for name in store.TABLET_TABLES} == {("r1", 3)}
    assert store.read_tablet_table(spark, root, "documents", "r1").count() == 0


def test_vacuum_keeps_what_is_seen_and_what_is_young(spark, root):
    old = publish.publish(root, {"a": table(spark, ("r1", 1), ("r2", 2))})
    kept = publish.publish(root, {"a": table(spark, ("r1", 3))})
    table(spark, ("r1", 9)).write.parquet(f"{root}/a/version=running")
    assert publish.vacuum(spark, root, ["a"]) == []
    assert [f.rsplit("=", 1)[1] for f in publish.vacuum(spark, root, ["a"], hours=-1)] == ["running"]
    publish.publish(root, {"a": table(spark, ("r2", 5))})
    assert [f.rsplit("=", 1)[1] for f in publish.vacuum(spark, root, ["a"], hours=-1)] == [old]
    assert rows(publish.read_published(spark, root, "a"), "report_id", "n") == [("r1", 3), ("r2", 5)] and kept != old


def test_nothing_published(spark, root):
    with pytest.raises(ValueError):
        publish.read_published(spark, root, "a")
    assert publish.current(spark, root).count() == 0 and not publish.withdraw(spark, root, "r1")


def test_only_a_missing_folder_means_that_nothing_was_deleted(spark, root, monkeypatch):
    store.append_reports(spark.createDataFrame([("1", "b", "{}")], "id string, support_bundle string, json_report string"), root)
    assert store.read_reports(spark, root).count() == 1 and store.delete_report(spark, root, "1")
    assert store.read_reports(spark, root).count() == 0

    def refused(self, *paths):
        raise publish.AnalysisException("denied", {})
    monkeypatch.setattr(type(spark.read), "parquet", refused)
    monkeypatch.setattr(publish.AnalysisException, "getCondition", lambda self: "FAILED_READ_FILE")
    with pytest.raises(publish.AnalysisException):
        store._deleted(spark, root)
