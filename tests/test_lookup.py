"""Lookups by id open one file."""

from pyspark.sql import functions as F

from bundlelens.sources import lookup
from tests.conftest import rows


def test_one_file_is_opened(spark, tmp_path):
    root = str(tmp_path / "lookup")
    reports = spark.range(1000).select(F.format_string("r%04d", "id").alias("id"), F.concat(F.lit("b"), F.col("id") % 7).alias("support_bundle_name"))
    extra = spark.createDataFrame([(None, "none"), ("r0500", "again")], "id string, support_bundle_name string")
    lookup.write_lookup(reports.union(extra), root, rows_per_file=100)
    assert len(spark.read.parquet(f"{root}/rows").inputFiles()) >= 8
    found = lookup.find_reports(spark, root, "r0500")
    assert rows(found, "support_bundle_name") == [("again",), ("b3",)] and len(found.inputFiles()) == 1
    assert len(lookup.files_of(spark, root, ["r0001", "r0999"])) == 2
    assert rows(lookup.find_reports(spark, root, "r0001", "r0999"), "id") == [("r0001",), ("r0999",)]
    assert lookup.find_reports(spark, root, "zzz").count() == lookup.find_reports(spark, root).count() == 0
    lookup.write_lookup(reports.limit(0), root)
    assert lookup.find_reports(spark, root, "r0001").count() == 0
