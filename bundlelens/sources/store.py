"""Stored reports and tablet tables as Parquet folders.

Every write appends files or replaces whole partitions, so a lost executor only
costs its tasks. A report is deleted by recording its id; readers leave recorded
ids out, and ``compact_reports`` writes a folder without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.schemas import BUNDLE_FLAGS, BUNDLE_HEADER, NODE_INVENTORY, REPORTS
from bundlelens.sources.publish import existing, publish, read_published

TABLET_TABLES = ("cluster", "tablets", "tableinfo", "region_zone_tablets")


def _dated(rows: DataFrame, partition: str) -> DataFrame:
    """Adds the partition column: the day of storing, or the first day of its month."""
    day = F.to_date("created_at")
    return rows.withColumn("created_date", day if partition == "day" else F.to_date(F.trunc(day, partition)))


def _write_dated(rows: DataFrame, path: str, mode: str) -> None:
    """One file per date and task; dates are spread over tasks, a big one over several."""
    rows.hint("rebalance", "created_date").write.mode(mode).partitionBy("created_date").parquet(path)


def append_reports(
    documents: DataFrame, root: str, bundle: str = "support_bundle", created_at=None, partition: str = "day"
) -> None:
    """Stores documents (``bundle`` and ``json_report``) with a new id and the time of storing.

    ``created_at`` may name a column to take the time from; rows that already
    have an ``id`` keep it.
    """
    now = F.current_timestamp().cast("timestamp_ntz") if created_at is None else F.col(created_at).cast("timestamp_ntz")
    rows = documents.select(
        (F.col("id").cast("string") if "id" in documents.columns else F.uuid()).alias("id"),
        F.col(bundle).alias("support_bundle_name"), "json_report", now.alias("created_at"),
    )
    _write_dated(_dated(rows, partition), f"{root}/reports", "append")


def _deleted(spark: SparkSession, root: str) -> DataFrame | None:
    return existing(spark, f"{root}/deleted", "id string")


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """Stored reports that were not deleted."""
    rows = spark.read.schema(REPORTS).parquet(f"{root}/reports").drop("created_date")
    gone = _deleted(spark, root)
    return rows if gone is None else rows.join(gone.distinct(), "id", "left_anti")


def delete_report(spark: SparkSession, root: str, report_id: str) -> bool:
    """Deletes a report; False when there is none."""
    found = read_reports(spark, root).filter(F.col("id") == report_id).select("id").limit(1)
    if found.isEmpty():
        return False
    found.write.mode("append").parquet(f"{root}/deleted")
    return True


def compact_reports(spark: SparkSession, root: str, target: str, partition: str = "day") -> None:
    """Writes the remaining reports to a new folder."""
    _write_dated(_dated(read_reports(spark, root), partition), f"{target}/reports", "overwrite")


def read_catalogue(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bundle headers, flags and node inventory stored next to the reports."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{root}/{name}")
    return read("headers", BUNDLE_HEADER), read("flags", BUNDLE_FLAGS), read("nodes", NODE_INVENTORY)


def save_documents(documents: DataFrame, path: str) -> None:
    """Report documents as JSON lines; missing folders are made."""
    documents.write.mode("overwrite").json(path)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("support_bundle string, part string, json_report string").json(path)


def save_rows(rows: DataFrame, path: str) -> None:
    """Result rows as JSON lines, times as ISO text."""
    from bundlelens.functions.timestamps import iso_second

    times = {f.name: iso_second(F.col(f.name)) for f in rows.schema.fields
             if f.dataType.typeName() in ("timestamp", "timestamp_ntz")}
    rows.withColumns(times).write.mode("overwrite").json(path)


def write_tablet_tables(
    root: str, report_id: str, cluster: DataFrame, tablets: DataFrame, tableinfo: DataFrame, zones: DataFrame,
    document: DataFrame | None = None,
) -> str:
    """The four tables of a report, and its document, in one step: each replaces what that report had before.

    Until all are written, and if one fails, readers see what was there before. Returns the version.
    """
    parts = dict(zip(TABLET_TABLES, (cluster, tablets, tableinfo, zones)))
    if document is not None:
        parts["documents"] = document
    # uptime is always empty, and Parquet holds no interval of that kind
    named = {name: table.drop("uptime").withColumn("report_id", F.lit(report_id)) for name, table in parts.items()}
    return publish(root, named, cluster.sparkSession.createDataFrame([(report_id,)], "report_id string"))


def read_tablet_table(spark: SparkSession, root: str, name: str, report_id: str | None = None) -> DataFrame:
    """One of the tables, of one report or of all."""
    return read_published(spark, root, name, report_id)
