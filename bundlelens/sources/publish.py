"""Reports published as one step: all tables of a report become visible by one commit row.

Each publication writes its tables into fresh folders (``version=…``) and then one small file of commit rows, a row
per report. Readers keep what the newest commit of a report names, so a publication that failed, is still running, or was
replaced is invisible. A report is withdrawn by a commit without a version.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.session import remove

COMMITS = "report_id string, version string, committed_at timestamp, sequence bigint, tables array<string>"


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at a path, None if nothing is there; any other trouble is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as trouble:
        if trouble.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def commits(spark: SparkSession, root: str) -> DataFrame:
    """All commit rows, also of replaced publications."""
    found = existing(spark, f"{root}/commits", COMMITS)
    return spark.createDataFrame([], COMMITS) if found is None else found


def current(spark: SparkSession, root: str) -> DataFrame:
    """(report_id, version, tables) of the reports that can be seen."""
    newest = F.max_by(F.struct("version", "tables"), F.struct("sequence", "committed_at", F.coalesce("version", F.lit(""))))
    found = commits(spark, root).groupBy("report_id").agg(newest.alias("_c"))
    return found.select("report_id", "_c.version", "_c.tables").filter(F.col("version").isNotNull())


def _commit(rows: DataFrame, root: str, version: str | None, tables: Iterable[str]) -> None:
    """One file with a row per report; it appears by one rename or not at all."""
    spark = rows.sparkSession
    last = commits(spark, root).agg(F.max("sequence")).first()[0] or 0
    rows.select(
        F.col("report_id").cast("string").alias("report_id"), F.lit(version).cast("string").alias("version"),
        F.current_timestamp().alias("committed_at"), F.lit(last + 1).cast("bigint").alias("sequence"),
        F.array(*[F.lit(name) for name in tables]).cast("array<string>").alias("tables"),
    ).distinct().repartition(1).write.mode("append").parquet(f"{root}/commits")


def publish(root: str, tables: Mapping[str, DataFrame], reports: DataFrame | None = None) -> str:
    """Publishes the reports whose ``report_id`` the tables hold, all at once; returns the version.

    What a report had before is replaced by it, in every table. ``reports`` names them where a report may have no rows at all;
    else they are the ids of all tables. Publishing again after a failure is harmless.
    """
    version = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{root}/{name}/version={version}")
    spark = next(iter(tables.values())).sparkSession
    if reports is None:
        parts = [spark.read.parquet(f"{root}/{name}/version={version}").select("report_id") for name in tables]
        reports = parts[0]
        for part in parts[1:]:
            reports = reports.union(part)
    _commit(reports, root, version, tables)
    return version


def withdraw(spark: SparkSession, root: str, report_id: str) -> bool:
    """Takes a report out of every table; False when it isn't there."""
    found = current(spark, root).filter(F.col("report_id") == report_id).select("report_id")
    if found.isEmpty():
        return False
    _commit(spark.createDataFrame([(report_id,)], "report_id string"), root, None, [])
    return True


def read_published(spark: SparkSession, root: str, name: str, report_id: str | None = None) -> DataFrame:
    """The rows of a table that can be seen, of one report or of all.

    The commits choose folders, so folders of replaced and failed publications are not opened.
    """
    seen = current(spark, root).filter(F.array_contains("tables", name)).select("report_id", "version")
    if report_id is not None:
        seen = seen.filter(F.col("report_id") == report_id)
    versions = [row["version"] for row in seen.select("version").distinct().collect()]
    if not versions:
        folders = f"{root}/{name}"
        if existing(spark, folders, "report_id string") is None:
            raise ValueError(f"no report was published with a table {name!r}")
        rows = spark.read.parquet(folders).filter(F.lit(False))
        return rows.drop("version")
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(*[f"{root}/{name}/version={v}" for v in versions])
    rows = rows if report_id is None else rows.filter(F.col("report_id") == report_id)
    return rows.withColumn("version", F.col("version").cast("string")).join(seen, ["report_id", "version"], "left_semi").drop("version")


def vacuum(spark: SparkSession, root: str, names: Iterable[str], hours: float = 24.0) -> list[str]:
    """Deletes the folders that no visible report needs and that no file was written to for some hours; returns them.

    The hours leave running publications alone.
    """
    needed = {row["version"] for row in current(spark, root).select("version").distinct().collect()}
    gone = []
    for name in names:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{name}")
        folder = F.regexp_extract("path", "^(.*/version=([^/]+))/", 1)
        ages = files.groupBy(folder.alias("folder"), F.regexp_extract("path", "/version=([^/]+)/", 1).alias("version")).agg(
            F.max("modificationTime").alias("at"))
        old = ages.filter(F.col("at") < F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600)))
        gone += [row["folder"] for row in old.collect() if row["version"] not in needed]
    for folder in gone:
        remove(spark, folder)
    return gone
