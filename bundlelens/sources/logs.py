"""Parquet log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_logs(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """All Parquet files directly inside ``path`` as one table."""
    return spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "false").parquet(path)


def bundle_name(logs: DataFrame, path: str) -> DataFrame:
    """One bundle name: the smallest in the table, else the directory's name."""
    fallback = path.rstrip("/").rsplit("/", 1)[-1]
    name = F.min(F.nullif(F.col("support_bundle"), F.lit("")))
    return logs.agg(F.coalesce(name, F.lit(fallback)).alias("bundle_name"))


def _listing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Path and length of the files; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")


def profile_files(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Number of files, bytes and megabytes; an ``error`` text when there are none."""
    return _listing(spark, path, glob).agg(
        F.count("*").alias("file_count"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_size_bytes"),
        (F.coalesce(F.sum("length"), F.lit(0)) / (1024 * 1024)).alias("total_size_mb"),
        F.when(F.count("*") == 0, F.lit("No Parquet files found")).alias("error"),
    )


def first_files(spark: SparkSession, path: str, glob: str = "*.parquet", files: int = 10) -> DataFrame:
    """Names of the first files."""
    names = _listing(spark, path, glob).select(F.substring_index("path", "/", -1).alias("file"))
    return names.orderBy("file").limit(files)


def table_columns(table: DataFrame) -> list[tuple[str, str]]:
    """Column names and types."""
    return [(f.name, f.dataType.simpleString()) for f in table.schema.fields]
