"""Reports for point lookups: sorted by id, with a small manifest of which file holds which ids.

A lookup reads the manifest and then opens the files whose range holds the id: one, as the ranges don't overlap. Inside
the file, statistics and a Bloom filter skip row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 200_000
MANIFEST = "file string, low string, high string, rows bigint"


def write_lookup(reports: DataFrame, root: str, rows_per_file: int = ROWS_PER_FILE, key: str = "id") -> None:
    """Stores reports for lookups by ``key`` (text). Rows without a key are left out: no lookup asks for them."""
    rows = reports.filter(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("string"))
    files = max(1, -(-rows.count() // rows_per_file))
    # A range is one file; repeated ids share a range, so it may be larger.
    rows.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").option(
        f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", str(16 << 20)).parquet(f"{root}/rows")
    stored = rows.sparkSession.read.parquet(f"{root}/rows")
    manifest = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))
    manifest.repartition(1).write.mode("overwrite").parquet(f"{root}/manifest")


def files_of(spark: SparkSession, root: str, ids) -> list[str]:
    """The files that may hold one of the ids."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    wanted = spark.createDataFrame([(str(i),) for i in ids], "wanted string")
    found = manifest.join(wanted, F.col("wanted").between(F.col("low"), F.col("high")), "left_semi")
    return sorted(row["file"] for row in found.select("file").collect())


def find_reports(spark: SparkSession, root: str, *ids: str, key: str = "id") -> DataFrame:
    """The stored rows with these ids."""
    files = files_of(spark, root, ids)
    rows = spark.read.parquet(*files) if files else spark.read.parquet(f"{root}/rows").limit(0)
    return rows.filter(F.col(key).isin([str(i) for i in ids]))
