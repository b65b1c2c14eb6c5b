"""Raw log text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.functions.paths import DISCOVERED_SERVERS, is_log_file


def drop_invalid_utf8(line: Column) -> Column:
    """The line without bytes that are not UTF-8."""
    repaired = F.replace(F.make_valid_utf8(line), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(line), line).otherwise(repaired)


def read_log_lines(spark: SparkSession, paths: str | Sequence[str], servers=DISCOVERED_SERVERS) -> DataFrame:
    """Lines of all log files below the paths, ``.gz`` files included.

    Only files whose name holds one of ``servers`` and ``log`` are taken; None
    takes every file. ``line_block`` is the start of the file split a line was
    read from and ``line_no`` counts on inside it. Plain files are split over
    tasks, a gzip file is one task; write its lines as Parquet before further
    passes.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(paths)
    if servers is not None:  # below the numbering of lines, so that other files are not opened
        raw = raw.filter(is_log_file(F.col("_metadata.file_path"), servers))
    return raw.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("line_block"),
        F.monotonically_increasing_id().alias("line_no"),
        drop_invalid_utf8(F.col("value")).alias("line"),
    )
