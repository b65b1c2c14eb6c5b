"""Log files of raw bundles: metadata, time ranges, pruning.

``lines`` has ``file_path``, ``line_block``, ``line_no`` and ``line``: blocks are
pieces of a file in file order, and numbers count the lines of a block in file
order without holes, from any start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.functions.paths import log_type, node_name, sub_type
from bundlelens.functions.timestamps import is_short_form, line_stamp, second_text, stamp_time


def parse_lines(lines: DataFrame, reference_year: int) -> DataFrame:
    """Adds the time of each line.

    The time comes out of a one-element ``inline``: filters on it stay above, so
    the line is parsed once and not again for every condition.
    """
    parsed = F.struct(stamp_time(F.col("_stamp"), reference_year).alias("timestamp"))
    return lines.withColumn("_stamp", line_stamp(F.col("line"))).select(
        *lines.columns, F.inline(F.array(parsed)))


def with_file_facts(rows: DataFrame) -> DataFrame:
    """Adds node, log type and sub type, read off ``file_path`` (meant for one row per file)."""
    path = F.col("file_path")
    return rows.withColumns({"node_name": node_name(path), "log_type": log_type(path), "sub_type": sub_type(path)})


def log_files(parsed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per file: start, end, and why it is rejected if it is.

    The start is the first readable time, the end the last one. A file of year-less times that starts in December and ends in January
    ends in the next year. Files without a range, or with one that runs
    backwards, are rejected.

    One pass: lines shrink to one row per block by hash aggregation, and a huge
    file is many blocks.
    """
    key = [*by, "file_path"]
    ts, block = F.col("timestamp"), F.col("line_block")
    timed = F.when(ts.isNotNull(), F.col("line_no"))
    blocks = parsed.groupBy(*key, "line_block").agg(
        F.count("*").alias("_n"), F.max(timed).alias("_timed_no"),
        F.min_by(ts, timed).alias("_first"), F.min_by(is_short_form(F.col("line")), timed).alias("_short"),
        F.max_by(ts, timed).alias("_last"),
    )
    timed_block = F.when(F.col("_timed_no").isNotNull(), block)
    spans = blocks.groupBy(*key).agg(
        F.sum("_n").alias("lines"), F.min_by("_first", timed_block).alias("start_time"),
        F.min_by("_short", timed_block).alias("_short"), F.max_by("_last", timed_block).alias("_last"),
    )
    return ranges_of(spans, [*key, "lines"])


def ranges_of(spans: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows of files from their first and last readable time (``start_time``, ``_last``).

    ``_short`` says whether the first was without a year.
    """
    start, end = F.col("start_time"), F.col("_last")
    rolls = F.col("_short") & (end < start) & (F.month(start) == 12) & (F.month(end) == 1)
    end_time = F.when(rolls, end + F.expr("INTERVAL 1 YEAR")).otherwise(end)
    return with_file_facts(spans.select(
        *keep, "start_time", end_time.alias("end_time"),
        F.coalesce(rolls, F.lit(False)).alias("rolls_over"),
        F.when(start.isNull() | end.isNull(), "no time range").when(start > end_time, "start after end").alias("rejected"),
    ))


def valid_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("rejected").isNull())


def prune_files(files: DataFrame, start, end) -> DataFrame:
    """Accepted files whose time range overlaps [start, end]."""
    return valid_files(files).filter(
        (F.col("start_time") <= F.lit(end).cast("timestamp_ntz"))
        & (F.col("end_time") >= F.lit(start).cast("timestamp_ntz"))
    )


def lines_of(parsed: DataFrame, files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lines of the given files with the files' node, log type and sub type.

    Times past New Year move to the next year. Pass ``files`` as a stored table:
    Spark then knows its size before it decides whether the lines must move.
    """
    key = [*by, "file_path"]
    kept = files.select(
        *key, "node_name", "log_type", "sub_type", "rolls_over", F.col("start_time").alias("_start"))
    ts = F.col("timestamp")
    late = F.col("rolls_over") & is_short_form(F.col("line")) & (ts < F.col("_start")) & (F.month(ts) == 1)
    return (
        parsed.join(kept, key)
        .withColumn("timestamp", F.when(late, ts + F.expr("INTERVAL 1 YEAR")).otherwise(ts))
        .drop("rolls_over", "_start")
    )


def bundle_counts(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of accepted files, nodes and log types of a bundle."""
    return valid_files(files).groupBy(*by).agg(
        F.count("*").alias("files"),
        F.count_distinct("node_name").alias("nodes"),
        F.count_distinct("log_type").alias("log_types"),
    )


def bundle_members(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The nodes of a bundle with their log types."""
    return valid_files(files).select(*by, "node_name", "log_type").distinct()


def file_metadata(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Start and end of each accepted file as text: the rows of the metadata dump."""
    return valid_files(files).select(
        *by, "node_name", "log_type", "sub_type", "file_path",
        second_text(F.col("start_time")).alias("logStartsAt"), second_text(F.col("end_time")).alias("logEndsAt"),
    )
