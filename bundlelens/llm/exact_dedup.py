"""Exact deduplication against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.common import SPACE, carried, col, placed, restored, with_texts
from bundlelens.session import written

RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text):
    """The text without its white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def open_index(spark: SparkSession, name: str, key_type: str = "bigint", buckets: int | None = None,
               path: str | None = None) -> str:
    """Declares the index table ``name`` and returns the name.

    The table is Parquet in ``buckets`` buckets (by default as many as shuffle partitions), hashed and
    sorted by digest. With ``path`` it lies in that folder and a later session opens it again with the
    same call; without, it is a table of the session's warehouse.
    """
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = f"LOCATION '{path}'" if path else ""
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id {key_type}, group_size BIGINT, batch STRING)
        USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {count} BUCKETS {place}""")
    return name


@contextmanager
def fresh_index(spark: SparkSession, key_type: str = "bigint") -> Iterator[str]:
    """An empty index for one run, dropped at the end of the block; results of ``deduplicate`` don't read it again."""
    name = open_index(spark, f"digest_index_{uuid.uuid4().hex}", key_type)
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _buckets(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def deduplicate(docs: DataFrame, index: str, batch: str = "batch", text: str = "text", key: str = "doc_id",
                carry=None) -> DataFrame:
    """Decides for every row of ``docs`` whether it stays, and appends the new digests to the index.

    Adds ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``. Texts are equal when they are
    identical without white space. Of equal texts in a batch the longest original stays, then the
    smallest key (a null key last), then one of the rows that repeat both. ``group_size`` counts the rows of this batch.
    If another batch already put a text into the index, no row stays and ``keep_id`` is the indexed one. Running a batch
    again decides and appends the same.

    A row's digest, key, length and place in its file are stored, not its text. They shrink to one row per digest before any
    shuffle, which is what keeps a hot digest cheap. Sort-merge anti-joins with the bucketed index drop what is known; the
    index is not shuffled. The next join gives each row its group: both sides are plain shuffles, so AQE splits
    a hot digest. If the text is carried along, it is read again and joined by place, which has no hot keys.

    Null texts count as empty, and all empty texts are equal. An empty table appends nothing. Input
    columns named like a result give way to it.
    """
    spark, keep = docs.sparkSession, carried(docs, carry, RESULTS)
    base = placed(docs, **{f"k{i}": col(c) for i, c in enumerate(keep)}, id=col(key), text=col(text))
    others = [f"k{i}" for i, c in enumerate(keep) if c != text]
    rows = written(base.select(
        *others, "id", "_file", "_row", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).alias("length")), "digests")
    place = F.struct((-F.col("length")).alias("length"), F.col("id").isNull().alias("no_id"), "id", "_file", "_row")
    groups = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("group_size"))
    known = spark.table(index)
    indexed = known.filter(F.col("batch") != batch).select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("found"))
    chosen = written(groups.join(indexed.hint("merge"), "digest", "left").select(
        "digest", F.col("first.id").alias("first_id"), F.col("first._file").alias("first_file"), F.col("first._row").alias("first_row"),
        "group_size", "known_id",
        F.coalesce("found", F.lit(False)).alias("old")), "groups")

    buckets = _buckets(spark, index)
    new = chosen.join(known.select("digest").hint("merge"), "digest", "left_anti").select(
        "digest", F.col("first_id").alias("keep_id"), "group_size", F.lit(batch).alias("batch"))
    if buckets != int(spark.conf.get("spark.sql.shuffle.partitions")):
        new = new.repartition(buckets, "digest")
    new.write.insertInto(index)

    groups = chosen.withColumnRenamed("digest", "group_digest")
    first = (F.col("_row") == F.col("first_row")) & (F.col("_file") == F.col("first_file"))
    found = rows.join(groups, F.col("digest") == F.col("group_digest")).select(
        *others, "_file", "_row", F.when(F.col("old"), F.col("known_id")).otherwise(F.col("first_id")).alias("keep_id"), "group_size",
        (~F.col("old") & first).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    if text in keep:
        found = with_texts(found, base, f"k{keep.index(text)}")
    return found.select(*restored(keep), *RESULTS)
