"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def build_session(app: str = "bundlelens", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every job here relies on.

    The number of shuffle partitions is left to the cluster (AQE coalesces small
    ones); pass ``**{"spark.sql.shuffle.partitions": "8"}`` for local runs.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's shared folder (``spark.checkpoint.dir``).

    Without that setting it lies below the session's warehouse, which executors share too.
    It stays until ``remove`` is called, or until the end of the ``scratch`` block it was made in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file systems; one that isn't there is fine."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the shared folders that are made inside the block when it ends.

    For work whose result is written inside the block, to a path chosen before it: the intermediate tables go as soon as
    nothing reads them any more.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            remove(spark, path)


DROPS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffles_dropped(spark: SparkSession):
    """What is written inside the block leaves no shuffle files behind, so they don't lie beside those of later steps.

    Otherwise they stay until the driver happens to collect its garbage.
    """
    return settings(spark, {DROPS_SHUFFLES: "true"})


def written(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read back.

    For results that several passes need: they are computed once, and a lost
    executor does not send the job back to the raw data.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
