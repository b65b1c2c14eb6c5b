"""Lists of files dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TASK_BYTES = 16 << 20
"""Bytes of files that make a task."""


def dealt(files: DataFrame, per_task: int | None = None) -> DataFrame:
    """The files (``path``, ``length``, …) over tasks, the largest ones each in another.

    A task takes up to ``per_task`` files. Without that number there are tasks for the bytes, and at least two for each core while there
    are as many files, so that very many small files do not make as many tasks.
    Files are numbered by falling size and go to the task of their number, so no two large ones share a task by chance, as they would by a
    hash. The numbering passes the list, not the files, through one task.
    """
    found, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if per_task is None:
        tasks = min(found, max(-(-size // TASK_BYTES), 2 * files.sparkSession.sparkContext.defaultParallelism))
    else:
        tasks = -(-found // per_task)
    tasks = max(1, tasks)
    number = F.row_number().over(Window.orderBy(F.desc("length"), "path")) - 1
    return files.withColumn("_n", number).repartitionById(tasks, (F.col("_n") % tasks).cast("int")).drop("_n")
