"""Joins on columns that may be null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """The join on columns of the same names, where null equals null: a missing bundle is a bundle like others.

    ``how`` is inner, left or full; Spark hashes such keys like others, so it is a plain equi-join.
    """
    other = right.withColumnsRenamed({c: f"_other_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_other_{c}")) for c in on])
    joined = left.join(other, same, how)
    if how == "full":
        joined = joined.withColumns({c: F.coalesce(c, f"_other_{c}") for c in on})
    return joined.drop(*[f"_other_{c}" for c in on])
