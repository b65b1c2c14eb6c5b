"""Embedding whitening: blockwise QR of centred rows, a bidiagonal qd solver, projections on the leading directions."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bundlelens.llm.bidiagonal import EPS, directions
from bundlelens.llm.common import carried, col
from bundlelens.llm.vectors import longest, packed, sound, unpacked, whole
from bundlelens.session import written

RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")
LIMIT = 1 << 24
"""Whole numbers beyond this count as it."""
MERGE_BYTES = 1 << 25
"""Triangles that one step of the tree holds."""
LIMB = 20
"""Bits of the pieces that long sums are cut into for exact products."""


def fit_list(vectors: DataFrame, vector: str, width: int, scale: float) -> DataFrame:
    """The distinct whole-number vectors (``x``, packed), stored."""
    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([packed(whole(batch.column(0), width, scale, LIMIT))], names=["x"])

    return written(vectors.select(col(vector).cast("array<double>").alias("v")).mapInArrow(pack, "x binary").distinct(), "fit")


def moments(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(number of rows, exact sum per dimension) of a fit list."""
    def add(batches):
        n, sums = 0, np.zeros(width, np.int64)
        for batch in batches:
            n += batch.num_rows
            sums += unpacked(batch.column(0), width).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, width), pa.int32()), pa.array([n, *sums.tolist()], pa.int64())], names=["place", "total"])

    rows = fit.mapInArrow(add, "place int, total bigint").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total = {row["place"]: int(row["total"]) for row in rows.collect()}
    return total.get(-1, 0), [total.get(i, 0) for i in range(width)]


def _reduced(blocks, width: int) -> np.ndarray:
    """R of the QR decomposition of all blocks on top of each other, one block at a time."""
    r = np.zeros((width, width))
    for block in blocks:
        r = np.linalg.qr(np.concatenate([r, block]), mode="r")
    return r


def triangle(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R (width x width) of the centred rows: each task reduces its blocks, then triangles are merged as a tree."""
    width = len(mean)
    square = lambda data: np.frombuffer(data, "<f8").reshape(width, width)

    def reduce_rows(batches):
        r = _reduced((unpacked(b.column(0), width) - mean for b in batches), width)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["node", "r"])

    def merge(batches):
        for batch in batches:
            for node, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
                r = _reduced((square(part["r"].as_py()) for part in parts), width)
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["node", "r"])

    fan_in = int(max(2, min(64, MERGE_BYTES // (8 * width * width))))
    found = written(fit.mapInArrow(reduce_rows, "node bigint, r binary"), "triangles")
    left = (found.agg(F.max("node")).first()[0] or 0) + 1
    while left > 1:
        found = found.groupBy(F.floor(F.col("node") / fan_in).alias("node")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("node").alias("at"), "r"))).alias("parts")).mapInArrow(merge, "node bigint, r binary")
        left = -(-left // fan_in)
    row = found.first()
    return square(row["r"]) if row else np.zeros((width, width))


class Whitener:
    """What is learnt from a fit list: its sums, its leading directions and their variances."""

    def __init__(self, n: int, sums: list[int], r: np.ndarray, components: int):
        self.n, self.sums = n, sums
        self.mean = np.array([s / n for s in sums]) if n else np.zeros(len(sums))
        values, self.axes = directions(r, components)
        held = values[:self.axes.shape[1]]
        total = values.sum()
        self.explained = (held / total if total else np.zeros(len(held))).tolist()
        # A direction without variance beyond rounding has no scale; its coordinates are 0.
        flat = np.sqrt(held) <= 64 * len(values) * EPS * np.sqrt(values[:1].max(initial=0.0))
        self.flat = flat.tolist()
        self.axes = self.axes * np.where(flat, 0.0, np.sqrt(n) / np.sqrt(np.where(flat, 1.0, held)))

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2 of each row, exact; beyond a long it counts as the largest long."""
        signs = np.array([-1 if s < 0 else 1 for s in self.sums], np.int64)
        left, cross, at = [abs(s) for s in self.sums], [0] * len(x), 0
        while any(left):
            limbs = signs * np.array([s & (1 << LIMB) - 1 for s in left], np.int64)
            cross = [c + (d << at) for c, d in zip(cross, (x @ limbs).tolist())]
            left, at = [s >> LIMB for s in left], at + LIMB
        squares, rest = (x * x).sum(axis=1).tolist(), sum(s * s for s in self.sums)
        n = self.n
        return [min(n * n * q - 2 * n * c + rest, 2 ** 63 - 1) for q, c in zip(squares, cross)]


def identity_error(fit: DataFrame, model: Whitener) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, over directions with variance."""
    width = len(model.sums)
    used = [i for i, flat in enumerate(model.flat) if not flat]
    if not used:
        return 0.0

    def project(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in model.project(unpacked(batch.column(0), width)).T], names=[f"z{i}" for i in range(len(model.flat))])

    z = fit.mapInArrow(project, ", ".join(f"z{i} double" for i in range(len(model.flat))))
    pairs = list(combinations_with_replacement(used, 2))
    row = z.agg(*[F.covar_pop(f"z{i}", f"z{j}").alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"p{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, components: int = 4, scale: float = 256.0, vector: str = "embedding", carry=None) -> DataFrame:
    """A row per sound vector and component: ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Components become x = floor(scale * c). The covariance is taken over the fit list, which holds each distinct x once: ``n``
    rows with exact sums S, centred at S / n. Components are its unit eigenvectors by falling eigenvalue e.
    ``deviation`` is the sum over dimensions of (n x - S)^2, ``whitened`` the projection of x - S / n over sqrt(e), ``explained``
    e over the trace, ``identity_error`` how far the covariance of the whitened fit list is from the identity.

    The covariance matrix is never formed. Tasks reduce blocks of centred rows to a triangle by QR; triangles are merged as a
    tree, so what moves is one dimension x dimension matrix per task, and one comes to the driver. There Householder
    steps make it bidiagonal, dqds finds its singular values and twisted factorisations its directions.
    Copies of a vector are dropped by a partial aggregation before the shuffle. Vectors are projected where they lie.

    Rows whose vector is null or holds null or non-finite components are left out; a null key is a key like others. Vectors shorter than
    the longest are filled up with zeros; numbers beyond 2^24 after scaling count as 2^24. A direction without
    variance has whitened 0 and takes no part in ``identity_error``. There are at most as many components as dimensions. An
    empty table gives an empty one. Input columns named like a result give way to it.
    """
    keep = carried(vectors, carry, RESULTS)
    kept = vectors.filter(sound(col(vector)))
    width = longest(kept, vector)
    fit = fit_list(kept, vector, width, scale)
    n, sums = moments(fit, width)
    mean = np.array([s / n for s in sums]) if n else np.zeros(width)
    model = Whitener(n, sums, triangle(fit, mean) if width else np.zeros((0, 0)), components)
    error = identity_error(fit, model)

    schema = T.StructType([T.StructField(f"c{i}", vectors.schema[name].dataType) for i, name in enumerate(keep)]
                          + [T.StructField("deviation", T.LongType()), T.StructField("z", T.ArrayType(T.DoubleType()))])

    def project(batches):
        for batch in batches:
            x = whole(batch.column(len(keep)), width, scale, LIMIT)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))]
                + [pa.array(model.deviation(x), pa.int64()), pa.array(list(model.project(x)), pa.list_(pa.float64()))], names=schema.names)

    rows = kept.select(*[col(name).alias(f"c{i}") for i, name in enumerate(keep)],
                       col(vector).cast("array<double>").alias("v")).mapInArrow(project, schema)
    shares = F.array(*[F.lit(share) for share in model.explained]) if model.explained else F.array().cast("array<double>")
    return rows.select("*", F.posexplode("z").alias("place", "whitened")).select(
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(keep)],
        (F.col("place") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained") if model.explained else F.lit(None).cast("double").alias("explained"),
        F.lit(error).alias("identity_error"))
