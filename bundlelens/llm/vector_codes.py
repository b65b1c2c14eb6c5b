"""Vector code compression: codebooks per part, learnt by rounds over a trie of the distinct parts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bundlelens.llm.common import carried, col
from bundlelens.llm.vectors import longest, packed, sound, unpacked, whole
from bundlelens.session import written

RESULTS = ("code", "error", "label_error", "codebooks_sha256")
LIMIT = 1 << 24
"""Whole numbers beyond this count as it, so that squared distances stay exact."""
LEAVES = 512
"""Leaves of the trie that are walked at a time; each holds a vector of distances to all entries."""
BROADCAST_LABELS = 10_000
"""Sums of errors per label up to this many are broadcast; more are joined by a shuffle."""


class Trie:
    """Walks the trie of sorted distinct parts depth first and keeps the distance vectors of the path it is on.

    A node is a prefix of a part; its vector holds the squared distances of that prefix to the same prefix of every entry.
    It is its parent's vector plus one dimension, so parts with a common prefix share that work. Leaves are visited in
    sorted runs; between runs only the path to the last leaf is kept, so memory doesn't depend on the number of parts.
    """

    def __init__(self, entries: np.ndarray):
        self.depth = entries.shape[1]
        self.entries = entries
        self.last = None
        self.path: list = [None] * self.depth

    def _kind(self, parts):
        largest = max(int(np.abs(parts).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        return np.int32 if 4 * largest * largest * max(1, self.depth) < 2 ** 31 else np.int64

    def leaves(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of sorted parts; ties go to the lower entry."""
        found = [self._run(parts[at:at + LEAVES]) for at in range(0, len(parts), LEAVES)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(column) for column in zip(*found))

    def _run(self, parts):
        rows = len(parts)
        if not self.depth:
            return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        before = parts[:1] - 1 if self.last is None else self.last
        differ = parts != np.concatenate([before, parts[:-1]])
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), self.depth)
        kind = self._kind(parts)
        entries = self.entries.astype(kind)
        node = np.zeros(rows, np.int64)
        above = np.zeros((1, len(entries)), kind)
        for level in range(self.depth):
            new = shared <= level
            kept = not new[0]  # the first leaf goes on along the path of the run before
            new[0] = True
            first = np.flatnonzero(new)
            parents = node[first]
            if kept:
                fresh = first[1:]
                gap = parts[fresh, level].astype(kind)[:, None] - entries[:, level]
                gap *= gap
                gap += above[parents[1:]]
                here = np.concatenate([self.path[level][None].astype(kind), gap])
            else:
                here = parts[first, level].astype(kind)[:, None] - entries[:, level]
                here *= here
                here += above[parents]
            node = np.cumsum(new) - 1
            self.path[level] = here[-1].copy()
            above = here
        self.last = parts[-1:]
        best = above.argmin(axis=1)
        return best[node], above[np.arange(len(above)), best].astype(np.int64)[node]


def sums_of(entries: np.ndarray, nearest: np.ndarray, parts: np.ndarray, weights: np.ndarray, counts, sums) -> None:
    """Adds the weighted parts of each entry to ``sums`` and their weights to ``counts``."""
    order = np.argsort(nearest, kind="stable")
    starts = np.flatnonzero(np.diff(nearest[order], prepend=-1))
    used = nearest[order][starts]
    counts[used] += np.add.reduceat(weights[order], starts)
    if parts.shape[1]:
        sums[used] += np.add.reduceat(parts[order] * weights[order, None], starts, axis=0)


def distinct_parts(vectors: DataFrame, vector: str, width: int, parts: int, scale: float) -> DataFrame:
    """(position, part, weight): the distinct parts of all vectors, sorted within ranges, and how often they occur."""
    step = width // parts

    def cut(batches):
        for batch in batches:
            rows = whole(batch.column(0), width, scale, LIMIT)
            for position in range(parts):
                piece = rows[:, position * step:(position + 1) * step]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), position, np.int32)), packed(piece)], names=["position", "part"])

    counted = vectors.select(col(vector).cast("array<double>").alias("v")).mapInArrow(cut, "position int, part binary") \
        .groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight"))
    return written(counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "parts")


def learnt(pieces: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (position x entry x component) after one round over the distinct parts."""
    parts, entries, step = books.shape

    def assign(batches):
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        tries = [Trie(book) for book in books]
        for batch in batches:
            position = batch.column(0).to_numpy()
            rows, weights = unpacked(batch.column(1), step), batch.column(2).to_numpy()
            for p in np.unique(position):
                mine = position == p
                nearest, _ = tries[p].leaves(rows[mine])
                sums_of(books[p], nearest, rows[mine], weights[mine], counts[p], sums[p])
        p, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(p, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[p, entry], pa.int64()),
            pa.array(sums[p, entry].tolist(), pa.list_(pa.int64()))], names=["position", "entry", "n", "sums"])

    partial = pieces.select("position", "part", "weight").mapInArrow(assign, "position int, entry int, n bigint, sums array<bigint>")
    total = partial.groupBy("position", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(step)])
    out = books.copy()
    for row in total.collect():
        out[row["position"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(step)]
    return out


def coded(vectors: DataFrame, books: np.ndarray, vector: str, scale: float, keep) -> DataFrame:
    """The columns ``keep`` (as ``c0``, …) with ``code`` and ``error`` of each vector."""
    parts, _, step = books.shape
    schema = T.StructType([T.StructField(f"c{i}", vectors.schema[name].dataType) for i, name in enumerate(keep)]
                          + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def assign(batches):
        for batch in batches:
            rows = whole(batch.column(len(keep)), parts * step, scale, LIMIT)
            codes, errors = np.zeros((len(rows), parts), np.uint8 if books.shape[1] <= 256 else np.uint32), np.zeros(len(rows), np.int64)
            for p in range(parts if step else 0):
                distinct, place = np.unique(rows[:, p * step:(p + 1) * step], axis=0, return_inverse=True)
                nearest, distance = Trie(books[p]).leaves(distinct)
                codes[:, p] = nearest[place.ravel()]
                errors += distance[place.ravel()]
            digits = codes.astype(f">u{codes.itemsize}").tobytes().hex()
            size = 2 * codes.itemsize * parts
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))]
                + [pa.array([digits[i:i + size] for i in range(0, len(digits), size)], pa.string()), pa.array(errors, pa.int64())],
                names=schema.names)

    columns = [col(name).alias(f"c{i}") for i, name in enumerate(keep)]
    return vectors.select(*columns, col(vector).cast("array<double>").alias("v")).mapInArrow(assign, schema)


def first_books(vectors: DataFrame, width: int, parts: int, entries: int, scale: float, vector: str, key: str) -> np.ndarray:
    """Codebooks that hold the parts of the vectors with the smallest keys (a null key last, equal keys by vector)."""
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    rows = vectors.select(col(key).alias("id"), col(vector).cast("array<double>").alias("v")).orderBy(*order).limit(entries).collect()
    values = whole(pa.array([row["v"] for row in rows], pa.list_(pa.float64())), width, scale, LIMIT)
    return np.ascontiguousarray(values.reshape(len(rows), parts, width // parts).swapaxes(0, 1))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0,
             vector: str = "embedding", key: str = "vec_id", label: str = "label", carry=None) -> DataFrame:
    """Adds ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` to every row with a sound vector.

    Components become floor(scale * x), vectors are cut into ``parts`` equal parts, and each part's codebook starts from the
    rows with the ``entries`` smallest keys. A round assigns every part to its nearest entry and moves each entry to the mean
    of its parts, rounded down; unused entries stay. ``code`` holds the entries' numbers (two hex digits each up to 256
    entries, eight beyond), ``error`` the squared distances, ``label_error`` their sum over equal labels.

    The distinct parts with their counts are stored once, sorted by range, so copies cost one leaf and neighbours in a
    task share prefixes of the trie. A round reads that table and sends each task's sums per entry: only
    entries x components numbers come to the driver, whatever the number of rows. The last assignment reads
    the vectors where they lie. Nothing but errors per label is shuffled after that, summed first, so a hot label is cheap.

    Rows whose vector is null or holds null or non-finite components are left out. Rows that repeat a key are rows like
    others, a null key sorts last, and null labels are one label. Vectors shorter than the longest (rounded up to a multiple of ``parts``) are
    filled up with zeros; components beyond 2^24 after scaling count as 2^24. An empty table gives an empty one. Input
    columns named like a result give way to it.
    """
    keep = carried(vectors, carry, RESULTS)
    kept = vectors.filter(sound(col(vector)))
    width = -(-longest(kept, vector) // parts) * parts
    books = first_books(kept, width, parts, entries, scale, vector, key)
    pieces = distinct_parts(kept, vector, width, parts, scale)
    for _ in range(rounds if books.shape[1] else 0):
        books = learnt(pieces, books)

    names = keep if label in keep else keep + [label]
    at = f"c{names.index(label)}"
    rows = written(coded(kept, books, vector, scale, names), "codes")
    sums = rows.groupBy(F.col(at).alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum")).select(
        "_label", F.least(F.col("_sum"), F.lit(2 ** 63 - 1).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col(at).eqNullSafe(F.col("_label"))).select(
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(keep)], "code", "error", "label_error",
        F.lit(digest(books)).alias("codebooks_sha256"))
