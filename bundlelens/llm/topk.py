"""Exact top-k search: tiled matrix products, partial selection per tile, merged lists per query."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.llm.common import col
from bundlelens.session import written

EXACT = 2.0 ** 53
"""Below this, products and sums of whole numbers are exact as doubles."""
BLOCKS_PER_PART = 8
"""Pairs of groups of tiles for each shuffle partition, so that they are dealt evenly."""
HELD_TILES = 16


def quantised(vector, scale: float = 256.0):
    """floor(scale * x) of each component as a double; null where a component is null or not finite."""
    limit = F.lit(float("inf"))
    sound = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))
    return F.when(sound, F.transform(vector, lambda x: _floor(x.cast("double") * scale)))


def _floor(x):
    # floor() gives a bigint and would overflow; a double beyond 2^53 is whole already.
    return F.when(F.abs(x) < EXACT, F.floor(F.when(F.abs(x) < EXACT, x).otherwise(0.0)).cast("double")).otherwise(x)


def _packed(batches, rows: int, columns):
    """Rows (dim, row, id, values) as tiles of up to ``rows`` vectors of one dimension."""
    held: dict[int, list] = {}

    def tile(dim, items):
        ids = np.array([(row, key) for row, key, _ in items], "<i8")
        values = np.array([v for _, _, v in items], "<f8").reshape(len(items), dim)
        return pa.RecordBatch.from_arrays([
            pa.array([dim], pa.int32()), pa.array([int(ids[0, 0])], pa.int64()), pa.array([ids.tobytes()], pa.binary()),
            pa.array([values.tobytes()], pa.binary())], names=columns)

    for batch in batches:
        for dim, row, key, values in zip(*(c.to_pylist() for c in batch.columns)):
            items = held.setdefault(dim, [])
            items.append((row, key, values))
            if len(items) == rows:
                yield tile(dim, held.pop(dim))
    for dim, items in held.items():
        yield tile(dim, items)


def tiles(vectors: DataFrame, rows: int) -> DataFrame:
    """Vectors packed where they lie: dimension, tile (its first row), (row, id) pairs, values as doubles."""
    names = ["dim", "tile", "ids", "data"]
    return vectors.select("dim", "row", "id", "values").mapInArrow(
        lambda batches: _packed(batches, rows, names), "dim int, tile bigint, ids binary, data binary")


def best_of_tile(queries, query_ids, shard, shard_ids, k: int):
    """(query row, query id, id, score) of the ``k`` best of one tile for each query, ties to the smaller id."""
    if not queries.shape[1]:
        scores = np.zeros((len(queries), len(shard)))
    elif np.abs(queries).max() * np.abs(shard).max() * queries.shape[1] < EXACT:
        scores = queries @ shard.T
    else:  # exact whole numbers of any size
        whole = np.vectorize(int, otypes=[object])
        scores = np.clip(whole(queries) @ whole(shard).T, -2**63, 2**63 - 1)
    order = np.argsort(shard_ids[:, 1], kind="stable")
    scores, rows, ids = scores[:, order], shard_ids[order, 0], shard_ids[order, 1]
    for i, line in enumerate(scores):
        line = line if line.dtype == object else line.astype(np.int64)
        own = np.flatnonzero(rows == query_ids[i, 0])
        if len(line) > 4 * k and line.dtype != object:  # all that reach the k-th best, its ties included
            least = np.partition(line, len(line) - k - len(own))[len(line) - k - len(own)]
            at = np.flatnonzero(line >= least)
        else:
            at = np.arange(len(line))
        at = at[rows[at] != query_ids[i, 0]]
        for j in sorted(at.tolist(), key=lambda j: (-line[j], ids[j]))[:k]:
            yield int(query_ids[i, 0]), int(query_ids[i, 1]), int(ids[j]), int(line[j])


def _products(batches, k: int):
    names = ["query_row", "query_id", "shard", "vec_id", "score"]
    for batch in batches:
        for n in range(batch.num_rows):
            dim, shard, shard_ids, shard_data, query_ids, query_data = (c[n].as_py() for c in batch.columns)
            pairs = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in (query_ids, shard_ids)]
            queries, vectors = (np.frombuffer(x, "<f8").reshape(len(p), dim) for x, p in zip((query_data, shard_data), pairs))
            found = list(best_of_tile(queries, pairs[0], vectors, pairs[1], k))
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([shard] * len(found), pa.int64()),
                 pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=names)


def _merged(lists: DataFrame, k: int, by) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks(shards: int, asked: int, vectors_per_query: float, least: int) -> tuple[int, int]:
    """Groups of query tiles and groups of shards: ``least`` pairs of groups, or all pairs of tiles, with the fewest bytes of copies.

    A group has about ``HELD_TILES`` query tiles at most; a task holds them while the shards pass.
    """
    lines = max(math.sqrt(least / vectors_per_query), asked / HELD_TILES)
    lines = max(1, min(asked, math.ceil(lines)))
    columns = max(1, min(shards, math.ceil(least / lines)))
    return max(1, min(asked, max(lines, math.ceil(least / columns)))), columns


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, query_rows: int = 1024, shard_rows: int = 4096,
          fan_in: int = 32, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The ``k`` rows with the highest integer inner product for each query row: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the rows. Candidates are all rows of the same dimension but the query's own; ties
    go to the smaller key. Components become floor(scale * x).

    Vectors are packed into tiles where they lie, ``shard_rows`` to a tile, and stored; the query rows again into tiles of
    ``query_rows``. Each shard is copied to each group of query tiles and each query tile to each group of shards, so the product
    of one pair of tiles is one bounded task-local step whatever the size; it leaves ``k`` rows per query. ``blocks`` has the groups.
    Lists are merged as a tree: shards in groups of ``fan_in`` per query, until one group is left.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without a key. Rows that repeat a
    key are candidates of each other, and each query row has its own list. Scores beyond a long count as its limits.
    An empty table gives an empty one; fewer candidates than ``k`` give all.
    """
    values = quantised(col(vector), scale)
    sound = written(vectors.select(
        F.size(col(vector)).alias("dim"), F.monotonically_increasing_id().alias("row"), col(key).cast("bigint").alias("id"),
        values.alias("values"), F.coalesce(is_query, F.lit(False)).alias("query"),
    ).filter("values is not null and id is not null"), "vectors")
    shards = written(tiles(sound, shard_rows), "shards")
    asked = written(tiles(sound.filter("query"), query_rows), "queries")
    (n_shards, n_vectors), (n_asked, n_queries) = (
        table.agg(F.count("*"), F.sum(F.length("ids"))).first() for table in (shards, asked))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines, columns = blocks(n_shards, n_asked, (n_vectors or 1) / (n_queries or 1), BLOCKS_PER_PART * parts)

    places = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shards = shards.select(
        "dim", F.col("tile").alias("shard"), F.col("ids").alias("shard_ids"), F.col("data").alias("shard_data"),
        F.pmod(F.xxhash64("tile"), F.lit(columns)).cast("int").alias("column"), places(lines).alias("line"))
    asked = asked.select(
        "dim", F.col("ids").alias("query_ids"), F.col("data").alias("query_data"),
        F.pmod(F.xxhash64("tile"), F.lit(lines)).cast("int").alias("line"), places(columns).alias("column"))
    place = ["dim", "line", "column"]
    # The copies are many times what their tables' sizes tell the planner; a broadcast would collect them all on the driver.
    pairs = shards.repartition(parts, *place).join(asked.repartition(parts, *place).hint("merge"), place).select(
        "dim", "shard", "shard_ids", "shard_data", "query_ids", "query_data")
    lists = pairs.mapInArrow(
        lambda batches: _products(batches, k), "query_row bigint, query_id bigint, shard bigint, vec_id bigint, score bigint")
    groups = max(1, n_shards)
    while groups > fan_in:
        groups = math.ceil(groups / fan_in)
        lists = _merged(lists.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(groups))), k, ["query_row", "shard"]).drop("rank")
    return _merged(lists, k, ["query_row"]).select("query_id", "rank", "vec_id", "score")
