"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import annotate, carried, col, placed, restored, with_texts
from bundlelens.llm.components import components
from bundlelens.session import written

RESULTS = ("fingerprint", "component_id", "kept")
SHINGLES_AT_ONCE = 1 << 16
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
"""A byte table: A-Z to a-z."""


def _hashes(text: str | None, words: int, seed: int):
    """The XXH64 of each shingle of a text, in arrays of bounded size.

    Words are what ASCII white space separates, A-Z in lower case. A shingle is ``words`` words joined by single spaces; a
    shorter text is one shingle, and a text without words has none.
    """
    parts = text.encode().translate(LOWER).split() if text else []
    if not parts:
        return
    line = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[min(words, len(parts)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends), SHINGLES_AT_ONCE):
        yield np.array([digest(line[a:b], seed) for a, b in zip(starts[at:at + SHINGLES_AT_ONCE], ends[at:at + SHINGLES_AT_ONCE])], "<u8")


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each of the 64 bits."""
    votes, byte_values = np.zeros(64, np.int64), hashes.view(np.uint8).reshape(-1, 8)
    for i in range(8):
        votes[8 * i:8 * i + 8] += np.bincount(byte_values[:, i], minlength=256) @ BITS_OF_BYTE
    return votes


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text, as a signed number.

    The hash of each shingle of ``words`` words votes on each bit, and more than half of the votes set it. No words: 0.
    """
    votes, total = np.zeros(64, np.int64), 0
    for hashes in _hashes(text, words, seed):
        votes += _votes(hashes)
        total += len(hashes)
    bits = np.packbits(2 * votes > total, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(words: int):
    return lambda: lambda texts: [[fingerprint(text, words) for text in texts]]


def _slices(column):
    """Population counts of the four 16-bit slices of a fingerprint."""
    return [F.bit_count(F.shiftrightunsigned(column, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]


def tiles(prints: DataFrame, rows: int) -> DataFrame:
    """Distinct fingerprints (``fp``) sorted by their population counts and packed ``rows`` to a tile.

    Columns: ``tile`` (its first fingerprint), ``low`` and ``high`` (smallest and largest population
    counts: of the whole, then of the slices) and ``data`` (the fingerprints, 8 bytes each).
    """
    counts = [F.bit_count("fp"), *_slices(F.col("fp"))]
    ordered = prints.select("fp", *[c.alias(f"n{i}") for i, c in enumerate(counts)])
    order = ["n0", "n1", "n2", "n3", "n4", "fp"]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches):
        held = []

        def tile(table):
            numbers = [table.column(i).to_numpy() for i in range(1, 6)]
            prints = table.column(0).to_numpy().astype("<i8")
            return pa.RecordBatch.from_arrays([
                pa.array([int(prints[0])], pa.int64()), pa.array([[int(n.min()) for n in numbers]], pa.list_(pa.int32())),
                pa.array([[int(n.max()) for n in numbers]], pa.list_(pa.int32())),
                pa.array([prints.tobytes()], pa.binary())], names=["tile", "low", "high", "data"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= rows:
                table = pa.Table.from_batches(held)
                yield tile(table.slice(0, rows))
                held = table.slice(rows).to_batches()
        if sum(b.num_rows for b in held):
            yield tile(pa.Table.from_batches(held))

    return ordered.mapInArrow(pack, "tile bigint, low array<int>, high array<int>, data binary")


def tile_pairs(packed: DataFrame, radius: int) -> DataFrame:
    """Pairs of tiles (``a`` <= ``b``) that may hold fingerprints within the radius.

    Tiles meet on a population count that both can reach; the counts of the slices then rule out
    pairs whose gaps add up to more than the radius.
    """
    near = F.sequence(F.greatest(F.lit(0), F.col("low")[0] - radius), F.col("high")[0] + radius)
    left = packed.select(F.col("tile").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"),
                         F.explode(near).alias("count"))
    right = packed.select(F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"),
                          F.explode(F.sequence(F.col("low")[0], F.col("high")[0])).alias("count"))
    gap = sum((F.greatest(F.lit(0), F.col("low_a")[i] - F.col("high_b")[i], F.col("low_b")[i] - F.col("high_a")[i])
               for i in range(1, 5)), F.lit(0))
    return left.join(right, "count").filter((F.col("a") <= F.col("b")) & (gap <= radius)).select("a", "b").distinct()


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the edges (left, right): (member, smallest member), without the roots."""
    nodes, index = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = index[:len(left)], index[len(left):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    members = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[members], nodes[root[members]]


def compare(a: bytes, b: bytes, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what lies within the radius across two tiles (or within one, given twice).

    All pairs are compared by exclusive-or and bit counts; a forest of the links comes back, so a dense
    group gives no more edges than it has members.
    """
    one, other = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    left, right = [], []
    for at in range(0, len(one), block):
        part = one[at:at + block]
        rest = other[at:] if a == b else other
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ rest[None, :]) <= radius)
        differ = part[i] != rest[j]
        if differ.any():
            member, root = _forest(part[i[differ]].view("<i8"), rest[j[differ]].view("<i8"))
            left.append(member)
            right.append(root)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _forest(np.concatenate(left), np.concatenate(right))


def links(prints: DataFrame, radius: int, rows: int = 2048) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect exactly those within the radius of each other."""
    packed = written(tiles(prints, rows), "tiles")
    pairs = tile_pairs(packed, radius)
    first = packed.select(F.col("tile").alias("a"), F.col("data").alias("data_a"))
    second = packed.select(F.col("tile").alias("b"), F.col("data").alias("data_b"))
    both = pairs.join(first, "a").join(second, "b").select("data_a", "data_b")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                u, v = compare(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return both.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, radius: int = 2, tile_rows: int = 2048, text: str = "text", key: str = "doc_id",
                    carry=None, words: int = 3) -> DataFrame:
    """Adds ``fingerprint`` (16 hex digits), ``component_id`` (the smallest key reachable) and ``kept`` to every row.

    Two rows are linked when their fingerprints (of shingles of ``words`` words) differ in ``radius`` bits or fewer; a
    component is what links connect. Copies share a fingerprint, so a group of copies is one node however large.
    Distinct fingerprints are sorted by population count into tiles, and tiles whose counts differ by
    more than the radius never meet. This is exact and quadratic in the number of distinct
    fingerprints, with a small factor; the tile table has one row per ``tile_rows`` of them. Fingerprints are stored with their
    place in the input, not with the text; if that is carried along, it is read again and joined by place.

    Null and empty texts, and texts without words, have fingerprint zero and are linked like any other. Rows
    that repeat a key share its component; a component without any key has a null id. One row of each component is
    kept: that of the smallest key, and of rows that repeat it the first. An empty table gives an empty one. Input
    columns named like a result give way to it.
    """
    keep = carried(docs, carry, RESULTS)
    base = placed(docs, **{f"k{i}": col(c) for i, c in enumerate(keep)}, id=col(key), text=col(text))
    others = [f"k{i}" for i, c in enumerate(keep) if c != text]
    prints = written(annotate(base, "text", [("fp", "bigint")], _fingerprints(words), [*others, "id", "_file", "_row"]), "fingerprints")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "_file", "_row")
    nodes = written(prints.groupBy("fp").agg(F.min(place).alias("first")), "nodes")
    found = components(links(nodes.select("fp"), radius, tile_rows))
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("_first"))
    classes = written(rooted.join(smallest, F.col("root") == F.col("_root")).select(
        F.col("fp").alias("_fp"), F.col("_first.id").alias("component_id"), F.col("_first._file").alias("first_file"),
        F.col("_first._row").alias("first_row")), "classes")
    first = (F.col("_row") == F.col("first_row")) & (F.col("_file") == F.col("first_file"))
    decided = prints.join(classes, F.col("fp") == F.col("_fp")).select(
        *others, "_file", "_row", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", first.alias("kept"))
    if text in keep:
        decided = with_texts(decided, base, f"k{keep.index(text)}")
    return decided.select(*restored(keep), *RESULTS)
