"""Benchmark decontamination by Wu-Manber multi-pattern search over words: shift tables, suffix buckets, direct comparison."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bundlelens.llm.common import ARROW, annotate, ascii_lower, carried, col, held, renamed, restored
from bundlelens.session import written

RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
FOUND = [("n_words", "bigint"), ("spans", "binary"), ("items", "array<string>")]
DECIDED = [("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string")]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
"""A byte table: word bytes with A-Z in lower case, everything else a blank."""
BLOCK_BYTES = 4 << 20
"""Benchmark text that one pass searches for."""
CHUNK = 512
"""Windows of an item that are kept together; an item of more is cut."""
TEXT_BYTES = 1 << 20
"""Text that is cut into words at a time."""
LANE = 64
"""Words per lane: lanes are searched side by side."""
PAIRS = 1 << 18
"""Candidates that are compared at a time."""
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)) * MULTIPLIER


class Class:
    """The Wu-Manber tables for windows of the same number of words.

    A block is two neighbouring words (one, for windows of one word). ``shift`` tells for the block at the end of the search
    position how many words can be skipped: the distance from the end of a window at which that block (or one with the same
    hash) occurs, or the most if it occurs in none. At 0 the windows of the suffix bucket with the same first block are compared.
    """

    def __init__(self, windows: np.ndarray):
        self.size = windows.shape[1]
        self.block = min(2, self.size)
        self.bits = max(8, int(len(windows) * self.size).bit_length() + 3)
        most = self.size - self.block + 1
        self.shift = np.full(1 << self.bits, most, np.int64)
        for end in range(self.block, self.size + 1):
            slots = self._slot(*self._words(windows, end))
            np.minimum.at(self.shift, slots, self.size - end)
        keys = self._key(windows)
        order = np.argsort(keys, kind="stable")
        self.windows, self.keys, self.order = windows[order], keys[order], order

    def _words(self, rows, end):
        return rows[:, end - self.block], rows[:, end - 1]

    def _slot(self, first, second):
        return (_mixed(first, second) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _key(self, rows):
        """The hash of the last block and of the first: bucket and prefix in one."""
        suffix, prefix = _mixed(*self._words(rows, self.size)), _mixed(rows[:, 0], rows[:, self.block - 1])
        return suffix ^ (prefix >> np.uint64(7))

    def search(self, words: np.ndarray):
        """Yields (places, windows): where which window begins in an array of word numbers."""
        last = len(words) - self.size
        if last < 0:
            return
        at = np.arange(0, last + 1, LANE)
        end = np.minimum(at + LANE, last + 1)
        candidates = []
        while len(at):
            tail = at + self.size
            skip = self.shift[self._slot(words[tail - self.block], words[tail - 1])]
            candidates.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            going = at < end
            at, end = at[going], end[going]
        places = np.concatenate(candidates)
        for i in range(0, len(places), PAIRS // 8):
            yield from self._compared(words, places[i:i + PAIRS // 8])

    def _compared(self, words, places):
        reach = np.arange(self.size)
        keys = self._key(words[places[:, None] + reach])
        low = np.searchsorted(self.keys, keys, "left")
        count = np.searchsorted(self.keys, keys, "right") - low
        places, low, count = places[count > 0], low[count > 0], count[count > 0]
        while len(places):  # a bucket of more than one window is walked one by one
            same = (words[places[:, None] + reach] == self.windows[low]).all(axis=1)
            if same.any():
                yield places[same], self.order[low[same]]
            low, count = low + 1, count - 1
            places, low, count = places[count > 0], low[count > 0], count[count > 0]


class Searcher:
    """Finds the windows of benchmark items in texts. ``chunks`` are (item, words of a run of its windows)."""

    def __init__(self, chunks, width: int):
        self.numbers: dict[bytes, int] = {}
        self.width = width
        by_size: dict[int, dict[bytes, set]] = {}
        for item, words in chunks:
            line = np.array([self.numbers.setdefault(w.encode(), len(self.numbers) + 1) for w in words], "<i4")
            size = min(width, len(line))
            for at in range(len(line) - size + 1):
                by_size.setdefault(size, {}).setdefault(line[at:at + size].tobytes(), set()).add(item)
        self.classes = []
        for size, windows in sorted(by_size.items()):
            rows = np.frombuffer(b"".join(windows), "<i4").reshape(-1, size)
            self.classes.append((Class(rows), [sorted(i for i in items if i is not None) for items in windows.values()]))

    def _numbered(self, text: str | None) -> np.ndarray:
        """The words of a text as numbers; 0 for a word that no item holds."""
        data, parts, at = (text or "").encode().translate(WORD_BYTES), [], 0
        known = self.numbers.get
        while at < len(data):
            cut = len(data) if len(data) - at <= TEXT_BYTES else data.rfind(b" ", at, at + TEXT_BYTES)
            if cut < at:  # one word of more than that
                cut = data.find(b" ", at + TEXT_BYTES)
                cut = len(data) if cut < 0 else cut
            words = data[at:cut].split()
            parts.append(np.fromiter((known(w, 0) for w in words), "<i4", len(words)))
            at = cut + 1
        return np.concatenate(parts) if parts else np.empty(0, "<i4")

    def find(self, texts) -> list[list]:
        """Per text: number of words, spans (begin, length) as packed pairs, names of items."""
        lines = [self._numbered(text) for text in texts]
        sizes = np.array([len(line) for line in lines], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        words = np.zeros(int((sizes + 1).sum()), "<i4")  # a 0 after each text: no window reaches across
        for begin, line in zip(begins, lines):
            words[begin:begin + len(line)] = line
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        for table, owners in self.classes:
            for places, windows in table.search(words):
                texts_at = np.searchsorted(begins, places, "right") - 1
                for text in np.unique(texts_at).tolist():
                    mine = texts_at == text
                    pairs = np.stack([places[mine] - begins[text], np.full(int(mine.sum()), table.size)], axis=1)
                    spans.setdefault(text, []).append(np.unique(pairs, axis=0))
                    items.setdefault(text, set()).update(*(owners[w] for w in np.unique(windows[mine]).tolist()))
        packed = [np.concatenate(spans[i]).astype("<i8").tobytes() if i in spans else b"" for i in range(len(texts))]
        return [sizes.tolist(), packed, [list(items.get(i, ())) for i in range(len(texts))]]


def runs_of(benchmark: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(item, words): each item's words in runs of ``CHUNK`` windows; the next run repeats the words its first window needs."""
    words = F.regexp_extract_all(ascii_lower(col(text)), F.lit(WORD), F.lit(0))
    items = benchmark.select(col(key).cast("string").alias("item"), F.explode(F.array(words)).alias("all")).filter("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (width - 1), F.lit(1)), F.lit(CHUNK))
    return items.select("item", F.explode(F.transform(starts, lambda at: F.slice("all", at, CHUNK + width - 1))).alias("words"))


def decide(spans: bytes, items) -> tuple[int, int, str]:
    """(words hit, number of items, digest of their sorted names) from packed spans and names with repeats."""
    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
    begins, ends = pairs[:, 0], pairs.sum(axis=1)
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order]) if len(order) else ends
    before = np.concatenate([[0], ends])[:len(ends)]
    names = sorted(set(items))
    return int((ends - np.maximum(begins, before)).clip(0).sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def _searched(texts: DataFrame, place: str, runs: list, width: int, carry) -> DataFrame:
    """Adds ``FOUND`` for one block of the benchmark, which every worker gets once."""
    shared, name = texts.sparkSession.sparkContext.broadcast(runs), uuid.uuid4().hex

    def make():
        return held(("benchmark", name), lambda: Searcher(shared.value, width)).find

    return annotate(texts, place, FOUND, make, carry)


def _decided(found: DataFrame, keep) -> DataFrame:
    """The carried columns (``k0``, …) with the results, decided per row from ``spans`` and ``items``."""
    schema = T.StructType([f for f in found.schema if f.name not in ("spans", "items")]
                          + [T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in DECIDED])

    def run(batches):
        for batch in batches:
            places = {name: i for i, name in enumerate(batch.schema.names)}
            rows = [decide(s, i) for s, i in zip(batch.column(places["spans"]).to_pylist(), batch.column(places["items"]).to_pylist())]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(places[f.name]) for f in schema if f.name in places]
                + [pa.array(values, ARROW[kind]) for values, (_, kind) in zip(columns, DECIDED)], names=schema.names)

    return found.mapInArrow(run, schema).select(
        *restored(keep), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item_text: str = "text",
                   item_key: str = "item_id", block_bytes: int = BLOCK_BYTES, carry=None) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` to every row of ``docs``.

    A-Z is lowered; words are runs of digits, letters and everything beyond ASCII. The windows of an item are its runs of ``width`` words; an item of fewer words
    is one window. ``n_hit`` counts the document's words inside any occurrence of a window, ``n_items`` the items whose windows
    occur, ``items_sha256`` is the digest of their names, sorted as strings and joined by commas.

    Windows of the same number of words share the tables of ``Class``. The benchmark is read in blocks of about ``block_bytes`` of
    text, which bounds what a worker holds and what is broadcast. One block needs one pass over the
    documents, without a shuffle. For a larger benchmark the texts are stored with a row number, each block is a pass that leaves the rows it
    finds something in, and those are joined by row.

    A null text has no words. Rows of the benchmark that repeat a key are one item; items without a key hit words but are not
    counted, items without words do nothing. An empty benchmark hits nothing, an empty table gives an empty one. Long
    texts are cut into words piece by piece and kept as numbers. Input columns named like a result give way to it.
    """
    spark, keep = docs.sparkSession, carried(docs, carry, RESULTS)
    texts, (place,) = renamed(docs, keep, text)
    columns = [f"k{i}" for i in range(len(keep))]
    runs = written(runs_of(benchmark, item_text, item_key, width), "benchmark_runs")
    total = runs.agg(F.sum(F.length(F.array_join("words", " ")))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    block_of = F.pmod(F.xxhash64("item", "words"), F.lit(count))
    block = lambda i: [(r["item"], r["words"]) for r in runs.filter(block_of == i).collect()]
    if count == 1:
        return _decided(_searched(texts, place, block(0), width, columns), keep)

    texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    hits = spark.createDataFrame([], "row bigint, spans binary, items array<string>")
    for i in range(count):
        found = written(_searched(texts, place, block(i), width, ["row"]), "found")
        hits = hits.union(found.filter("length(spans) > 0").select("row", "spans", "items"))
    joined = hits.groupBy("row").agg(
        F.aggregate(F.collect_list("spans"), F.lit(b""), lambda a, b: F.concat(a, b)).alias("spans"),
        F.flatten(F.collect_list("items")).alias("items")).withColumnRenamed("row", "_row")
    sizes = found.select(F.col("row").alias("_at"), "n_words")
    rows = texts.select("row", *columns).join(sizes, F.col("row") == F.col("_at")).join(joined, F.col("row") == F.col("_row"), "left")
    return _decided(rows.select(*columns, "n_words", F.coalesce("spans", F.lit(b"")).alias("spans"),
                                F.coalesce("items", F.array().cast("array<string>")).alias("items")), keep)
