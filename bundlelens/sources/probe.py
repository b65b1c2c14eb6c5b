"""Time ranges of log files by ranged reads of their ends.

A file's range needs its first and its last dated line only. Tasks read a piece at each end through the file system and go
on, doubling the piece, until a dated line is in it; so files outside a time range are never read. Files that can't
be read in ranges (gzip, stores without a client for Python) are read as streams by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.functions.paths import DISCOVERED_SERVERS, is_log_file
from bundlelens.functions.timestamps import is_short_form, log_timestamp
from bundlelens.operators.files import log_files, parse_lines, ranges_of
from bundlelens.sources.listing import dealt
from bundlelens.sources.text import read_log_lines

PIECE = 1 << 16
"""Bytes of the first piece read at each end."""
STAMP = re.compile(r"[IWEF](\d{2})(\d{2})\s+(\d{2}):(\d{2})|\s*(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})\.\d{1,6}(?=\s|\Z)", re.ASCII)
"""The two forms of a line's time, as in ``functions.timestamps``, with their numbers."""
LINE_END = re.compile(rb"\r\n|\r|\n")
FILES_PER_TASK = 64
MARK = b"\xef\xbb\xbf"
SCHEMA = "path string, file_path string, length bigint, first string, last string, bytes_read bigint, ranged boolean"


def dated(line: str, year: int) -> bool:
    """Whether a line starts with a real time."""
    m = STAMP.match(line)
    if not m:
        return False
    numbers = [int(n) for n in m.groups() if n is not None]
    if len(numbers) == 4:
        numbers = [year, *numbers]
    try:
        datetime(max(1, numbers[0]), *numbers[1:])
    except ValueError:
        return False
    return True


def _text(line: bytes) -> str:
    return line.decode("utf-8", "ignore").replace("�", "")


def located(path: str):
    """(file system, path in it); an error where Python has no client for its store."""
    scheme, _, rest = path.rpartition(":/") if "://" not in path else path.partition("://")
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if scheme else path
    host, _, inner = rest.partition("/")
    if scheme == "hdfs":
        return fs.FileSystem.from_uri(f"hdfs://{host}/")[0], "/" + inner
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{host}")[0], f"{host}/{inner}"


def open_file(path: str):
    """A file that can be read in ranges; an error where Python has no client for its store."""
    store, place = located(path)
    return store.open_input_file(place)


def first_dated(file, size: int, year: int, piece: int = PIECE) -> tuple[str | None, int]:
    """(the first dated line, where reading stopped)."""
    rest, at = b"", 0
    while True:
        file.seek(at)
        more = file.read(min(piece, size - at))
        data, ended = rest + (more if at else more.removeprefix(MARK)), at + len(more) >= size or not more
        at += len(more)
        lines = LINE_END.split(data)
        for line in lines if ended else lines[:-1]:
            if dated(text := _text(line), year):
                return text, at
        if ended:
            return None, at
        rest, piece = lines[-1], 2 * piece


def last_dated(file, size: int, year: int, piece: int = PIECE) -> tuple[str | None, int]:
    """(the last dated line, where reading backwards stopped)."""
    rest, at = b"", size
    while at > 0:
        start = max(0, at - piece)
        file.seek(start)
        data = file.read(at - start) + rest
        lines = LINE_END.split(data.removeprefix(MARK) if start == 0 else data)
        for line in reversed(lines if start == 0 else lines[1:]):
            if dated(text := _text(line), year):
                return text, start
        # The first line may begin before this piece; a line end may be cut in two, which leaves an empty line only.
        rest, at, piece = lines[0] if len(lines) == 1 else lines[0] + b"\n", start, 2 * piece
    return None, 0


def _probe(batches, year: int, piece: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, file_path, length in zip(*(column.to_pylist() for column in batch.columns)):
            found = (None, None, 0, False)
            if not path.endswith(".gz"):
                try:
                    with open_file(path) as file:
                        first, head = first_dated(file, length, year, piece)
                        last, tail = (None, length) if first is None else last_dated(file, length, year, piece)
                        found = (first, last, head + length - tail, True)
                except (OSError, ValueError, pa.ArrowException, NotImplementedError):
                    pass
            rows.append((path, file_path, length, *found))
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows), KINDS)] if rows else [pa.array([], k) for k in KINDS], names=NAMES)


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
KINDS = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[part.split()[1]] for part in SCHEMA.split(", ")]


def list_files(spark: SparkSession, paths: str | Sequence[str], servers=DISCOVERED_SERVERS) -> DataFrame:
    """Path (as given and as Spark's readers name it) and length of all log files below the paths; nothing is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    found = found.select("path", F.col("_metadata.file_path").alias("file_path"), "length")
    return found if servers is None else found.filter(is_log_file(F.col("file_path"), servers))


def probe_files(spark: SparkSession, paths: str | Sequence[str], reference_year: int, servers=DISCOVERED_SERVERS,
                piece: int = PIECE) -> DataFrame:
    """One row per log file: the rows of ``log_files`` without the number of lines, and the bytes that were read for it.

    ``bytes_read`` is null for files read as streams. The listing is dealt evenly over the tasks, whatever the sizes of the files.
    """
    files = list_files(spark, paths, servers)
    probed = dealt(files, FILES_PER_TASK).mapInArrow(lambda batches: _probe(batches, reference_year, piece), SCHEMA)
    start, end = (log_timestamp(F.col(c), reference_year) for c in ("first", "last"))
    rows = probed.select(
        "path", "file_path", "length", "bytes_read", "ranged", F.struct(
            start.alias("start_time"), is_short_form(F.col("first")).alias("_short"), end.alias("_last")).alias("span"))
    ranged = ranges_of(rows.filter("ranged").select("file_path", "length", "bytes_read", "span.*"), ["file_path", "length", "bytes_read"])
    streams = [row["path"] for row in rows.filter("not ranged").select("path").collect()]
    if not streams:
        return ranged
    lines = parse_lines(read_log_lines(spark, streams, servers=None), reference_year)
    lengths = files.select("file_path", "length", F.lit(None).cast("bigint").alias("bytes_read"))
    return ranged.unionByName(log_files(lines).drop("lines").join(lengths, "file_path"))


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The lines of the files in a table with ``file_path``, and of no other: their paths go to the reader."""
    paths = [row["file_path"] for row in files.select("file_path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "file_path string, line_block bigint, line_no bigint, line string")
    return read_log_lines(spark, paths, servers=None)
