"""Support-bundle archives (``.tar.gz``/``.tgz``, nested to any depth).

Archives are spread over the tasks; inside a task one archive is streamed member
by member and line by line, so memory does not grow with its size. A gzip stream
cannot be split: very large bundles should be written back as Parquet
(``ingest_archives(...).write.partitionBy("bundle")``) before further passes.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.functions.paths import DISCOVERED_SERVERS
from bundlelens.sources.listing import dealt

ARCHIVE_SUFFIXES = (".tar.gz", ".tgz")
LINES_SCHEMA = "bundle string, file_path string, line_no bigint, line string, error string"
BATCH_LINES = 20_000


def archive_stem(name: str) -> str:
    """File name without folder and archive suffix."""
    base = name.rsplit("/", 1)[-1]
    return base.removesuffix(".tar.gz").removesuffix(".tgz")


def _wanted(name: str, servers: Sequence[str] | None) -> bool:
    base = name.rsplit("/", 1)[-1].lower()
    return servers is None or ("log" in base and any(s in base for s in servers))


def archive_lines(stream, name: str, folder: str, servers: Sequence[str] | None) -> Iterator[tuple]:
    """(path, line number, line, error) of the log members of one archive stream.

    Members that are archives are read in place, as if unpacked into their own
    folder. What cannot be read to its end, a member or an archive, yields one
    row with an error after the lines before it, and the rest goes on.
    """
    try:
        with tarfile.open(fileobj=stream, mode="r|gz") as tar:
            for member in tar:
                path = f"{folder}/{member.name}"
                if not member.isfile():
                    continue
                if member.name.endswith(ARCHIVE_SUFFIXES):
                    yield from archive_lines(tar.extractfile(member), path, path.rsplit("/", 1)[0], servers)
                elif _wanted(member.name, servers):
                    yield from _member_lines(tar.extractfile(member), path)
    except (tarfile.TarError, OSError, EOFError, zlib.error) as exc:
        yield name, None, None, f"{type(exc).__name__}: {exc}"


class _Forward(io.RawIOBase):
    """A member of a streamed archive: it can only be read onwards."""

    def __init__(self, member):
        self.member = member

    def readable(self):
        return True

    def readinto(self, buffer):
        data = self.member.read(len(buffer))
        buffer[:len(data)] = data
        return len(data)


def _member_lines(member, path: str) -> Iterator[tuple]:
    try:
        data = io.BufferedReader(_Forward(member), 1 << 16)
        if path.endswith(".gz"):
            data = gzip.GzipFile(fileobj=data)
        for number, line in enumerate(io.TextIOWrapper(data, encoding="utf-8", errors="ignore")):
            yield path, number, line.rstrip("\n"), None
    except (OSError, EOFError, zlib.error, tarfile.TarError) as exc:
        yield path, None, None, f"{type(exc).__name__}: {exc}"


def _frames(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    columns = ["bundle", "file_path", "line_no", "line", "error"]

    def frame(batch):
        return pd.DataFrame(batch, columns=columns).astype({"line_no": "Int64"})

    batch: list[tuple] = []
    for row in rows:
        batch.append(row)
        if len(batch) == BATCH_LINES:
            yield frame(batch)
            batch = []
    if batch:
        yield frame(batch)


def explode_archives(archives: DataFrame, servers: Sequence[str] | None = DISCOVERED_SERVERS) -> DataFrame:
    """Lines of archives held in the columns ``path`` and ``content``."""
    def read(batches):
        def rows():
            for pdf in batches:
                for path, content in zip(pdf["path"], pdf["content"]):
                    bundle = archive_stem(path)
                    for row in archive_lines(io.BytesIO(content), path, f"/{bundle}", servers):
                        yield (bundle, *row)
        yield from _frames(rows())

    return archives.select("path", "content").mapInPandas(read, LINES_SCHEMA)


def ingest_archives(
    spark: SparkSession, path: str, servers: Sequence[str] | None = DISCOVERED_SERVERS
) -> DataFrame:
    """Lines of all archives below ``path``, streamed from the file system.

    Only names are listed by Spark; each archive is a task of its own, which opens it through the
    Arrow file system of its address, so they must lie where all executors can
    read them. Rows with ``error`` set are rejects.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    names = dealt(found.filter(F.col("path").rlike(r"\.(tar\.gz|tgz)$"))).select("path")

    def read(batches):
        from pyarrow import fs

        def rows():
            for pdf in batches:
                for address in pdf["path"]:
                    uri = address.replace("file:/", "file:///", 1) if not address.startswith("file://") else address
                    system, inner = fs.FileSystem.from_uri(uri)
                    bundle = archive_stem(address)
                    with system.open_input_stream(inner, compression=None) as stream:
                        for row in archive_lines(stream, address, f"/{bundle}", servers):
                            yield (bundle, *row)
        yield from _frames(rows())

    return names.mapInPandas(read, LINES_SCHEMA)


def good_lines(ingested: DataFrame) -> DataFrame:
    """The lines; every member is one block."""
    return ingested.filter(F.col("error").isNull()).drop("error").withColumn("line_block", F.lit(0).cast("bigint"))


def rejects(ingested: DataFrame) -> DataFrame:
    return ingested.filter(F.col("error").isNotNull()).select("bundle", "file_path", "error")
