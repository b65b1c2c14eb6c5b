"""The three JSON inputs of a tablet report.

Files of many bundles are read together: ``bundle`` is the folder below the root
that a file lies in.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from itertools import groupby
from operator import itemgetter
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.functions.encodings import decode_partition_key, decode_uuid, lenient_int, strip_dashes
from bundlelens.functions.paths import file_name, host_of
from bundlelens.session import settings, written
from bundlelens.sources.json_scan import entries_of
from bundlelens.sources.listing import dealt
from bundlelens.sources.probe import located, open_file

DETAILS_GLOB = "*universe-details.json*"
ENTITIES_GLOB = "*dump-entities.json*"
REPORTS_GLOB = "*tablet_report.json*"

DETAILS_SCHEMA = (
    "nodeDetailsSet array<struct<nodeName: string, nodeUuid: string, tserverRpcPort: int, "
    "cloudInfo: struct<private_ip: string, az: string, region: string>>>"
)
ENTITIES_SCHEMA = "tablets array<struct<replicas: array<struct<addr: string, server_uuid: string>>>>"
_STATUS, _CONSENSUS = ("tablet", "tablet_status"), ("consensus_state",)
FIELDS = {
    "tablet_uuid": (*_STATUS, "tabletId"), "table_name": (*_STATUS, "tableName"), "table_uuid": (*_STATUS, "tableId"),
    "namespace": (*_STATUS, "namespaceName"), "state": (*_STATUS, "state"), "status": (*_STATUS, "tabletDataState"),
    "start_text": (*_STATUS, "partition", "partitionKeyStart"), "end_text": (*_STATUS, "partition", "partitionKeyEnd"),
    "sst_text": (*_STATUS, "sstFilesDiskSize"), "wal_text": (*_STATUS, "walFilesDiskSize"),
    "term_text": (*_CONSENSUS, "cstate", "currentTerm"), "index_text": (*_CONSENSUS, "cstate", "config", "opidIndex"),
    "leader_text": (*_CONSENSUS, "cstate", "leaderUuid"), "lease_status": (*_CONSENSUS, "leaderLeaseStatus"),
}
"""What is taken of a content entry, as text, and where it is."""
ENTRY_SCHEMA = "bundle string, file_name string, doc_no bigint, entry_no bigint, error string, " + ", ".join(f"{name} string" for name in FIELDS)
PIECE = 1 << 20
"""Bytes of a file that are read at a time."""
BATCH = 5_000
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
OPEN_COST = "spark.sql.files.openCostInBytes"


def _bundle_of(path: Column, root: str) -> Column:
    # Spark's readers spell a local path file:/… or file:///…, however the root was given.
    root = re.sub("^file:/+", "/", root).rstrip("/") + "/"
    below = F.substring_index(path, root, -1)
    return F.when(below.contains("/"), F.split_part(below, F.lit("/"), F.lit(1))).otherwise(F.lit(""))


def _read_json(spark: SparkSession, root: str, glob: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).json(root)
        .withColumn("bundle", _bundle_of(F.col("_metadata.file_path"), root))
    )


def read_details(spark: SparkSession, root: str, glob: str = DETAILS_GLOB) -> DataFrame:
    return _read_json(spark, root, glob, DETAILS_SCHEMA)


def read_entities(spark: SparkSession, root: str, glob: str = ENTITIES_GLOB) -> DataFrame:
    return _read_json(spark, root, glob, ENTITIES_SCHEMA)


def cluster_nodes(details: DataFrame) -> DataFrame:
    """One row per private ip; entries without one are skipped, the last one counts."""
    entries = details.select("bundle", F.posexplode("nodeDetailsSet").alias("pos", "n"))
    ip = F.nullif(F.col("n.cloudInfo.private_ip"), F.lit(""))
    return (
        entries.withColumn("ip", ip).filter(F.col("ip").isNotNull())
        .groupBy("bundle", "ip").agg(F.max_by("n", "pos").alias("n"), F.min("pos").alias("pos"))
        .select(
            "bundle", "pos", "ip", F.col("n.nodeName").alias("node_name"),
            strip_dashes(F.coalesce("n.nodeUuid", F.lit(""))).alias("node_uuid"),
            F.col("n.tserverRpcPort").alias("port"),
            F.col("n.cloudInfo.region").alias("region"), F.col("n.cloudInfo.az").alias("zone"),
        )
    )


def server_uuids(entities: DataFrame) -> DataFrame:
    """Server uuid per ip; the last replica listed counts."""
    return (
        entities.select("bundle", F.posexplode("tablets").alias("t", "tablet"))
        .select("bundle", "t", F.posexplode("tablet.replicas").alias("r", "replica"))
        .groupBy("bundle", host_of(F.col("replica.addr")).alias("ip"))
        .agg(F.max_by("replica.server_uuid", F.struct("t", "r")).alias("server_uuid"))
        .withColumn("listed", F.lit(True))
    )


def tservers(details: DataFrame, entities: DataFrame) -> DataFrame:
    """The ``cluster`` table, with the node name kept for the tablet reports."""
    joined = cluster_nodes(details).join(server_uuids(entities), ["bundle", "ip"], "left")
    return joined.select(
        "bundle", F.lit("TSERVER").alias("type"),
        F.when(F.col("listed"), F.col("server_uuid")).otherwise(F.col("node_uuid")).alias("uuid"),
        "ip", "port", "region", "zone", F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("interval day to second").alias("uptime"), "pos", "node_name",
    )


def _tree(paths) -> list:
    """Paths as nested lists of (name, place of the value or list below it), so that what they share is walked once."""
    below: dict = {}
    for place, path in paths:
        below.setdefault(path[0], []).append((place, path[1:]))
    return [(name, rest[0][0] if not rest[0][1] else _tree(rest)) for name, rest in below.items()]


_TREE = _tree(enumerate(FIELDS.values()))


def _pick(entry, tree: list, row: list) -> None:
    """Puts the values inside an entry into their places as text; other values than text as JSON."""
    if type(entry) is not dict:
        return
    for name, at in tree:
        value = entry.get(name)
        if value is None:
            continue
        if type(at) is list:
            _pick(value, at, row)
        else:
            row[at] = value if type(value) is str else str(value) if type(value) is int else json.dumps(value)


def _batches(files):
    """Arrow batches of the entries of files: (bundle, file name, pieces of bytes) each."""
    names = [part.split()[0] for part in ENTRY_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.string()] * (len(names) - 4)
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    rows, empty = [], [None] * len(FIELDS)
    for bundle, name, pieces in files:
        for number, at, entry, error in entries_of(pieces):
            row = empty.copy()
            _pick(entry, _TREE, row)
            rows.append((bundle, name, number, at, error, *row))
            if len(rows) == BATCH:
                yield made(rows)
                rows = []
    if rows:
        yield made(rows)


def split_documents(files: DataFrame) -> DataFrame:
    """Every ``content`` entry of files held in ``bundle``, ``file_name``, ``text``, its fields as columns.

    A file may hold several documents back to back; it is read up to its first
    bad one, which gives a row with an error.
    """
    def read(batches):
        def texts():
            for batch in batches:
                for i in range(batch.num_rows):
                    data = memoryview((batch.column(2)[i].as_py() or "").encode())
                    yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), (bytes(data[at:at + PIECE]) for at in range(0, len(data), PIECE))
        yield from _batches(texts())

    return files.select("bundle", "file_name", "text").mapInArrow(read, ENTRY_SCHEMA)


def _pieces(path: str):
    """The bytes of a file, unpacked, piece by piece."""
    with open_file(path) as file:
        packed = path.endswith(".gz")
        stream = pa.CompressedInputStream(file, "gzip") if packed else file
        while piece := stream.read(PIECE):
            yield piece


def _put(batches, root: str):
    """Writes the texts of each node, which come one after the other, as the lines of its file; one row with the number of files."""
    (store, place), count = located(root), 0

    def put(node, texts):
        if node and node[0] in "._":
            raise ValueError(f"Spark's readers skip files named like {node}")
        # Under its name once it is whole, so another try of a task replaces it by the same.
        packer, begun = zlib.compressobj(wbits=31), f"{place}/.{uuid.uuid4().hex}"
        with store.open_output_stream(begun, compression=None) as out:
            for text in texts:
                out.write(packer.compress((text or "").encode() + b"\n"))
            out.write(packer.flush())
        store.move(begun, f"{place}/{quote(node or '', safe='')}_tablet_report.json.gz")

    rows = ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for batch in batches for i in range(batch.num_rows))
    for node, texts in groupby(rows, itemgetter(0)):
        put(node, (text for _, text in texts))
        count += 1
    yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["files"])


def write_report_files(texts: DataFrame, root: str) -> bool:
    """Writes the texts (``node_name``, ``text``), all of a node in one task, to a packed report file per node in a fresh folder.

    Tasks write the files themselves, as Spark's writer takes a folder, a checksum and a move for each. False, and nothing is written, where
    Python has no client for the store.
    """
    spark = texts.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    try:
        store, place = located(folder)
        store.create_dir(place, recursive=True)
    except (OSError, ValueError, pa.ArrowException, NotImplementedError):
        return False
    ordered = texts.select("node_name", "text").sortWithinPartitions("node_name")
    ordered.mapInArrow(lambda batches: _put(batches, folder), "files bigint").agg(F.sum("files")).first()
    return True


def list_report_files(spark: SparkSession, root: str, glob: str = REPORTS_GLOB) -> DataFrame:
    """(bundle, file_name, path, length) of the tablet-report files; nothing is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    path = F.col("_metadata.file_path")
    return found.select(_bundle_of(path, root).alias("bundle"), file_name(path).alias("file_name"), "path", "length")


def scan_report_files(spark: SparkSession, root: str, glob: str = REPORTS_GLOB) -> DataFrame:
    """The rows of ``split_documents`` for all report files below a folder, each read as a stream by one task.

    A task holds a piece of a file and an entry, whatever the size of the file; files are dealt over tasks by their bytes. Where Python has no client
    for the store, Spark reads whole files instead. The list is made once and stored; its tasks follow the cores, not the folders and files.
    """
    with settings(spark, {LISTING_TASKS: str(16 * spark.sparkContext.defaultParallelism), OPEN_COST: "1k"}):
        files = written(list_report_files(spark, root, glob), "listing")
    first = files.select("path").first()
    if first is not None:
        try:
            open_file(first["path"]).close()
        except (OSError, ValueError, pa.ArrowException, NotImplementedError):
            return split_documents(read_report_files(spark, root, glob))

    def read(batches):
        yield from _batches((bundle, name, _pieces(path)) for batch in batches
                            for bundle, name, path in zip(*(column.to_pylist() for column in batch.columns)))

    return dealt(files).select("bundle", "file_name", "path").mapInArrow(read, ENTRY_SCHEMA)


def read_report_files(spark: SparkSession, root: str, glob: str = REPORTS_GLOB) -> DataFrame:
    """Tablet-report files, plain or gzip, one row each."""
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    )
    path = F.col("_metadata.file_path")
    return raw.select(_bundle_of(path, root).alias("bundle"), file_name(path).alias("file_name"), F.col("value").alias("text"))


def node_of_file(files: DataFrame, servers: DataFrame) -> DataFrame:
    """Server uuid of each file name: that of the longest node name it starts with.

    The prefixes of a file name as long as some node name are looked up by equality,
    which spares the comparison of all files with all nodes.
    """
    lengths = servers.agg(F.collect_set(F.length("node_name"))).scalar()
    prefixes = files.select("bundle", "file_name").distinct().select("bundle", "file_name", F.explode(lengths).alias("_n")).filter(
        F.col("_n") <= F.length("file_name")).select("bundle", "file_name", F.expr("substring(file_name, 1, _n)").alias("node_name"))
    named = servers.filter(F.length("node_name") > 0).select("bundle", "node_name", "uuid", "pos")
    return (
        prefixes.join(named, ["bundle", "node_name"]).groupBy("bundle", "file_name")
        .agg(F.max_by("uuid", F.struct(F.length("node_name"), "pos")).alias("node_uuid"))
        .filter(F.length("node_uuid") > 0)
    )


def unmatched_files(files: DataFrame, servers: DataFrame) -> DataFrame:
    """Files no node name fits: they are skipped."""
    return files.select("bundle", "file_name").join(node_of_file(files, servers), ["bundle", "file_name"], "left_anti")


def tablets(entries: DataFrame, servers: DataFrame) -> DataFrame:
    """The ``tablet`` table out of the entries of ``split_documents`` or ``scan_report_files``.

    Of a bad document no entry counts. The entries are used three times, so pass a stored table.
    They meet the server and the bad documents of their file in one join; files of one name may each have a bad one.
    """
    file = ["bundle", "file_name"]
    bad = entries.filter(F.col("error").isNotNull()).groupBy(*file).agg(F.collect_set("doc_no").alias("_bad"))
    files = node_of_file(entries, servers).join(bad, file, "left")
    good = entries.filter(F.col("error").isNull()).join(files, file).filter(
        F.col("_bad").isNull() | ~F.array_contains("_bad", F.col("doc_no")))
    return good.select(
        "bundle", "node_uuid", "tablet_uuid", "table_name", "table_uuid", "namespace", "state", "status",
        decode_partition_key(F.col("start_text"), "0000").alias("start_key"),
        decode_partition_key(F.col("end_text"), "ffff").alias("end_key"),
        lenient_int(F.col("sst_text")).alias("sst_size"),
        lenient_int(F.col("wal_text")).alias("wal_size"),
        F.col("term_text").try_cast("int").alias("cterm"),
        F.col("index_text").try_cast("int").alias("cidx"),
        decode_uuid(F.col("leader_text")).alias("leader"),
        "lease_status", "file_name", (F.col("doc_no") * 2**32 + F.col("entry_no")).alias("pos"),
    )
