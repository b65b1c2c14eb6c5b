import gzip
import io
import json
import tarfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bundlelens.functions import paths, timestamps
from bundlelens.operators import files
from bundlelens.plans.analysis import Request, analyze_bundles, analyze_lines, analyze_parquet, time_bounds
from bundlelens.sources import archives, logs, text
from tests.conftest import rows


@pytest.mark.parametrize("line, year, expected", [
    ("I1231 10:30:45.123456 x", 2023, datetime(2023, 12, 31, 10, 30)),
    ("E0229 10:30:45.1 x", 2024, datetime(2024, 2, 29, 10, 30)), ("W0229 10:30:45.1 x", 2023, None),
    ("F0101\t00:00:00 x", 2024, datetime(2024, 1, 1)), ("I1231 10:30", 2024, datetime(2024, 12, 31, 10, 30)),
    ("I1331 10:30:00 x", 2024, None), ("I0101 25:00:00 x", 2024, None), ("I0101", 2024, None), ("X0101 10:00:00 x", 2024, None),
    ("Error: 2024-01-01 10:00:00.1", 2024, None), ("Info", 2024, None),
    ("2023-12-31 10:30:45.123 x", 2024, datetime(2023, 12, 31, 10, 30, 45, 123000)),
    ("2023-12-31 10:30:45.5", 2024, datetime(2023, 12, 31, 10, 30, 45, 500000)),
    ("  2023-12-31   10:30:45.000001 x", 2024, datetime(2023, 12, 31, 10, 30, 45, 1)),
    ("2023-12-31 10:30:45 x", 2024, None), ("2023-12-31 10:30:45.1234567 x", 2024, None), ("2023-02-30 10:30:45.1 x", 2024, None),
    ("2023-12-31T10:30:45.1 x", 2024, None), ("", 2024, None), (" ", 2024, None), ("2023-1-2 3:4:5.6 x", 2024, datetime(2023, 1, 2, 3, 4, 5, 600000)),
])
def test_line_times(spark, line, year, expected):
    assert spark.range(1).select(timestamps.log_timestamp(F.lit(line), year)).first()[0] == expected


@pytest.mark.parametrize("path, node, kind, sub", [
    ("/b/yb-prod-x-n12/tserver/logs/yb-tserver.h.INFO.20240101", "yb-prod-x-n12", "yb-tserver", "INFO"),
    ("/b/yb-master-0_ns/x/yb-master.WARNING.log", "yb-master-0_ns", "yb-master", "WARN"),
    ("/b/east-node-3/postgresql-2024.log", "east-node-3", "postgres", "INFO"),
    ("/b/plain/controller.FATAL.log", "unknown", "yb-controller", "FATAL"),
    ("/b/plain/application.log", "unknown", "YBA", "INFO"), ("/b/plain/other.log", "unknown", "unknown", "unknown"),
    ("/b/east-node-3/yb-a-n1/master-tserver.ERROR.log", "yb-a-n1", "yb-tserver", "ERROR"),
    ("yb-a-n1/master.log", "unknown", "yb-master", "unknown"),
])
def test_facts_in_paths(spark, path, node, kind, sub):
    p = F.lit(path)
    assert tuple(spark.range(1).select(paths.node_name(p), paths.log_type(p), paths.sub_type(p)).first()) == (node, kind, sub)


def test_discovery(spark):
    check = lambda p, *a: spark.range(1).select(paths.is_log_file(F.lit(p), *a)).first()[0]
    assert check("/x/YB-TServer.LOG") and check("/x/master.log.gz") and check("/x/postgresql.log")
    assert not check("/log/tserver.txt") and not check("/x/controller.log") and check("/x/controller.log", ["controller"])


def parsed(spark, items, year=2024):
    return files.parse_lines(spark.createDataFrame(items, "file_path string, line_no bigint, line string").withColumn("line_block", F.floor(F.col("line_no") / 6)), year)


def file(path, *lines):
    return [(path, i, line) for i, line in enumerate(lines)]


def test_file_ranges(spark):
    a, b, c, d, e = (f"/x/yb-a-n1/{n}-tserver.INFO.log" for n in "abcde")
    items = (
        file(a, "junk", "I0105 10:00:00.1 x", "I0105 09:00:00.1 x", "junk")  # runs backwards
        + file(b, "I0105 10:00:00.1 x", *["junk"] * 21)  # a long undated end
        + file(c, "I0105 10:00:00.1 x", "I0106 10:00:00.1 y", *["junk"] * 19)
        + file(d, "I1231 23:00:00.1 x", "I0101 01:00:00.1 y")
        + file(e, "no", "times"))
    lines = parsed(spark, items)
    found = files.log_files(lines)
    got = {r.file_path[-18]: (r.start_time, r.end_time, r.lines, r.rejected) for r in found.collect()}
    assert got["a"][3] == "start after end" and got["e"][3] == "no time range"
    assert got["b"] == (datetime(2024, 1, 5, 10), datetime(2024, 1, 5, 10), 22, None)
    assert got["c"] == (datetime(2024, 1, 5, 10), datetime(2024, 1, 6, 10), 21, None)
    assert got["d"] == (datetime(2024, 12, 31, 23), datetime(2025, 1, 1, 1), 2, None)
    moved = rows(files.lines_of(lines, files.valid_files(found)).filter(F.col("file_path") == d), "line_no", "timestamp", "node_name")
    assert moved == [(0, datetime(2024, 12, 31, 23), "yb-a-n1"), (1, datetime(2025, 1, 1, 1), "yb-a-n1")]
    assert rows(files.bundle_counts(found)) == [(3, 1, 1)]
    assert rows(files.bundle_members(found)) == [("yb-a-n1", "yb-tserver")]
    assert rows(files.file_metadata(found), "logStartsAt")[0] == ("2024-01-05 10:00:00",)


def test_pruning_by_overlap(spark):
    day = "2024-01-01 "
    table = spark.createDataFrame(
        [(n, datetime(2024, 1, 1, s), datetime(2024, 1, 1, e), None) for n, s, e in (("a", 10, 12), ("b", 14, 16), ("c", 8, 9))],
        "file_path string, start_time timestamp_ntz, end_time timestamp_ntz, rejected string")
    assert rows(files.prune_files(table, day + "11:00:00", day + "15:00:00"), "file_path") == [("a",), ("b",)]
    assert rows(files.prune_files(table, day + "12:00:00", day + "12:00:00"), "file_path") == [("a",)]


def test_ranges_need_no_sort_of_the_lines(spark):
    lines = parsed(spark, file("/x/yb-a-n1/tserver.log", "I0105 10:00:00.1 x"))
    plan = files.log_files(lines)._jdf.queryExecution().executedPlan().toString()
    # Two hash aggregations; the only sort is over one row per block.
    assert "SortAggregate" not in plan and plan.count("HashAggregate(") == 4 and plan.count(" Sort ") <= 1


def test_a_time_filter_parses_each_line_once(spark):
    lines = parsed(spark, file("/x/yb-a-n1/tserver.log", "I0105 10:00:00.1 x")).filter("timestamp between '2024-01-01' and '2024-02-01'")
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1


def test_text_files(spark, tmp_path):
    node = tmp_path / "yb-a-n1"
    node.mkdir()
    body = b"I0101 10:00:00.1 one\r\nI0101 10:01:00.1 caf\xc3\xa9 \xff\xfetwo\nthree\n"
    (node / "yb-tserver.INFO.log").write_bytes(body)
    (node / "yb-master.log.gz").write_bytes(gzip.compress(body))
    (node / "notes.txt").write_bytes(body)
    big = "".join(f"I0102 10:00:00.1 {i}\n" for i in range(20000)).encode()
    (node / "big-tserver.log").write_bytes(big)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = text.read_log_lines(spark, str(tmp_path)).withColumn("name", paths.file_name(F.col("file_path"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_name = {}
    for r in sorted(got, key=lambda r: (r.line_block, r.line_no)):
        by_name.setdefault(r.name, []).append(r.line)
    assert sorted(by_name) == ["big-tserver.log", "yb-master.log.gz", "yb-tserver.INFO.log"]
    assert by_name["yb-tserver.INFO.log"] == by_name["yb-master.log.gz"] == ["I0101 10:00:00.1 one", "I0101 10:01:00.1 café two", "three"]
    assert by_name["big-tserver.log"] == big.decode().splitlines()  # in file order over many splits


def tar(members, mode="w:gz"):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode=mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return buffer.getvalue()


@pytest.fixture
def bundle_files(tmp_path):
    lines = lambda *ls: ("\n".join(ls) + "\n").encode()
    deep = tar([("yb-a-n2/yb-master.INFO.log", lines("I0105 10:00:00.1 Unable to pick leader", "I0301 10:00:00.1 Unable to pick leader"))])
    inner = tar([("yb-a-n1/yb-tserver.INFO.log.gz", gzip.compress(lines(
        "I0105 10:00:00.1 Soft memory limit exceeded", "I0105 10:00:30.1 soft memory LIMIT exceeded", "no time: Unable to pick leader"))),
        ("deep.tgz", deep), ("half.tar.gz", inner_half())])
    (tmp_path / "one.tar.gz").write_bytes(tar([("one/inner.tar.gz", inner), ("one/bad.tgz", b"nonsense"), ("one/readme.txt", b"x")]))
    (tmp_path / "two.tgz").write_bytes(tar([("yb-a-n1/postgresql.log", lines("2024-01-05 10:00:00.5 latch already owned by 7"))]))
    (tmp_path / "ignored.zip").write_bytes(b"x")
    return tmp_path


def inner_half():
    """An archive cut in the middle of its second member."""
    import os
    whole = tar([("yb-a-n3/yb-tserver.INFO.log", b"I0105 10:00:00.1 Long wait for safe op id\n"),
                 ("yb-a-n3/other-tserver.log", os.urandom(200_000))])
    return whole[: len(whole) // 2]


def test_archives(spark, bundle_files):
    result, rejects = analyze_bundles(spark, str(bundle_files), 2024, Request(datetime(2024, 1, 1), datetime(2024, 2, 1)))
    got = rows(result.stats, "support_bundle", "node_name", "log_type", "pattern_name", "count")
    assert got == [
        ("one", "yb-a-n1", "yb-tserver", "Soft memory limit exceeded", 2), ("one", "yb-a-n2", "yb-master", "Unable to pick leader", 1),
        ("one", "yb-a-n3", "yb-tserver", "Long wait for safe op id", 1),
        ("two", "yb-a-n1", "postgres", "latch already owned by", 1)]
    # The cut archive, its cut member, and the file that is no archive.
    assert rows(rejects, "bundle", "file_path") == [
        ("one", "/one/one/bad.tgz"), ("one", "/one/one/half.tar.gz"), ("one", "/one/one/yb-a-n3/other-tserver.log")]
    docs = {r.support_bundle: json.loads(r.json_report) for r in result.documents(whole=True).collect()}
    message = docs["one"]["nodes"]["yb-a-n1"]["yb-tserver"]["logMessages"]["Soft memory limit exceeded"]
    assert message["count"] == 2 and message["histogram"] == {"2024-01-05T10:00:00Z": 2}
    assert docs["two"]["analysis_config"]["start_time"] == "2024-01-01T00:00:00"


def test_archives_of_a_dataframe_agree(spark, bundle_files):
    streamed = archives.ingest_archives(spark, str(bundle_files))
    held = archives.explode_archives(spark.read.format("binaryFile").load(str(bundle_files)).filter("path rlike '(tar.gz|tgz)$'"))
    assert rows(archives.good_lines(streamed)) == rows(archives.good_lines(held))
    assert archives.archive_stem("s3://x/y/a.b.tar.gz") == "a.b" and archives.archive_stem("c.tgz") == "c"


def test_filters_of_a_request(spark):
    lines = spark.createDataFrame(
        [("b", f"/b/yb-a-n{n}/yb-tserver.log", i, f"I0105 10:00:0{i}.1 Unable to pick leader") for n in (1, 2) for i in range(3)]
        + [("b", "/b/yb-a-n1/postgresql.log", 0, "2024-01-05 10:00:00.1 latch already owned by")],
        "support_bundle string, file_path string, line_no bigint, line string").withColumn("line_block", F.lit(0))
    counts = lambda **k: rows(analyze_lines(lines, 2024, Request(**k)).stats, "node_name", "log_type", "pattern_name", "count")
    assert len(counts()) == 3
    assert counts(nodes=["YB-A-N2"]) == [("yb-a-n2", "yb-tserver", "Unable to pick leader", 3)]
    assert counts(log_types=["pg"]) == [("yb-a-n1", "postgres", "latch already owned by", 1)]
    assert counts(patterns=["pick", "own.d"], log_types=["pg"]) == [("yb-a-n1", "postgres", "custom_pattern_1", 1)]
    with pytest.raises(ValueError):
        Request(datetime(2024, 2, 1), datetime(2024, 1, 1))
    assert Request(nodes=["a"]).warnings()[0]["additional_details"] == "Chosen: node_filter: ['a']"
    backwards = lines.limit(0).unionByName(spark.createDataFrame(
        [("b", "/b/yb-a-n1/yb-tserver.log", i, f"I010{5 - i} 10:00:00.1 Unable to pick leader") for i in range(2)]
        + [("b", "/b/yb-a-n1/yb-master.log", 0, "no time at all")],
        "support_bundle string, file_path string, line_no bigint, line string").withColumn("line_block", F.lit(0)))
    result = analyze_lines(backwards, 2024)
    assert rows(result.rejected, "rejected") == [("no time range",), ("start after end",)]
    assert rows(result.stats, "node_name", "count") == [("yb-a-n1", 2)]
    assert time_bounds("0229 10:00", None, 2024, datetime(2024, 3, 1)) == (datetime(2024, 2, 29, 10), datetime(2024, 3, 1))
    assert time_bounds(None, "0301 00:00", 2024, datetime(2024, 3, 2))[0] == datetime(2024, 2, 1)


def test_parquet_analysis(spark, tmp_path):
    path = str(tmp_path / "parquet")
    start = datetime(2024, 1, 1, 10)
    table = spark.createDataFrame(
        [("b", "n1", "yb-tserver", start + timedelta(seconds=s), "Time spent Fsync log took a long time", 2.0, None) for s in range(90)]
        + [("b", None, "yb-tserver", start, "Unable to pick leader", None, None)],
        "support_bundle string, node_name string, log_type string, timestamp timestamp_ntz, message string, long_op_value double, timing_real_value double")
    table.write.parquet(path)
    result = analyze_parquet(spark, path)
    assert rows(result.stats, "pattern", "count") == [("Time spent Fsync log took a long time", 90)]
    assert rows(result.histogram, "minute", "count") == [("2024-01-01T10:00:00Z", 60), ("2024-01-01T10:01:00Z", 30)]
    assert rows(result.long_operations, "prefix", "c", "avg") == [("Fsync log", 90, 2.0)]
    doc = json.loads(result.documents(whole=True).first().json_report)
    assert doc["long_operations"]["Fsync log"] == {"2024-01-01 10:00:00": {"c": 90, "avg": 2.0, "max": 2.0}}
    assert rows(logs.bundle_name(table, path)) == [("b",)]
    assert rows(logs.bundle_name(table.limit(0), path)) == [("parquet",)]
    profile = logs.profile_files(spark, path).first()
    assert profile.file_count >= 1 and profile.total_size_bytes > 0 and profile.error is None
    assert logs.profile_files(spark, path, "*.none").first().error == "No Parquet files found"
    assert logs.first_files(spark, path).count() == min(10, profile.file_count)
    assert ("message", "string") in logs.table_columns(table)


def test_scan_reads_only_what_it_needs(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.createDataFrame([("n", "t", "m", datetime(2024, 1, 1), "b", 1)],
                          "node_name string, log_type string, message string, timestamp timestamp_ntz, support_bundle string, extra int").write.parquet(path)
    from bundlelens.operators import logstats, match
    from bundlelens.sources.catalog import load_patterns
    rows_ = logstats.filter_logs(logs.read_logs(spark, path), start=datetime(2024, 1, 1))
    plan = logstats.hit_stats(match.match_all(rows_, load_patterns()))._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "extra" not in scan and "support_bundle" not in scan
    assert "IsNotNull(node_name)" in scan and "GreaterThanOrEqual(timestamp" in scan
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
