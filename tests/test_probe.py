"""Ranges read at the ends of files against ranges from all lines."""

import gzip
import io
import random
from datetime import datetime

import pytest

from bundlelens.operators import files
from bundlelens.plans.analysis import Request, analyze_parquet, analyze_text
from bundlelens.sources import probe, text
from tests.conftest import rows

NOISE = ["", "   at some.Frame(File.java:12)", "I9999 10:10 no real date", "2024-13-01 00:00:00.1 neither", "x" * 300, "﻿odd", "é ÿ"]


def line(i):
    return random.choice([f"I01{1 + i // 60 % 28:02d} {i // 60 % 24:02d}:{i % 60:02d}:01.5 message {i}",
                          f"2024-01-{1 + i // 60 % 28} {i // 60 % 24}:{i % 60}:5.25 message {i}"])


@pytest.fixture
def folder(tmp_path):
    random.seed(11)
    made = {
        "a/yb-tserver.INFO.log.1": [line(i) for i in range(500)],
        "a/yb-tserver.WARNING.log.2": random.choices(NOISE, k=400) + [line(7)] + random.choices(NOISE, k=900),
        "b/yb-master.ERROR.log": random.choices(NOISE, k=50),
        "b/postgresql.log": ["I1231 23:59:01.1 late"] + random.choices(NOISE, k=30) + ["I0101 00:10:00.1 early"],
        "b/yb-master.INFO.log": [line(900), line(3)],
        "c/tserver empty.log": [],
        "c/tserver-one.log": ["x" * 5000 + "\n" + line(60)],
        "c/master-end.log": [line(61), "y" * 9000],
        "c/notes.txt": [line(5)],
    }
    for n in range(12):
        body = []
        for i in range(random.randint(0, 40)):
            body.append(random.choice([line(i), random.choice(NOISE)]))
        made[f"d/tserver-log-{n}"] = body
    for n, (name, lines) in enumerate(made.items()):
        path = tmp_path / "bundle" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        data = (("\n", "\r\n", "\r")[n % 3]).join(lines).encode()
        data = (b"\xef\xbb\xbf" if n % 4 == 1 else b"") + data.replace("é".encode(), b"\xe9") + (b"\n" if n % 2 else b"")
        path.write_bytes(data)
    (tmp_path / "bundle/a/tserver.log.gz").write_bytes(gzip.compress("\n".join(["junk", line(100), line(200), "junk"]).encode()))
    return str(tmp_path / "bundle")


@pytest.mark.parametrize("piece", [3, 64, 1 << 16])
def test_same_ranges_as_from_all_lines(spark, folder, piece):
    columns = ["file_path", "start_time", "end_time", "rolls_over", "rejected", "node_name", "log_type", "sub_type"]
    whole = files.log_files(files.parse_lines(text.read_log_lines(spark, folder), 2024))
    probed = probe.probe_files(spark, folder, 2024, piece=piece)
    found = rows(probed.filter("start_time is not null"), *columns)
    assert found == rows(whole.filter("start_time is not null"), *columns) and len(found) > 12
    # A file without any line is rejected here; lines alone don't show that it is there.
    assert {r[0] for r in rows(whole, "file_path")} <= {r[0] for r in rows(probed, "file_path")}
    assert {r["rejected"] for r in probed.filter("start_time is null").collect()} == {"no time range"}
    assert [r["file_path"].rsplit("/", 1)[1] for r in probed.filter("bytes_read is null").collect()] == ["tserver.log.gz"]


def test_long_files_are_hardly_read(spark, tmp_path):
    (tmp_path / "tserver.log").write_text("\n".join([line(0)] + ["filler of the file"] * 400_000 + [line(800)]))
    found = probe.probe_files(spark, str(tmp_path), 2024).first()
    assert found["length"] > 7_000_000 and found["bytes_read"] <= 2 * probe.PIECE and found["rejected"] is None


def test_pieces_and_line_ends():
    for size in range(1, 40):
        for data in (b"I0102 10:10 a\r\nI0103 10:10 b\r\n", b"x\rI0102 10:10 a\ryy\rI0103 10:10 b", b"I0102 10:10 a\n\n\nI0103 10:10 b\nzzz"):
            first, _ = probe.first_dated(io.BytesIO(data), len(data), 2024, size)
            last, _ = probe.last_dated(io.BytesIO(data), len(data), 2024, size)
            assert first.startswith("I0102") and last.startswith("I0103")
    assert probe.first_dated(io.BytesIO(b""), 0, 2024) == (None, 0) and probe.last_dated(io.BytesIO(b"x"), 1, 2024) == (None, 0)
    assert probe.dated("I0229 10:10", 2024) and not probe.dated("I0229 10:10", 2023) and not probe.dated("2024-01-01 10:10:10.1234567 x", 1)


def test_only_files_in_the_range_are_read(spark, tmp_path):
    logs = tmp_path / "bundle-x" / "yb-demo-n1"
    logs.mkdir(parents=True)
    (logs / "yb-tserver.INFO.log").write_text("I0105 10:00:00.1 UpdateReplica took a long time: 1.5s\nI0105 11:00:00.1 Soft memory limit exceeded (at 85%)\n")
    (logs / "yb-tserver.WARN.log").write_bytes(b"I0201 10:00:00.1 x\n" + b"\xff\xfe" * 100 + b"\nI0301 10:00:00.1 Soft memory limit exceeded\n")
    request = Request(start=datetime(2024, 1, 5, 10, 30), end=datetime(2024, 1, 6))
    found = analyze_text(spark, str(tmp_path / "bundle-x"), 2024, request)
    assert rows(found.stats, "support_bundle", "node_name", "log_type", "count") == [("bundle-x", "yb-demo-n1", "yb-tserver", 1)]
    everything = analyze_text(spark, str(tmp_path / "bundle-x"), 2024)
    assert everything.stats.agg({"count": "sum"}).first()[0] == 2
    opened = probe.read_files(spark, files.prune_files(
        probe.probe_files(spark, str(tmp_path / "bundle-x"), 2024), "2024-01-05 10:30:00", "2024-01-06 00:00:00"))
    assert [f.rsplit("/", 1)[1] for f in opened.inputFiles()] == ["yb-tserver.INFO.log"]
    none = analyze_text(spark, str(tmp_path / "bundle-x"), 2024, Request(start=datetime(2025, 1, 1), end=datetime(2025, 2, 1)))
    assert none.stats.count() == 0


def test_parquet_analysis_of_a_part(spark, tmp_path):
    kind = "timestamp timestamp_ntz, node_name string, log_type string, message string, support_bundle string, long_op_value double, timing_real_value double"
    at = datetime(2024, 1, 5)
    some = [(at.replace(hour=h), n, t, "Soft memory limit exceeded (at 85%)", "b", None, None)
            for h in range(4) for n in ("n1", "n2") for t in ("postgres", "yb-tserver")]
    spark.createDataFrame(some, kind).write.parquet(str(tmp_path / "logs"))
    count = lambda **chosen: analyze_parquet(spark, str(tmp_path / "logs"), request=Request(**chosen)).stats.agg({"count": "sum"}).first()[0]
    assert count() == 16 and count(nodes=["N1"]) == 8 and count(log_types=["pg"]) == 8
    assert count(start=at.replace(hour=1), end=at.replace(hour=2), nodes=["n2"], log_types=["ts"]) == 2
    assert count(patterns=["limit exceeded"]) == 16 and count(patterns=["no such text"]) is None
