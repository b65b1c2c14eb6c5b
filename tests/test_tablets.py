import gzip
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bundlelens.functions import encodings
from bundlelens.operators import tablets
from bundlelens.plans.analysis import analyze_tablet_reports
from bundlelens.sources import store, tablet_reports
from bundlelens.sources.json_scan import entries_of
from tests.conftest import rows

SCHEMA = ("node_uuid string, tablet_uuid string, table_name string, table_uuid string, namespace string, status string, "
          "sst_size bigint, wal_size bigint, lease_status string")


@pytest.mark.parametrize("size, text", [
    (0, "0B"), (None, "0B"), (512, "512.0B"), (1536, "1.5KB"), (1024 ** 2, "1.0MB"), (1152, "1.12KB"), (1408, "1.38KB"),
    (-5, "-5.0B"), (1024 ** 6, "1.0EB"), (1023, "1023.0B"),
])
def test_sizes(spark, size, text):
    assert spark.range(1).select(encodings.format_bytes(F.lit(size).cast("bigint"))).first()[0] == text


def test_sizes_follow_python(spark):
    import math
    rng = random.Random(3)
    sizes = [int(1024 ** rng.uniform(0, 5.9)) for _ in range(500)]
    want = []
    for s in sizes:
        i = int(math.floor(math.log(s, 1024)))
        want.append(f"{round(s / 1024 ** i, 2)}{encodings.SIZE_UNITS[i]}")
    df = spark.createDataFrame([(s,) for s in sizes], "s bigint")
    assert [r[0] for r in df.select(encodings.format_bytes(F.col("s"))).collect()] == want


def test_encodings(spark):
    df = spark.createDataFrame([("AAE=",), ("",), (None,), ("%%",)], "t string")
    c = F.col("t")
    got = df.select(encodings.decode_uuid(c), encodings.decode_partition_key(c, "0000"), encodings.decode_partition_key(c, "ffff")).collect()
    assert [tuple(r) for r in got] == [
        ("0001", "0x0001", "0x0001"), (None, "0x0000", "0xffff"), (None, "0x0000", "0xffff"), ("%%", "0x0000", "0xffff")]
    ints = spark.createDataFrame([(" 12 ",), ("x",), (None,), ("1.5",)], "t string")
    assert [r[0] for r in ints.select(encodings.lenient_int(c)).collect()] == [12, 0, 0, 0]
    flags = spark.createDataFrame([("true",), ("1",), ("false",), (None,)], "t string")
    assert [r[0] for r in flags.select(encodings.yes_no(c)).collect()] == ["Yes", "Yes", "No", ""]
    assert spark.range(1).select(encodings.yes_no(F.lit(True))).first()[0] == "Yes"


def make(spark, *replicas):
    return spark.createDataFrame([(n, t, "tab", u, "ns", s, 10, 1, l) for n, t, u, s, l in replicas], SCHEMA)


def test_table_info(spark):
    df = make(spark, ("a", "t1", "u1", None, "HAS_LEASE"), ("a", "t2", "u2", "X", None), ("b", "t1", "", "X", "NO"), ("b", None, None, "X", "HAS_LEASE"))
    r = tablets.table_info(df).first()
    assert (r.table_uuid, r.tot_tablet_count, r.uniq_tablet_count, r.leader_tablets, r.node_tablet_min, r.node_tablet_max) == ("u2", 4, 3, 2, 2, 2)
    assert (r.sst_tot_bytes, r.wal_tot_bytes, r.sst_rf1_human, r.tot_human) == (40, 4, "30.0B", "44.0B")
    ordered = df.withColumn("pos", F.expr("if(table_uuid = 'u1', 2, 1)").cast("bigint"))
    assert tablets.table_info(ordered, file="node_uuid", pos="pos").first().table_uuid == "u1"


def zones_by_hand(replicas, servers):
    live = [(n, t) for n, t, s in replicas if s != "TABLET_DATA_TOMBSTONED"]
    everything = {t for _, t in live}
    out = {}
    for n, t in live:
        if n in servers:
            z = out.setdefault(servers[n], (set(), Counter()))
            z[0].add(n)
            z[1][t] += 1
    result = []
    for zone, (nodes, counts) in out.items():
        for k, n in Counter(counts.values()).items():
            result.append((*zone, len(nodes), len(everything - set(counts)), k, n, "YES" if len(set(counts.values())) <= 1 else "NO"))
    return sorted(result)


def test_zones_against_plain_python(spark):
    rng = random.Random(5)
    servers = {f"s{i}": (f"r{i % 2}", f"z{i % 3}") for i in range(6)}
    replicas = [(f"s{rng.randint(0, 7)}", f"t{int(rng.random() ** 3 * 40)}" if rng.random() < .97 else None,
                 rng.choice([None, "TABLET_DATA_READY", "TABLET_DATA_TOMBSTONED"])) for _ in range(400)]
    # A third of all replicas belong to one tablet on one server.
    replicas += [("s0", "t0", None)] * 200
    df = make(spark, *[(n, t, "u", s, None) for n, t, s in replicas])
    cluster = spark.createDataFrame([("TSERVER", u, r, z) for u, (r, z) in servers.items()], "type string, uuid string, region string, zone string")
    got = tablets.zone_replicas(df, cluster)
    # A null tablet is one tablet, as in a set.
    want = zones_by_hand(replicas, servers)
    assert sorted(tuple(r) for r in got.collect()) == want
    keyed = tablets.zone_replicas(df.withColumn("id", F.lit(1)), cluster.withColumn("id", F.lit(1)), ["id"]).drop("id")
    assert sorted(tuple(r) for r in keyed.collect()) == want
    width = tablets.max_replicas(got)
    assert width == max(r[4] for r in want)
    pivot = tablets.zone_pivot(got, width).collect()
    with pytest.raises(Exception, match="is beyond the"):
        tablets.zone_pivot(got, width - 1).collect()
    counts = {(r.region, r.zone, k, n) for r in tablets.zone_counts(got).collect() for k, n in r.replicas.items()}
    assert counts == {(r.region, r.zone, r.replica_count, r.tablets) for r in got.collect()}
    for r in pivot:
        held = sum(r[f"{i}_replicas"] for i in range(1, width + 1))
        assert held + r.missing_replicas == len({t for _, t, s in replicas if s != "TABLET_DATA_TOMBSTONED"})
    held = {t for n, t, s in replicas if n in servers and s != "TABLET_DATA_TOMBSTONED"}
    live = {t for _, t, s in replicas if s != "TABLET_DATA_TOMBSTONED"}
    few = cluster.filter("uuid = 's5'")
    on_s5 = {t for n, t, s in replicas if n == "s5" and s != "TABLET_DATA_TOMBSTONED"}
    assert {r[0] for r in tablets.missing_tablets(df, cluster).collect()} == live - held
    assert {r[0] for r in tablets.missing_tablets(df, few).collect()} == live - on_s5


def entry(i, **status):
    return {"tablet": {"tablet_status": {"tabletId": f"t{i}", "tableName": "tab", "tableId": "u", "namespaceName": "ns",
                                         "sstFilesDiskSize": str(i), "walFilesDiskSize": 2, **status}},
            "consensus_state": {"leaderLeaseStatus": "HAS_LEASE", "cstate": {"currentTerm": 4, "leaderUuid": "AAE=", "config": {"opidIndex": "9"}}}}


@pytest.fixture
def bundle_dir(tmp_path):
    for bundle in ("b1", "b2"):
        folder = tmp_path / bundle / "nested"
        folder.mkdir(parents=True)
        details = {"nodeDetailsSet": [
            {"nodeName": "a-n1", "nodeUuid": "1-1", "tserverRpcPort": 9100, "cloudInfo": {"private_ip": "10.0.0.1", "az": "z1", "region": "r"}},
            {"nodeName": "gone", "nodeUuid": "9-9", "cloudInfo": {"private_ip": "10.0.0.2", "az": "z2", "region": "r"}},
            {"nodeName": "a-n10", "nodeUuid": "2-2", "cloudInfo": {"private_ip": "10.0.0.2", "az": "z2", "region": "r"}},
            {"nodeName": "noip", "cloudInfo": {}}, {"nodeName": "a-n3", "cloudInfo": {"private_ip": "10.0.0.3"}}]}
        entities = {"tablets": [
            {"replicas": [{"addr": "10.0.0.1:9100", "server_uuid": "old"}, {"addr": "10.0.0.7:9100", "server_uuid": "x"}]},
            {"replicas": [{"addr": "10.0.0.1:9100", "server_uuid": "srv1"}]}, {}]}
        (folder / "my-universe-details.json").write_text(json.dumps(details, indent=1))
        (folder / "my-dump-entities.json").write_text(json.dumps(entities))
        doc = lambda *ids: json.dumps({"content": [entry(i) for i in ids]})
        (folder / "a-n1_tablet_report.json").write_text(doc(1, 2) + doc(3) + "\n" + doc(4) + "  " + doc() + doc(5) + "\n")
        with gzip.open(folder / "a-n10_tablet_report.json.gz", "wt") as f:
            f.write(doc(1) + '{"content": [' + doc(6))
        (folder / "stranger_tablet_report.json").write_text(doc(7))
    return tmp_path


def test_json_inputs(spark, bundle_dir):
    result = analyze_tablet_reports(spark, str(bundle_dir))
    servers = rows(result.cluster.filter("bundle = 'b1'"), "ip", "uuid", "port", "region", "zone", "node_name")
    assert servers == [("10.0.0.1", "srv1", 9100, "r", "z1", "a-n1"), ("10.0.0.2", "22", None, "r", "z2", "a-n10"),
                       ("10.0.0.3", "", None, None, None, "a-n3")]
    got = rows(result.tablets.filter("bundle = 'b2'"), "node_uuid", "tablet_uuid", "sst_size", "wal_size", "cterm", "cidx", "leader", "start_key", "end_key")
    tail = (2, 4, 9, "0001", "0x0000", "0xffff")
    assert got == [("22", "t1", 1, *tail)] + [("srv1", f"t{i}", i, *tail) for i in range(1, 6)]
    assert rows(result.rejects, "bundle", "file_name") == [
        (b, f) for b in ("b1", "b2") for f in ("a-n10_tablet_report.json.gz", "stranger_tablet_report.json")]
    assert rows(result.tableinfo, "bundle", "tot_tablet_count", "uniq_tablet_count", "node_tablet_min", "node_tablet_max") == [
        ("b1", 6, 5, 1, 5), ("b2", 6, 5, 1, 5)]
    assert rows(result.zones, "bundle", "zone", "tservers", "missing_replicas", "replica_count", "tablets", "balanced") == [
        ("b1", "z1", 1, 0, 1, 5, "YES"), ("b1", "z2", 1, 4, 1, 1, "YES"), ("b2", "z1", 1, 0, 1, 5, "YES"), ("b2", "z2", 1, 4, 1, 1, "YES")]


def test_back_to_back_documents():
    four = json.dumps({"content": [1]}) * 4
    assert [r[0] for r in entries_of([four.encode()])] == [0, 1, 2, 3]
    assert [r[3] for r in entries_of([b"[1]"])] == ["bad document: not an object"]
    assert list(entries_of([b"  "])) == list(entries_of([])) == []


def json_value(dice, depth):
    roll = dice.random()
    if depth > 3 or roll < .3:
        return dice.choice([1, -2.5, "a,b]}{\\\"", "é👍\n", "", None, True, "content", '"'])
    if roll < .6:
        return [json_value(dice, depth + 1) for _ in range(dice.randint(0, 3))]
    return {dice.choice(["content", "a", 'k"', "x]"]): json_value(dice, depth + 1) for _ in range(dice.randint(0, 3))}


def whole_text(text):
    """Entries by a decoder that has all of the text, and whether a document is bad."""
    decoder, at, number, out = json.JSONDecoder(), 0, 0, []
    while True:
        while at < len(text) and text[at] in " \t\n\r":
            at += 1
        if at >= len(text):
            return out, False
        try:
            document, at = decoder.raw_decode(text, at)
        except ValueError:
            return out, True
        if not isinstance(document, dict) or not isinstance(document.get("content", []), list):
            return out, True
        out += [(number, i, entry) for i, entry in enumerate(document.get("content", []))]
        number += 1


def test_scanner_against_a_decoder_of_whole_texts():
    dice = random.Random(1)
    for _ in range(3000):
        documents = []
        for _ in range(dice.randint(0, 3)):
            document = {"z": json_value(dice, 0)}
            if dice.random() < .8:
                document["content"] = [json_value(dice, 0) for _ in range(dice.randint(0, 4))] if dice.random() < .9 else json_value(dice, 0)
            documents.append(json.dumps(document | {"t": json_value(dice, 1)}, ensure_ascii=dice.random() < .5, indent=dice.choice([None, 1])))
        text = dice.choice(["", " ", "\n"]).join(documents)
        if dice.random() < .3 and text:
            at = dice.randrange(len(text))
            text = text[:at] + dice.choice(["", "]", "}", ",", '"', "x"]) + text[at + dice.randint(0, 1):]
        raw, size = text.encode(), dice.choice([1, 2, 3, 7, 50, 10_000])
        got = list(entries_of(raw[i:i + size] for i in range(0, len(raw), size)))
        bad = bool(got) and got[-1][3] is not None
        if bad and "twice" in got[-1][3]:
            continue
        entries = [g[:3] for g in got if g[3] is None and not (bad and g[0] == got[-1][0])]
        assert (entries, bad) == whole_text(text), (text, size)


def test_a_large_file_is_scanned_in_bounded_memory():
    import tracemalloc

    one = json.dumps(entry(1, note="x" * 300)).encode()
    def pieces():  # 400 MB in documents of 100 MB
        for _ in range(4):
            yield b'{"about": {"a": [1, 2]}, "content": ['
            yield from (b",".join([one] * 2000) + b"," for _ in range(90))
            yield one + b"]}"
    tracemalloc.start()
    count = sum(1 for _ in entries_of(pieces()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 4 * (90 * 2000 + 1) and peak < 20_000_000


def test_fields_are_text_or_json():
    def picked(entry):
        row = [None] * len(tablet_reports.FIELDS)
        tablet_reports._pick(entry, tablet_reports._TREE, row)
        return {name: value for name, value in zip(tablet_reports.FIELDS, row) if value is not None}
    status = {"tabletId": True, "tableName": 1.5, "sstFilesDiskSize": 2**70, "namespaceName": {"a": [1]}, "state": None, "walFilesDiskSize": "x",
              "partition": {"partitionKeyStart": "", "partitionKeyEnd": float("nan")}}
    assert picked({"tablet": {"tablet_status": status}, "consensus_state": {"cstate": [], "leaderLeaseStatus": -1}}) == {
        "tablet_uuid": "true", "table_name": "1.5", "sst_text": str(2**70), "namespace": '{"a": [1]}', "wal_text": "x", "start_text": "",
        "end_text": "NaN", "lease_status": "-1"}
    assert picked(None) == picked([1]) == picked({"tablet": 3}) == picked({"tablet": {"tablet_status": "x"}}) == {}


def test_entries_of_bad_documents_do_not_count(spark):
    text = json.dumps({"content": [entry(1)]}) + '{"content": [' + json.dumps(entry(2)) + ", nonsense]}" + json.dumps({"content": [entry(3)]})
    files = spark.createDataFrame([("b", "n1_x", text), ("b", "n1_y", None), ("b", "n1_z", "{}")], "bundle string, file_name string, text string")
    entries = tablet_reports.split_documents(files)
    servers = spark.createDataFrame([("b", "n1", "u1", 0)], "bundle string, node_name string, uuid string, pos int")
    assert rows(tablet_reports.tablets(entries, servers), "tablet_uuid", "sst_size", "wal_size", "cterm") == [("t1", 1, 2, 4)]
    assert rows(entries.filter("error is not null"), "file_name", "doc_no") == [("n1_x", 1)]


def test_tables_are_replaced_per_report(spark, tmp_path):
    root = str(tmp_path / "tables")
    one = make(spark, ("a", "t1", "u1", None, "HAS_LEASE"))
    cluster = spark.createDataFrame([("TSERVER", "a", "r", "z")], "type string, uuid string, region string, zone string")
    tables = lambda t: (cluster, t, tablets.table_info(t), tablets.zone_replicas(t, cluster))
    store.write_tablet_tables(root, "r1", *tables(one))
    store.write_tablet_tables(root, "r2", *tables(one))
    store.write_tablet_tables(root, "r1", *tables(one.union(one)))
    count = lambda name, r=None: store.read_tablet_table(spark, root, name, r).count()
    assert (count("tablets", "r1"), count("tablets", "r2"), count("cluster")) == (2, 1, 2)


def test_content_that_is_no_list_is_a_reject():
    good, bad = '{"content": [{"a": 1}]}', '{"content": null}'
    assert [(r[0], r[3]) for r in entries_of([(good + bad + good).encode()])] == [
        (0, None), (1, "bad document: content is no list")]
