import random
from datetime import datetime, timedelta

import pytest

from bundlelens.operators import flags
from tests.conftest import rows

SNAP = "support_bundle string, cluster_name string, organization string, timestamp timestamp_ntz"
FLAG = "support_bundle string, node_name string, server_type string, gflag string, value string"
DAY = datetime(2024, 1, 1)


def snaps(spark, *items, cluster="c"):
    return spark.createDataFrame([(b, cluster, "o", t) for b, t in items], SNAP)


def table(spark, values, node="n", role="tserver"):
    return spark.createDataFrame([(b, node, role, k, v) for b, kv in values.items() for k, v in kv.items()], FLAG)


def test_walk_from_newest(spark):
    s = snaps(spark, ("new", DAY + timedelta(days=1)), ("old", DAY))
    f = table(spark, {"new": {"a": "1", "b": "2"}, "old": {"b": "3", "c": "4"}})
    want = [("a", "removed", "1", None), ("b", "modified", "2", "3"), ("c", "added", None, "4")]
    assert rows(flags.flag_diff(f, flags.snapshot_steps(s)), "gflag", "change", "old_value", "new_value") == want
    assert rows(flags.flag_diff(f, flags.snapshot_steps(s)), "support_bundle", "prev_bundle", "step")[0] == ("old", "new", 1)
    mirrored = rows(flags.flag_diff(f, flags.snapshot_steps(s, "oldest_first")), "gflag", "change", "old_value", "new_value")
    swap = {"removed": "added", "added": "removed", "modified": "modified"}
    assert mirrored == sorted(((k, swap[c], n, o) for k, c, o, n in want), key=lambda t: t[0])


def test_snapshot_without_the_process(spark):
    s = snaps(spark, ("new", DAY + timedelta(days=1)), ("old", DAY))
    f = table(spark, {"new": {"a": "1"}}).union(table(spark, {"old": {"z": "0"}}, node="m"))
    payload = flags.ordered_steps(flags.diff_payload(f, flags.snapshot_steps(s))).collect()
    assert [(r.node_name, r.step, r.type, r.added, r.removed, r.gflags) for r in payload] == [
        ("m", 1, "diff", {"z": "0"}, {}, {"z": "0"}),
        ("n", 0, "initial", {}, {}, {"a": "1"}), ("n", 1, "diff", {}, {"a": "1"}, {})]
    history = flags.flag_history(f, flags.snapshot_steps(s))
    assert rows(flags.diff_summary(history, "node"), "node_name", "added", "removed", "modified") == [("m", 1, 0, 0), ("n", 0, 1, 0)]


def by_hand(snapshots, values, newest=True):
    """Walks each cluster's snapshots one after the other."""
    out = []
    for cluster in sorted({c for _, c, _ in snapshots}):
        walk = sorted((b, t) for b, c, t in snapshots if c == cluster)
        walk.sort(key=lambda x: x[1], reverse=True)
        if not newest:
            walk.reverse()
        for i, ((p, _), (b, _)) in enumerate(zip(walk, walk[1:]), 1):
            for key in {k for k in values if k[0] in (p, b)}:
                rest = key[1:]
                old, new = values.get((p, *rest)), values.get((b, *rest))
                if old != new:
                    kind = "added" if old is None else "removed" if new is None else "modified"
                    out.append((cluster, i, p, b, *rest, kind, old, new))
    return sorted(set(out), key=str)


@pytest.mark.parametrize("newest", [True, False])
def test_random_histories_with_one_hot_cluster(spark, newest):
    rng = random.Random(11)
    # Half of all snapshots belong to one cluster, many on one day and some at the same time.
    snapshots = [(f"b{i}", "hot" if i % 2 else f"c{i % 7}", DAY + timedelta(hours=int(rng.random() ** 3 * 2000))) for i in range(120)]
    values = {(b, f"n{n}", r, f"f{k}"): str(rng.randint(0, 2))
              for b, _, _ in snapshots for n in range(2) for r in ("master", "tserver") for k in range(4) if rng.random() < .6}
    s = spark.createDataFrame([(b, c, "o", t) for b, c, t in snapshots], SNAP)
    f = spark.createDataFrame([(*k, v) for k, v in values.items()], FLAG)
    got = flags.flag_diff(f, flags.snapshot_steps(s, "newest_first" if newest else "oldest_first")).select(
        "cluster_name", "step", "prev_bundle", "support_bundle", "node_name", "server_type", "gflag", "change", "old_value", "new_value")
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(snapshots, values, newest)


def test_look_back_window(spark):
    s = snaps(spark, ("a", DAY), ("b", DAY + timedelta(days=80)), ("c", DAY + timedelta(days=100)))
    names = lambda **k: [r[0] for r in rows(flags.snapshots_window(s, **k), "support_bundle")]
    assert names() == ["b", "c"]
    assert names(days=100) == ["a", "b", "c"]
    assert names(days=90, reference_bundle="b") == ["a", "b"]
    assert names(days=None) == ["a", "b", "c"]
    assert names(cluster="other") == []
    assert names(days=5, cluster="c", organization="o") == ["c"]


def test_flags_of_a_report(spark):
    f = table(spark, {"b1": {"x": "1"}}, node="n1").union(table(spark, {"b1": {"x": "2", "y": "3"}}, node="n2")).union(
        table(spark, {"b1": {"x": "9"}}, role="proxy"))
    reports = spark.createDataFrame([("r1", "b1"), ("r2", "none")], "id string, support_bundle_name string")
    got = flags.flag_maps(flags.report_flags(reports, f)).collect()
    assert {(r.id, r.server_type): r.gflags for r in got} == {("r1", "tserver"): {"x": "2", "y": "3"}, ("r1", "proxy"): {"x": "9"}}
    assert flags.report_flags(reports, flags.known_servers(f), per_node=True).count() == 3


def test_repeated_keys_can_be_reduced(spark):
    f = table(spark, {"b": {"x": "1"}})
    assert rows(flags.single_values(f.union(f).union(table(spark, {"b": {"x": "2"}}))), "gflag", "value") == [("x", "2")]


def test_values_are_compared_as_text(spark):
    s = snaps(spark, ("new", DAY + timedelta(days=1)), ("old", DAY))
    f = table(spark, {"new": {"a": None, "b": None}, "old": {"a": None, "b": "1"}})
    assert rows(flags.flag_diff(f, flags.snapshot_steps(s)), "gflag", "change") == [("b", "modified")]


def test_null_cluster_keeps_its_snapshots(spark):
    s = snaps(spark, ("new", DAY + timedelta(days=1)), ("old", DAY), cluster=None)
    assert flags.snapshots_window(s).count() == 2
    assert rows(flags.snapshot_steps(s), "step", "support_bundle", "prev_bundle") == [(0, "new", None), (1, "old", "new")]


def test_repeated_flags_give_one_row_a_step(spark):
    s = snaps(spark, ("new", DAY + timedelta(days=1)), ("old", DAY))
    f = table(spark, {"new": {"a": "1"}, "old": {"a": "1"}}).union(table(spark, {"new": {"a": "2"}, "old": {"a": "3"}}))
    history = flags.flag_history(f, flags.snapshot_steps(s))
    assert rows(history, "step", "change", "old_value", "new_value") == [(0, "initial", None, "2"), (1, "modified", "2", "3")]


def test_flag_without_a_value(spark):
    s = snaps(spark, ("new", DAY + timedelta(days=1)), ("old", DAY))
    f = table(spark, {"new": {"a": None, "b": None}, "old": {"a": None, "b": "1"}})
    history = flags.flag_history(f, flags.snapshot_steps(s)).filter("step = 1")
    assert rows(history, "gflag", "change") == [("a", "same"), ("b", "modified")]
