import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bundlelens.operators import reports, series
from bundlelens.sources import store
from tests.conftest import rows

REPORT = "id string, support_bundle_name string, created_at timestamp_ntz, json_report string"
HEADER = "support_bundle string, cluster_name string, cluster_uuid string, organization string, case_id bigint, timestamp timestamp_ntz"
DAY = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def catalogue(spark):
    """One organization and one cluster hold a third of all reports or more."""
    rng = random.Random(2)
    header, items = [], []
    for b in range(90):
        cluster = "hot" if b % 3 == 0 else f"c{b % 9}"
        org = "big" if b % 3 != 2 else f"o{b % 4}"
        header.append((f"b{b}", cluster.upper(), None if b % 13 == 0 else cluster, None if b % 17 == 0 else org, b if b % 5 else None, DAY))
    for i in range(400):
        items.append((f"r{i:03d}", f"b{rng.randint(0, 99)}", DAY + timedelta(minutes=rng.randint(0, 300)), "{}"))
    return items, header, spark.createDataFrame(items, REPORT), spark.createDataFrame(header, HEADER)


def test_related_against_plain_python(catalogue):
    items, header, r, h = catalogue
    head = {x[0]: x for x in header}
    joined = [(i, head[b][2], head[b][3], t) for i, b, t, _ in items if b in head]
    newest = lambda xs: [x[0] for x in sorted(xs, key=lambda x: (-x[3].timestamp(), x[0]))[:20]]
    got = {}
    for row in reports.related_reports(r, h).collect():
        got.setdefault((row.anchor_id, row.relation), set()).add(row.id)
    either = {}
    for row in reports.cluster_or_organization(r, h).collect():
        either.setdefault(row.anchor_id, set()).add(row.id)
    for i, cluster, org, _ in joined:
        same = newest([x for x in joined if cluster is not None and x[1] == cluster and x[0] != i])
        far = newest([x for x in joined if org is not None and x[2] == org and x[1] is not None and x[1] != (cluster or "None") and x[0] != i])
        assert got.get((i, "same_cluster"), set()) == set(same), i
        assert got.get((i, "same_org"), set()) == set(far), i
        both = newest([x for x in joined if x[0] != i and ((org is not None and x[2] == org) or (cluster is not None and x[1] == cluster))])
        assert either.get(i, set()) == set(both), i
    assert {k[0] for k in got} <= {j[0] for j in joined}


def test_related_of_one_report(spark, catalogue):
    _, _, r, h = catalogue
    one = r.filter("id = 'r007'").select("id")
    assert rows(reports.related_reports(r, h, one)) == rows(reports.related_reports(r, h).filter("anchor_id = 'r007'"))


def test_pages_make_up_the_list(catalogue):
    items, _, r, h = catalogue
    order = [i for i, *_ in sorted(items, key=lambda x: (-x[2].timestamp(), x[0]))]
    page = lambda n, q=None: [x.id for x in reports.list_reports(r, h, n, 30, q).collect()]
    assert sum((page(n) for n in range(1, 15)), []) == order
    assert page(99) == []
    assert rows(reports.page_count(r, h, 30)) == [(400, 14)]
    assert rows(reports.page_count(r, h, 30, "zzz")) == [(0, 1)]
    found = {x.id for x in reports.search_reports(r, h, "HOT").collect()}
    assert found and set(page(1, "hot")) <= found
    assert reports.search_reports(r, h, " ").count() == 0
    assert reports.find_report(r, "r001").count() == 1


def test_plan_of_a_page_and_of_top_lists(catalogue):
    _, _, r, h = catalogue
    assert "TakeOrderedAndProject" in reports.list_reports(r, h, 2, 10)._jdf.queryExecution().executedPlan().toString()
    plan = reports.related_reports(r, h)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 6  # each rank limit cuts before and after its shuffle
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_wildcards_and_empty_fields(spark):
    r = spark.createDataFrame([("a_b", "x", DAY, "{}"), ("ab", "y", DAY, "{}")], REPORT)
    h = spark.createDataFrame([("x", None, "u", None, 42, DAY)], HEADER)
    ids = lambda q: [x.id for x in reports.search_reports(r, h, q).collect()]
    assert ids("a_b") == ["a_b"] and sorted(ids("a%b")) == ["a_b", "ab"] and ids("42") == ["a_b"]
    listed = rows(reports.listing_row(reports.with_header(r, h)), "id", "universe_name", "organization_name", "case_id")
    assert listed == [("a_b", "", "", 42), ("ab", "", "", None)]


def test_document_fields_go_before_header_fields(spark):
    r = spark.createDataFrame([("1", "x", DAY, '{"organization": "own", "case_id": 7}'), ("2", "x", DAY, None), ("3", "none", DAY, "{}")], REPORT)
    h = spark.createDataFrame([("x", "cl", "u", "org", 42, DAY)], HEADER)
    got = rows(reports.augmented_reports(r, h), "id", "cluster_name", "universe_name", "organization", "organization_name", "case_id")
    assert got == [("1", "cl", "cl", "own", "org", "7"), ("2", "cl", "cl", "org", "org", "42"), ("3", None, None, None, None, None)]


def test_latest_and_nodes(spark):
    r = spark.createDataFrame([("1", "x", DAY, ""), ("2", "x", DAY, ""), ("0", "x", DAY + timedelta(1), ""), ("9", "y", DAY, "")], REPORT)
    assert rows(reports.latest_reports(r)) == [("x", "0"), ("y", "9")]
    inventory = spark.createDataFrame(
        [("y", "n1", "Live", True, None, "aws", "us", "a", 4, 1), ("y", "n2", "Live", False, True, "aws", None, "a", 4, None)],
        "support_bundle string, node_name string, state string, is_master boolean, is_tserver boolean, cloud string, region string,"
        "az string, num_cores int, mem_size_gb int").withColumn("volume_size_gb", F.lit(None).cast("decimal(18,2)"))
    got = rows(reports.node_table(reports.node_info(r, inventory)), "node_name", "is_master", "is_tserver", "placement", "mem_size_gb")
    assert got == [("n1", "Yes", "", "aws.us.a", 1.0), ("n2", "No", "Yes", None, None)]


STATS = "support_bundle string, node_name string, log_type string, pattern string, count bigint, start_time timestamp_ntz, end_time timestamp_ntz"
HIST = "support_bundle string, node_name string, log_type string, pattern string, minute string, count bigint"


def test_document_shape_and_parts(spark):
    stats = spark.createDataFrame([("b", "n1", "t", "p", 3, DAY, DAY), ("b", "n2", "t", "q", 1, DAY, DAY)], STATS).withColumn("solution", F.lit("s"))
    hist = spark.createDataFrame([("b", "n1", "t", "p", "2024-01-01T00:00:00Z", 2), ("b", "n1", "t", "p", "2024-01-01T00:01:00Z", 1),
                                  ("b", "n2", "t", "q", "2024-01-01T00:00:00Z", 1)], HIST)
    ops = spark.createDataFrame([("b", "Read", "2024-01-01 00:00:00", 1, 2.0, 3.0)], "support_bundle string, prefix string, bucket string, c bigint, avg double, max double")
    whole = reports.assemble_reports(stats, hist, ops, warnings=[{"message": "m", "level": "info", "type": "t"}], whole=True).collect()
    assert len(whole) == 1 and whole[0].part == ""
    doc = json.loads(whole[0].json_report)
    assert doc["support_bundle_name"] == "b"
    assert doc["nodes"]["n1"]["t"] == {"node": "n1", "logType": "t", "logMessages": {"p": {
        "StartTime": "2024-01-01T00:00:00Z", "EndTime": "2024-01-01T00:00:00Z", "count": 3,
        "histogram": {"2024-01-01T00:00:00Z": 2, "2024-01-01T00:01:00Z": 1}, "solution": "s"}}}
    assert doc["long_operations"] == {"Read": {"2024-01-01 00:00:00": {"c": 1, "avg": 2.0, "max": 3.0}}}
    assert doc["warnings"] == [{"message": "m", "level": "info", "type": "t"}]
    parts = reports.assemble_reports(stats, hist, ops)
    assert rows(parts, "part") == [("long operations/Read",), ("n1/t",), ("n2/t",)]
    assert rows(reports.report_to_rows(parts, ["support_bundle"])) == rows(hist)
    assert rows(reports.report_to_stats(parts, ["support_bundle"]).drop("solution")) == rows(stats.drop("solution"))
    from bundlelens.operators import longops
    assert rows(longops.stored_longops(parts, ["support_bundle"])) == rows(ops)


def test_empty_histograms_of_a_stored_report(spark):
    doc = {"nodes": {"n1": {"pg": {"node": "n1", "logType": "pg", "logMessages": {}},
                            "t": {"logMessages": {"p": {"StartTime": "bad", "EndTime": "2024-01-01T00:00:00Z", "count": 8598, "histogram": {}}}}}}}
    r = spark.createDataFrame([("1", "x", DAY, json.dumps(doc)), ("2", "x", DAY, "{}")], REPORT)
    assert reports.report_to_rows(r).count() == 0
    assert rows(reports.report_to_stats(r), "id", "count", "start_time", "solution") == [("1", 8598, None, None)]
    assert rows(series.latest_bucket(reports.report_to_rows(r))) == [(None,)]
    assert rows(reports.long_operations_of(r), "id", "long_operations") == [("1", "{}"), ("2", "{}")]


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    docs = spark.createDataFrame([("x", "{}"), ("y", "{}")], "support_bundle string, json_report string")
    store.append_reports(docs, root)
    store.append_reports(docs.limit(1), root)
    held = store.read_reports(spark, root)
    ids = [r.id for r in held.collect()]
    assert len(set(ids)) == 3 and held.filter("created_at is null").count() == 0
    assert store.delete_report(spark, root, "nobody") is False
    assert store.delete_report(spark, root, ids[0]) is True
    assert store.delete_report(spark, root, ids[0]) is False
    assert {r.id for r in store.read_reports(spark, root).collect()} == set(ids[1:])
    store.compact_reports(spark, root, str(tmp_path / "new"))
    assert {r.id for r in store.read_reports(spark, str(tmp_path / "new")).collect()} == set(ids[1:])


def test_saved_rows_have_iso_times(spark, tmp_path):
    store.save_rows(spark.createDataFrame([(1, DAY)], "a int, t timestamp_ntz"), str(tmp_path / "deep" / "er"))
    assert spark.read.json(str(tmp_path / "deep" / "er")).first().t == "2024-01-01T00:00:00Z"
