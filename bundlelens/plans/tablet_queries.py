"""Queries over tablet tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bundlelens.adapters import with_views
from bundlelens.functions import encodings
from bundlelens.operators import tablets
from bundlelens.plans.registry import query
from bundlelens.session import shared_dir, shuffles_dropped, written
from bundlelens.sources import publish, store, tablet_reports

_TABLETS = with_views("ts_tablet", "ts_cluster")
_LIVE = _TABLETS + """, live AS (
    SELECT * FROM ts_tablet WHERE status IS DISTINCT FROM 'TABLET_DATA_TOMBSTONED'),
  zoned AS (SELECT c.region, c.zone, l.node_uuid, l.tablet_uuid FROM live l JOIN ts_cluster c ON c.uuid = l.node_uuid),
  per_tablet AS (SELECT region, zone, tablet_uuid, count(*) AS n FROM zoned GROUP BY ALL)"""


def _human(expr: str) -> str:
    """Size text: two decimals, ties to even."""
    return f"""CASE WHEN ({expr}) IS NULL OR ({expr}) = 0 THEN '0B' ELSE
      CAST(round_even(CAST(({expr}) AS DOUBLE) / pow(1024, CASE WHEN ({expr}) > 0 THEN floor(ln({expr}) / ln(1024)) ELSE 0 END), 2)
           AS VARCHAR) ||
      ['B','KB','MB','GB','TB','PB','EB','ZB','YB'][CAST(CASE WHEN ({expr}) > 0 THEN floor(ln({expr}) / ln(1024)) ELSE 0 END AS INT) + 1]
      END"""


@query("table_info", _TABLETS + f""", per_node AS (
      SELECT namespace, table_name, node_uuid, count(*) AS n FROM ts_tablet GROUP BY ALL),
    spread AS (SELECT namespace, table_name, min(n) AS lo, max(n) AS hi FROM per_node GROUP BY ALL),
    totals AS (SELECT namespace, table_name, arg_max(table_uuid, (node_uuid, tablet_uuid)) AS table_uuid, count(*) AS total,
      count(DISTINCT tablet_uuid) + max(CASE WHEN tablet_uuid IS NULL THEN 1 ELSE 0 END) AS uniq,
      count(*) FILTER (lease_status = 'HAS_LEASE') AS leaders,
      CAST(sum(coalesce(sst_size, 0)) AS BIGINT) AS sst, CAST(sum(coalesce(wal_size, 0)) AS BIGINT) AS wal
      FROM ts_tablet GROUP BY ALL)
    SELECT t.namespace, t.table_name AS tablename, t.table_uuid, total AS tot_tablet_count,
      CAST(uniq AS BIGINT) AS uniq_tablet_count, 0 AS uniq_tablets_estimate, leaders AS leader_tablets,
      lo AS node_tablet_min, hi AS node_tablet_max, 0 AS keys_per_tablet, 0 AS key_range_overlap, 0 AS unmatched_key_size,
      '' AS comment, sst AS sst_tot_bytes, wal AS wal_tot_bytes, {_human('sst')} AS sst_tot_human,
      {_human('wal')} AS wal_tot_human, {_human('sst * uniq / total')} AS sst_rf1_human, {_human('sst + wal')} AS tot_human
    FROM totals t JOIN spread s ON s.namespace = t.namespace AND s.table_name = t.table_name""")
def table_info(v):
    """A9, D13, P11, P15"""
    return tablets.table_info(v.ts_tablet())


@query("live_replicas", _LIVE + "SELECT node_uuid, tablet_uuid, status, sst_size, wal_size FROM live")
def live_replicas(v):
    """F10, D12"""
    return tablets.live_replicas(v.ts_tablet()).select("node_uuid", "tablet_uuid", "status", "sst_size", "wal_size")


@query("zoned_tablets", _LIVE + "SELECT region, zone, node_uuid, tablet_uuid FROM zoned")
def zoned_tablets(v):
    """J8"""
    return tablets.zoned_tablets(v.ts_tablet(), v.ts_cluster())


_ZONES = _LIVE + """,
  zone_totals AS (SELECT region, zone, count(*) AS held, count(DISTINCT n) AS kinds FROM per_tablet GROUP BY ALL),
  servers AS (SELECT region, zone, count(DISTINCT node_uuid) AS tservers FROM zoned GROUP BY ALL),
  zones AS (SELECT p.region, p.zone, tservers,
    (SELECT count(DISTINCT tablet_uuid) + max(CASE WHEN tablet_uuid IS NULL THEN 1 ELSE 0 END) FROM live) - held AS missing_replicas,
    n AS replica_count, count(*) AS tablets, CASE WHEN kinds <= 1 THEN 'YES' ELSE 'NO' END AS balanced
    FROM per_tablet p JOIN zone_totals z ON z.region = p.region AND z.zone = p.zone
    JOIN servers s ON s.region = p.region AND s.zone = p.zone
    GROUP BY p.region, p.zone, tservers, held, n, kinds)"""


@query("zone_replicas", _ZONES + "SELECT * FROM zones")
def zone_replicas(v):
    """A10, A11, J11, U5"""
    return tablets.zone_replicas(v.ts_tablet(), v.ts_cluster())


@query("zone_max_replicas", _ZONES + "SELECT max(replica_count) AS width FROM zones")
def zone_max_replicas(v):
    """A12"""
    zones = tablets.zone_replicas(v.ts_tablet(), v.ts_cluster())
    return zones.agg(F.coalesce(F.max("replica_count"), F.lit(1)).alias("width"))


@query("zone_pivot", _ZONES + """
    SELECT region, zone, tservers, missing_replicas,
      string_agg(replica_count || ':' || tablets, ',' ORDER BY replica_count) AS replicas, balanced
    FROM zones GROUP BY region, zone, tservers, missing_replicas, balanced""")
def zone_pivot(v):
    """A10 display form: per zone the tablets of every replica count"""
    zones = tablets.zone_counts(tablets.zone_replicas(v.ts_tablet(), v.ts_cluster()))
    shown = F.transform(F.array_sort(F.map_entries("replicas")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return zones.withColumn("replicas", F.array_join(shown, ","))


@query("missing_tablets", _LIVE + """
    SELECT DISTINCT tablet_uuid FROM live EXCEPT SELECT tablet_uuid FROM zoned WHERE region = 'ASIA'""")
def missing_tablets(v):
    """U5 by name, when only the servers of one region are listed"""
    return tablets.missing_tablets(v.ts_tablet(), v.ts_cluster().filter(F.col("region") == "ASIA"))


@query("size_texts", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_human('CAST(floor(l_extendedprice * 1000) AS BIGINT)')} AS size
    FROM lineitem""")
def size_texts(v):
    """P11 over every line"""
    size = F.floor(F.col("l_extendedprice") * 1000).cast("bigint")
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", encodings.format_bytes(size).alias("size"))


@query("decoded_keys", """
    WITH k AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN NULL
        ELSE base64(encode(c_name)) END AS b64, c_name FROM customer)
    SELECT c_custkey, CASE WHEN b64 IS NULL OR b64 = '' THEN NULL ELSE lower(hex(encode(c_name))) END AS uuid,
      '0x' || CASE WHEN b64 IS NULL OR b64 = '' THEN '0000' ELSE lower(hex(encode(c_name))) END AS start_key,
      '0x' || CASE WHEN b64 IS NULL OR b64 = '' THEN 'ffff' ELSE lower(hex(encode(c_name))) END AS end_key,
      CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey ELSE 0 END AS whole, replace(c_name, '#', '') AS stripped
    FROM k""")
def decoded_keys(v):
    """P12, P13, P14, P15"""
    key = F.col("c_custkey")
    b64 = F.when(key % 7 == 0, "").when(key % 11 == 0, F.lit(None)).otherwise(F.base64(F.encode("c_name", "utf-8")))
    number = F.when(F.col("c_mktsegment") == "BUILDING", key.cast("string")).otherwise(F.col("c_mktsegment"))
    return v.table("customer").withColumn("b64", b64).select(
        "c_custkey", encodings.decode_uuid(F.col("b64")).alias("uuid"),
        encodings.decode_partition_key(F.col("b64"), "0000").alias("start_key"),
        encodings.decode_partition_key(F.col("b64"), "ffff").alias("end_key"),
        encodings.lenient_int(number).alias("whole"),
        encodings.strip_dashes(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("stripped"))


# ---- the JSON inputs, built from the tables in pieces of bounded size ----------

_CHUNK = 100
_UNIVERSE = """WITH n AS (
    SELECT s_suppkey AS k, 'u' || (s_suppkey // 100) AS bundle,
      CASE WHEN s_suppkey % 100 <> 13 THEN '10.0.' || (s_suppkey // 100) || '.' || least(s_suppkey % 100, 97) END AS ip,
      r_name AS region, n_name AS zone
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  kept AS (SELECT * FROM n WHERE ip IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bundle, ip ORDER BY k DESC) = 1)"""


def _details(v):
    """Universe details of 100 nodes each, some without or with a repeated address."""
    key = F.col("s_suppkey")
    chunk, slot = F.floor(key / _CHUNK).cast("int"), key % _CHUNK
    address = F.when(slot != 13, F.concat(
        F.lit("10.0."), chunk.cast("string"), F.lit("."), F.least(slot, F.lit(97)).cast("string")))
    rows = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.struct(
        F.concat(F.lit("node-"), key.cast("string")).alias("nodeName"),
        F.concat(F.lit("id-"), key.cast("string")).alias("nodeUuid"), F.lit(9100).alias("tserverRpcPort"),
        F.struct(address.alias("private_ip"), F.col("n_name").alias("az"), F.col("r_name").alias("region")).alias("cloudInfo"),
    )
    return rows.groupBy(F.concat(F.lit("u"), chunk.cast("string")).alias("bundle")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), entry.alias("e")))), lambda x: x["e"])
        .alias("nodeDetailsSet"))


def _entities(v):
    """Entity dumps with one tablet of two replicas per node of every second slot."""
    key = F.col("s_suppkey")
    chunk, slot = F.floor(key / _CHUNK).cast("int"), key % _CHUNK
    addr = F.concat(F.lit("10.0."), chunk.cast("string"), F.lit("."), slot.cast("string"), F.lit(":9100"))
    replica = lambda tag: F.struct(
        addr.alias("addr"), F.concat(F.lit(tag), key.cast("string")).alias("server_uuid"))
    rows = v.table("supplier").filter(F.col("s_acctbal") >= 0)
    return rows.groupBy(F.concat(F.lit("u"), chunk.cast("string")).alias("bundle")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(
                key.alias("k"), F.struct(F.array(replica("old-"), replica("srv-")).alias("replicas")).alias("t")))),
            lambda x: x["t"]).alias("tablets"))


@query("tservers", _UNIVERSE + """
    SELECT kept.bundle, 'TSERVER' AS type, CASE WHEN s.s_suppkey IS NOT NULL THEN 'srv-' || s.s_suppkey ELSE 'id' || k END AS uuid,
      ip, 9100 AS port, region, zone, 'node-' || k AS node_name
    FROM kept LEFT JOIN supplier s ON s.s_acctbal >= 0 AND 'u' || (s.s_suppkey // 100) = kept.bundle
      AND '10.0.' || (s.s_suppkey // 100) || '.' || (s.s_suppkey % 100) = ip""")
def tservers(v):
    """S11, S12, J10, W4, P14, P21"""
    rows = tablet_reports.tservers(_details(v), _entities(v))
    return rows.select("bundle", "type", "uuid", "ip", "port", "region", "zone", "node_name")


def _report_files(v, by=("node_uuid", "piece")):
    """Tablet-report texts: per server and 1,000 tablet numbers, one of two documents back to back.

    Replicas are shuffled as columns, by ``by``; the JSON of a text is made where its replicas are.
    """
    part = F.substring("tablet_uuid", 2, 20).cast("bigint")
    fields = ("tablet_uuid", "table_name", "table_uuid", "namespace", "status", "sst_size", "wal_size", "lease_status")

    def entry(row):
        return F.to_json(F.struct(
            F.struct(F.struct(
                row["tablet_uuid"].alias("tabletId"), row["table_name"].alias("tableName"),
                row["table_uuid"].alias("tableId"), row["namespace"].alias("namespaceName"),
                row["status"].alias("tabletDataState"),
                F.struct(F.base64(F.encode(row["tablet_uuid"], "utf-8")).alias("partitionKeyStart")).alias("partition"),
                row["sst_size"].alias("sstFilesDiskSize"), row["wal_size"].cast("string").alias("walFilesDiskSize"),
            ).alias("tablet_status")).alias("tablet"),
            F.struct(
                row["lease_status"].alias("leaderLeaseStatus"),
                F.struct(F.lit(3).alias("currentTerm"), F.struct(F.lit("7").alias("opidIndex")).alias("config")).alias("cstate"),
            ).alias("consensus_state"),
        ))

    def document(half):
        rows = F.filter("rows", lambda row: row["half"].eqNullSafe(half))
        return F.when(F.size(rows) > 0, F.concat(
            F.lit('{"content": ['), F.array_join(F.transform(rows, entry), ", "), F.lit("]}")))

    pieces = v.ts_tablet().select(
        "node_uuid", F.floor(part / 1000).alias("piece"), F.struct((part % 2).alias("half"), *fields).alias("row"),
    ).repartition(*by).groupBy("node_uuid", "piece").agg(F.collect_list("row").alias("rows"))
    return pieces.select(
        F.lit("").alias("bundle"), "node_uuid",
        F.concat("node_uuid", F.lit("-"), F.col("piece").cast("string"), F.lit("_tablet_report.json")).alias("file_name"),
        F.concat_ws("\n", *[document(F.lit(half)) for half in (0, 1, None)]).alias("text"))


def _servers(v):
    return v.ts_cluster().select(F.lit("").alias("bundle"), F.col("uuid").alias("node_name"), "uuid", "pos")


@query("tablets_from_documents", _TABLETS + """
    SELECT node_uuid, tablet_uuid, table_name, table_uuid, namespace, CAST(NULL AS VARCHAR) AS state, status,
      '0x' || lower(hex(encode(tablet_uuid))) AS start_key, '0xffff' AS end_key, sst_size, wal_size, 3 AS cterm, 7 AS cidx,
      CAST(NULL AS VARCHAR) AS leader, lease_status FROM ts_tablet""")
def tablets_from_documents(v):
    """S13, M3, M4, J9, D5, D8, P12, P13, P15"""
    with shuffles_dropped(v.spark):
        entries = written(tablet_reports.split_documents(_report_files(v)), "entries")
    return tablet_reports.tablets(entries, _servers(v)).drop("bundle", "file_name", "pos")


@query("tablets_from_files", _TABLETS + """
    SELECT node_uuid, tablet_uuid, table_name, table_uuid, namespace, CAST(NULL AS VARCHAR) AS state, status,
      '0x' || lower(hex(encode(tablet_uuid))) AS start_key, '0xffff' AS end_key, sst_size, wal_size, 3 AS cterm, 7 AS cidx,
      CAST(NULL AS VARCHAR) AS leader, lease_status FROM ts_tablet""")
def tablets_from_files(v):
    """The same reports written as files and read as streams"""
    root = shared_dir(v.spark, "reports")
    # A server's texts lie in one task, so they are the lines of one file.
    files = _report_files(v, ["node_uuid"]).select(F.col("node_uuid").alias("node_name"), "text")
    with shuffles_dropped(v.spark):
        named = tablet_reports.write_report_files(files, root)
        if not named:
            files.write.partitionBy("node_name").option("compression", "gzip").text(root)
    entries = tablet_reports.scan_report_files(v.spark, root, tablet_reports.REPORTS_GLOB if named else "*")
    if not named:  # Spark names its files itself, so the folder stands for the report file.
        entries = entries.withColumns({
            "bundle": F.lit(""), "file_name": F.concat(F.regexp_replace("bundle", "^node_name=", ""), F.lit("_tablet_report.json"))})
    return tablet_reports.tablets(written(entries, "entries"), _servers(v)).drop("bundle", "file_name", "pos")


@query("saved_tablet_tables", _ZONES + """
    SELECT 'tablets' AS name, 'r1' AS report_id, count(*) AS n, CAST(sum(sst_size) AS BIGINT) AS total FROM ts_tablet
    UNION ALL SELECT 'cluster', 'r1', count(*), 0 FROM ts_cluster
    UNION ALL SELECT 'tableinfo', 'r1', count(*), CAST(sum(s) AS BIGINT) FROM (
      SELECT sum(sst_size) AS s FROM ts_tablet GROUP BY namespace, table_name)
    UNION ALL SELECT 'region_zone_tablets', 'r1', count(*), CAST(sum(tablets) AS BIGINT) FROM zones""")
def saved_tablet_tables(v):
    """Written twice for one report, read back"""
    root = shared_dir(v.spark, "tablet-tables")
    # Each table is computed once, whatever reads it.
    tablet, cluster = written(v.ts_tablet(), "tablet"), written(v.ts_cluster(), "cluster")
    tables = (cluster, tablet, written(tablets.table_info(tablet), "info"),
              written(tablets.zone_replicas(tablet, cluster), "zones"))
    for _ in range(2):
        store.write_tablet_tables(root, "r1", *tables)
    sums = {"cluster": F.lit(0), "tablets": F.sum("sst_size"), "tableinfo": F.sum("sst_tot_bytes"),
            "region_zone_tablets": F.sum("tablets")}
    parts = [
        store.read_tablet_table(v.spark, root, name, "r1").groupBy("report_id")
        .agg(F.count("*").alias("n"), total.cast("bigint").alias("total")).withColumn("name", F.lit(name))
        for name, total in sums.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


@query("published_reports", _ZONES + """
    SELECT report_id, name, count(*) AS n, CAST(sum(size) AS BIGINT) AS total FROM (
      SELECT 'r' || (length(table_name) % 3) AS report_id, 'tablets' AS name, sst_size AS size FROM ts_tablet WHERE namespace LIKE '%A%'
      UNION ALL SELECT 'r' || (length(table_name) % 3), 'tableinfo', s FROM (
        SELECT table_name, sum(sst_size) AS s FROM ts_tablet WHERE namespace LIKE '%A%' GROUP BY namespace, table_name))
    WHERE report_id <> 'r1' GROUP BY report_id, name""")
def published_reports(v):
    """Many reports by one commit; replaced, failed and withdrawn publications are not seen"""
    root = shared_dir(v.spark, "published")
    named = v.ts_tablet().withColumn("report_id", F.concat(F.lit("r"), (F.length("table_name") % 3).cast("string")))
    info = lambda rows: tablets.table_info(rows, ["report_id"])
    publish.publish(root, {"tablets": named, "tableinfo": info(named)})
    some = named.filter(F.col("namespace").contains("A"))
    publish.publish(root, {"tablets": some, "tableinfo": info(some)}, named.select("report_id"))
    named.limit(5).write.parquet(f"{root}/tablets/version=unfinished")
    publish.withdraw(v.spark, root, "r1")
    sums = {"tablets": "sst_size", "tableinfo": "sst_tot_bytes"}
    parts = [publish.read_published(v.spark, root, name).groupBy("report_id").agg(
        F.count("*").alias("n"), F.sum(size).cast("bigint").alias("total")).withColumn("name", F.lit(name)) for name, size in sums.items()]
    return parts[0].unionByName(parts[1])
