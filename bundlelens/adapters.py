"""Views over the driver's tables in the shapes the operators expect.

``Views(spark, sf_dir)`` builds them as DataFrames. ``SQL`` holds the same views
as DuckDB text, written independently, for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MESSAGES = (
    "Soft memory limit exceeded (at 85%)",
    "UpdateReplica took a long time: 1.5s",
    "Log callback took a long time",
    "Time spent sync call for /path: real 1.0s",
    "Time spent Fsync log took a long time",
    "Stopping writes because we have 2 immutable memtables",
    "running LogGCOp(fab8633b) took a long time",
    "VoteRequest to p1 timed out, VoteRequest Connection reset by peer",
    "FAIL OF LEADER p1 DETECTED",
    " ",
    "Read took a long",
    "nothing of interest",
)
REFERENCE_YEAR = 2024


def _text(column, prefix: str = ""):
    return F.concat(F.lit(prefix), F.col(column).cast("string")) if isinstance(column, str) else F.concat(
        F.lit(prefix), column.cast("string"))


class Views:
    """DataFrames over ``<sf_dir>/<table>.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def log_events(self) -> DataFrame:
        event, user = F.col("event_id"), F.col("user_id")
        message = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (event % len(MESSAGES) + 1).cast("int"))
        return self.table("events").select(
            "event_id", F.col("ts").alias("timestamp"),
            F.when(event % 97 != 0, _text(user % 7, "n")).alias("node_name"),
            F.when(F.col("event_type") == "purchase", "postgres").when(F.col("event_type") == "signup", "yb-master")
            .otherwise("yb-tserver").alias("log_type"),
            _text(user % 20, "bundle-").alias("support_bundle"),
            F.when(event % 3 == 0, F.col("value")).alias("long_op_value"),
            F.when(event % 3 == 1, F.col("value") / 10).alias("timing_real_value"),
            message.alias("message"),
        )

    def loose_events(self) -> DataFrame:
        """``log_events``, some of them without a bundle."""
        return self.log_events().withColumn("support_bundle", F.when(F.col("event_id") % 89 != 0, F.col("support_bundle")))

    def documents(self) -> DataFrame:
        """Prose as messages: whole texts, nodes by source, log types by language."""
        return self.table("documents").select(
            "doc_id", F.col("text").alias("message"), F.col("source").alias("node_name"), F.col("lang").alias("log_type"),
        )

    def numbered_lines(self) -> DataFrame:
        """``log_lines`` as a text reader gives them: a file's days are its blocks."""
        lines = self.log_lines().join(
            self.table("events").select("event_id", F.to_date("ts").alias("_day")), "event_id")
        block = F.unix_date("_day").cast("bigint")
        in_block = Window.partitionBy("file_path", "line_block").orderBy("event_id")
        return lines.withColumn("line_block", block).withColumn(
            "line_no", F.row_number().over(in_block).cast("bigint")).drop("_day")

    def log_lines(self) -> DataFrame:
        """The messages as raw text lines, one file per (bundle, node, log type)."""
        e = self.log_events()
        pg = F.col("log_type") == "postgres"
        ts = F.col("timestamp")
        name = F.when(pg, "postgresql.log").when(F.col("log_type") == "yb-master", "yb-master.WARNING.log").otherwise(
            "yb-tserver.ERROR.log.1")
        folder = F.coalesce(F.concat(F.lit("yb-demo-"), "node_name"), F.lit("stray"))
        iso = F.concat(F.replace(F.substring(ts.cast("string"), 1, 19), F.lit("T"), F.lit(" ")), F.lit("."),
                       F.date_format(ts, "SSSSSS"))
        return e.select(
            "event_id", "support_bundle",
            F.concat_ws("/", F.lit(""), "support_bundle", folder, name).alias("file_path"),
            F.when(pg, F.concat(iso, F.lit(" "), "message")).otherwise(
                F.concat(F.lit("I"), F.date_format(ts, "MMdd HH:mm:ss.SSSSSS"), F.lit(" "), "message")).alias("line"),
        )

    def ts_cluster(self) -> DataFrame:
        places = self.table("supplier").join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        ).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return places.select(
            F.lit("TSERVER").alias("type"), _text("s_suppkey", "s").alias("uuid"),
            F.col("r_name").alias("region"), F.col("n_name").alias("zone"), F.col("s_suppkey").alias("pos"),
        )

    def ts_tablet(self) -> DataFrame:
        # Brand and type follow from the part; flags are single letters, compared as
        # numbers so that the aggregation can hash.
        rows = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        return rows.groupBy("l_suppkey", "l_partkey", F.col("p_brand").alias("table_name"), F.col("p_type").alias("namespace")).agg(
            F.char(F.min(F.ascii("l_returnflag"))).alias("_flag"), F.char(F.min(F.ascii("l_linestatus"))).alias("_line"),
            F.floor(F.max("l_extendedprice") * 1000).cast("bigint").alias("sst_size"),
            F.floor(F.max("l_quantity")).cast("bigint").alias("wal_size"),
        ).select(
            _text("l_suppkey", "s").alias("node_uuid"), _text("l_partkey", "t").alias("tablet_uuid"),
            "table_name", F.concat(F.lit("u-"), "table_name").alias("table_uuid"), "namespace",
            F.when(F.col("l_partkey") % 50 == 0, F.lit(None)).when(F.col("_flag") == "R", "TABLET_DATA_TOMBSTONED")
            .otherwise("TABLET_DATA_READY").alias("status"),
            "sst_size", "wal_size",
            F.when(F.col("_line") == "O", "HAS_LEASE").otherwise("NO_LEASE").alias("lease_status"),
        )

    def reports(self) -> DataFrame:
        bundle = F.concat(F.lit("bundle-"), _text("o_custkey"), F.lit("-"), _text(F.col("o_orderkey") % 3))
        return self.table("orders").select(
            _text("o_orderkey").alias("id"), bundle.alias("support_bundle_name"), F.col("o_orderdate").alias("created_at"),
            F.when(
                F.col("o_orderstatus") == "F",
                F.to_json(F.struct(F.col("o_orderpriority").alias("organization"))),
            ).otherwise("{}").alias("json_report"),
        )

    def bundle_header(self) -> DataFrame:
        """Headers; bundles of customers in debt have none."""
        rows = self.table("orders").join(
            self.table("customer").filter(F.col("c_acctbal") >= 0), F.col("o_custkey") == F.col("c_custkey")
        ).join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.groupBy(
            "o_custkey", (F.col("o_orderkey") % 3).alias("_part"), F.col("c_name").alias("cluster_name"),
            F.col("n_name").alias("organization"),
        ).agg(F.max("o_orderdate").alias("timestamp")).select(
            F.concat(F.lit("bundle-"), _text("o_custkey"), F.lit("-"), _text("_part")).alias("support_bundle"),
            "cluster_name", _text("o_custkey", "c").alias("cluster_uuid"), "organization",
            F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("case_id"), "timestamp",
        )

    def snapshots(self) -> DataFrame:
        rows = self.table("orders").join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey")
        ).join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.select(
            _text("o_orderkey", "o").alias("support_bundle"), F.col("c_name").alias("cluster_name"),
            F.col("n_name").alias("organization"), F.col("o_orderdate").alias("timestamp"),
        )

    def bundle_flags(self) -> DataFrame:
        return self.table("lineitem").groupBy(
            "l_orderkey", (F.col("l_linenumber") % 3).alias("_node"), "l_linestatus", (F.col("l_partkey") % 8).alias("_flag")
        ).agg(F.min("l_quantity").cast("bigint").cast("string").alias("value")).select(
            _text("l_orderkey", "o").alias("support_bundle"), _text("_node", "n").alias("node_name"),
            F.when(F.col("l_linestatus") == "O", "tserver").otherwise("master").alias("server_type"),
            _text("_flag", "flag_").alias("gflag"), "value",
        )

    def flag_reports(self) -> DataFrame:
        """Reports about the bundles of ``bundle_flags``."""
        return self.table("orders").select(
            _text("o_orderkey").alias("id"), _text("o_orderkey", "o").alias("support_bundle_name"),
            F.col("o_orderdate").alias("created_at"),
        )

    def node_inventory(self) -> DataFrame:
        key = F.col("s_suppkey")
        places = self.table("supplier").join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        ).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return places.select(
            F.concat(F.lit("bundle-"), _text(key), F.lit("-"), _text(key % 3)).alias("support_bundle"),
            F.col("s_name").alias("node_name"),
            F.when(F.col("s_acctbal") >= 0, "Live").otherwise("Unreachable").alias("state"),
            (key % 3 == 0).alias("is_master"), F.when(key % 4 != 0, key % 2 == 0).alias("is_tserver"),
            F.lower("r_name").alias("cloud"), F.when(key % 5 != 0, F.col("n_name")).alias("region"),
            _text(key % 3, "az").alias("az"), (key % 16 + 2).cast("int").alias("num_cores"),
            F.col("s_acctbal").cast("decimal(18,2)").alias("mem_size_gb"),
            F.when(key % 6 != 0, F.col("s_acctbal")).cast("decimal(18,2)").alias("volume_size_gb"),
        )


def _message_case() -> str:
    whens = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES))
    return f"CASE event_id % {len(MESSAGES)} {whens} END"


# The same views for DuckDB, by name.
SQL = {
    "log_events": f"""
        SELECT event_id, ts AS "timestamp",
          CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'n' || (user_id % 7) END AS node_name,
          CASE event_type WHEN 'purchase' THEN 'postgres' WHEN 'signup' THEN 'yb-master' ELSE 'yb-tserver' END AS log_type,
          'bundle-' || (user_id % 20) AS support_bundle,
          CASE WHEN event_id % 3 = 0 THEN value END AS long_op_value,
          CASE WHEN event_id % 3 = 1 THEN value / 10 END AS timing_real_value,
          {_message_case()} AS message
        FROM events""",
    "ts_cluster": """
        SELECT 's' || s_suppkey AS uuid, r_name AS region, n_name AS zone
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ts_tablet": """
        SELECT 's' || l_suppkey AS node_uuid, 't' || l_partkey AS tablet_uuid, MIN(p_brand) AS table_name,
          'u-' || MIN(p_brand) AS table_uuid, MIN(p_type) AS namespace,
          CASE WHEN l_partkey % 50 = 0 THEN NULL WHEN MIN(l_returnflag) = 'R' THEN 'TABLET_DATA_TOMBSTONED'
               ELSE 'TABLET_DATA_READY' END AS status,
          CAST(FLOOR(MAX(l_extendedprice) * 1000) AS BIGINT) AS sst_size,
          CAST(FLOOR(MAX(l_quantity)) AS BIGINT) AS wal_size,
          CASE WHEN MIN(l_linestatus) = 'O' THEN 'HAS_LEASE' ELSE 'NO_LEASE' END AS lease_status
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, l_partkey""",
    "reports": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, 'bundle-' || o_custkey || '-' || (o_orderkey % 3) AS support_bundle_name,
          o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS own_organization
        FROM orders""",
    "bundle_header": """
        SELECT 'bundle-' || o_custkey || '-' || (o_orderkey % 3) AS support_bundle, MIN(c_name) AS cluster_name,
          'c' || o_custkey AS cluster_uuid, MIN(n_name) AS organization,
          CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS case_id, MAX(o_orderdate) AS "timestamp"
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE c_acctbal >= 0 GROUP BY o_custkey, o_orderkey % 3""",
    "snapshots": """
        SELECT 'o' || o_orderkey AS support_bundle, c_name AS cluster_name, n_name AS organization,
          o_orderdate AS "timestamp"
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "bundle_flags": """
        SELECT 'o' || l_orderkey AS support_bundle, 'n' || (l_linenumber % 3) AS node_name,
          CASE WHEN l_linestatus = 'O' THEN 'tserver' ELSE 'master' END AS server_type,
          'flag_' || (l_partkey % 8) AS gflag, CAST(CAST(MIN(l_quantity) AS BIGINT) AS VARCHAR) AS value
        FROM lineitem GROUP BY l_orderkey, l_linenumber % 3, l_linestatus, l_partkey % 8""",
    "node_inventory": """
        SELECT 'bundle-' || s_suppkey || '-' || (s_suppkey % 3) AS support_bundle, s_name AS node_name,
          CASE WHEN s_acctbal >= 0 THEN 'Live' ELSE 'Unreachable' END AS state, s_suppkey % 3 = 0 AS is_master,
          CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 2 = 0 END AS is_tserver,
          lower(r_name) AS cloud, CASE WHEN s_suppkey % 5 <> 0 THEN n_name END AS region, 'az' || (s_suppkey % 3) AS az,
          CAST(s_suppkey % 16 + 2 AS INTEGER) AS num_cores, CAST(s_acctbal AS DECIMAL(18,2)) AS mem_size_gb,
          CAST(CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal END AS DECIMAL(18,2)) AS volume_size_gb
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}


SQL["loose_events"] = f"""
        SELECT * REPLACE (CASE WHEN event_id % 89 <> 0 THEN support_bundle END AS support_bundle) FROM ({SQL['log_events']})"""


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
