"""Tablet reports: per-table statistics and replica spread over zones.

Tables carry the replicas of any number of clusters when ``by`` names the report
or bundle. All distinct counts go through Spark's two-step distinct aggregation,
so no table, zone or tablet is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.functions.encodings import format_bytes, lenient_int

TOMBSTONED = "TABLET_DATA_TOMBSTONED"
HAS_LEASE = "HAS_LEASE"


def _distinct_with_null(column: str) -> Column:
    """Distinct values where null counts as one."""
    return F.count_distinct(column) + F.max(F.col(column).isNull().cast("int")).cast("bigint")


def table_info(
    tablets: DataFrame, by: Sequence[str] = (), file: str = "node_uuid", pos: str | None = None
) -> DataFrame:
    """Statistics per (namespace, table).

    The last non-empty table_uuid is kept; ``file`` and the number ``pos`` inside
    it declare the order of the rows. Replicas are first counted per node, which
    also gives the smallest and largest number on a node. The first step groups
    by all texts it needs, so that it can hash.
    """
    keys = [*by, "namespace", "table_name"]
    rows = tablets.select(
        *keys, "node_uuid", F.col(file).alias("_file"), F.nullif(F.col("table_uuid"), F.lit("")).alias("_uuid"),
        F.col(pos).alias("_pos") if pos else F.lit(0).cast("bigint").alias("_pos"),
        lenient_int(F.col("sst_size")).alias("_sst"), lenient_int(F.col("wal_size")).alias("_wal"), "lease_status")
    pieces = rows.groupBy(*keys, "node_uuid", "_file", "_uuid").agg(
        F.count("*").alias("n"), F.sum("_sst").alias("sst"), F.sum("_wal").alias("wal"),
        F.count_if(F.col("lease_status") == HAS_LEASE).alias("leaders"), F.max("_pos").alias("_pos"),
    )
    last = F.when(F.col("_uuid").isNotNull(), F.struct("_file", "_pos", "_uuid"))
    per_node = pieces.groupBy(*keys, "node_uuid").agg(
        F.sum("n").alias("n"), F.sum("sst").alias("sst"), F.sum("wal").alias("wal"),
        F.sum("leaders").alias("leaders"), F.max(last).alias("last"),
    )
    totals = per_node.groupBy(*keys).agg(
        F.sum("n").alias("tot_tablet_count"),
        F.sum("leaders").alias("leader_tablets"),
        F.min("n").alias("node_tablet_min"),
        F.max("n").alias("node_tablet_max"),
        F.sum("sst").alias("sst_tot_bytes"),
        F.sum("wal").alias("wal_tot_bytes"),
        F.max("last")["_uuid"].alias("table_uuid"),
    )
    unique = tablets.groupBy(*keys).agg(_distinct_with_null("tablet_uuid").alias("uniq_tablet_count"))
    same = [totals[k].eqNullSafe(unique[k]) for k in keys]
    joined = totals.join(unique, same).select(totals["*"], "uniq_tablet_count")
    rf1 = F.col("sst_tot_bytes") * F.col("uniq_tablet_count") / F.col("tot_tablet_count")
    none = F.lit(0)
    return joined.select(
        *by, "namespace", F.col("table_name").alias("tablename"), "table_uuid",
        "tot_tablet_count", "uniq_tablet_count", none.alias("uniq_tablets_estimate"), "leader_tablets",
        "node_tablet_min", "node_tablet_max", none.alias("keys_per_tablet"), none.alias("key_range_overlap"),
        none.alias("unmatched_key_size"), F.lit("").alias("comment"), "sst_tot_bytes", "wal_tot_bytes",
        format_bytes(F.col("sst_tot_bytes")).alias("sst_tot_human"),
        format_bytes(F.col("wal_tot_bytes")).alias("wal_tot_human"),
        format_bytes(rf1).alias("sst_rf1_human"),
        format_bytes(F.col("sst_tot_bytes") + F.col("wal_tot_bytes")).alias("tot_human"),
    )


def live_replicas(tablets: DataFrame) -> DataFrame:
    """Replicas that are not tombstoned; an unknown status is kept."""
    return tablets.filter(~F.col("status").eqNullSafe(TOMBSTONED))


def server_zones(tservers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Zone of each tablet server; of two rows with one uuid the later counts."""
    at = "pos" if "pos" in tservers.columns else "uuid"
    return (
        tservers.filter(F.col("type") == "TSERVER").groupBy(*by, "uuid")
        .agg(F.max_by(F.struct("region", "zone"), at).alias("_z"))
        .select(*by, F.col("uuid").alias("node_uuid"), "_z.region", "_z.zone")
    )


def zoned_tablets(tablets: DataFrame, tservers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Live replicas with the zone of their server; servers the cluster does not list are left out."""
    replicas = live_replicas(tablets).select(*by, "node_uuid", "tablet_uuid")
    return replicas.join(server_zones(tservers, by), [*by, "node_uuid"])


def zone_replicas(tablets: DataFrame, tservers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form: per zone and replica count, the number of tablets with that count.

    ``missing_replicas`` counts live tablets without a replica in the zone;
    ``balanced`` says whether all tablets of the zone have the same count.
    """
    zone = [*by, "region", "zone"]
    live = live_replicas(tablets).select(*by, "node_uuid", "tablet_uuid")
    listed = server_zones(tservers, by)
    # Replicas of a tablet per zone, then the tablet's zones in one short list with an entry for the tablet itself.
    held = live.join(listed.withColumn("_listed", F.lit(True)), [*by, "node_uuid"], "left").groupBy(
        *by, "tablet_uuid", "_listed", "region", "zone").agg(F.count("*").alias("replica_count"))
    entry = F.struct("_listed", "region", "zone", "replica_count")
    itself = F.struct(F.lit(False).alias("_listed"), F.lit(None).cast("string").alias("region"),
                      F.lit(None).cast("string").alias("zone"), F.lit(0).cast("bigint").alias("replica_count"))
    places = held.groupBy(*by, "tablet_uuid").agg(F.collect_list(F.when(F.col("_listed"), entry)).alias("_in"))
    spread = places.select(*by, F.inline(F.concat("_in", F.array(itself)))).groupBy(
        *zone, "_listed", "replica_count").agg(F.count("*").alias("tablets"))
    # From here on there is one row per zone and replica count.
    in_zone, in_all = Window.partitionBy(*zone, "_listed"), Window.partitionBy(*(by or [F.lit(0)]))
    spread = spread.select(
        *zone, "replica_count", "tablets", "_listed", F.sum("tablets").over(in_zone).alias("_held"),
        F.count("*").over(in_zone).alias("_kinds"),
        F.max(F.when(~F.col("_listed"), F.col("tablets"))).over(in_all).alias("_every")).filter("_listed")
    servers = live.select(*by, "node_uuid").distinct().join(listed, [*by, "node_uuid"])
    servers = servers.groupBy(*zone).agg(F.count("*").alias("tservers"))
    s, v = spread.alias("s"), servers.alias("v")
    return s.join(v, [F.col(f"s.{k}").eqNullSafe(F.col(f"v.{k}")) for k in zone]).select(
        *[F.col(f"s.{k}") for k in zone], "tservers",
        (F.col("_every") - F.col("_held")).alias("missing_replicas"),
        "replica_count", "tablets",
        F.when(F.col("_kinds") <= 1, F.lit("YES")).otherwise("NO").alias("balanced"),
    )


def missing_tablets(tablets: DataFrame, tservers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Live tablets that no listed server of the cluster holds, by name."""
    zoned = zoned_tablets(tablets, tservers, by).select(*by, "tablet_uuid").distinct().alias("z")
    live = live_replicas(tablets).select(*by, "tablet_uuid").distinct().alias("l")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"z.{k}")) for k in (*by, "tablet_uuid")]
    return live.join(zoned, same, "left_anti")


def max_replicas(zones: DataFrame) -> int:
    """Largest replica count over all zones (1 when there is none): the pivot width."""
    return zones.agg(F.coalesce(F.max("replica_count"), F.lit(1))).first()[0]


def zone_pivot(zones: DataFrame, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Display form: one row per zone with columns ``1_replicas`` .. ``<width>_replicas``.

    ``width`` comes from ``max_replicas``; a count beyond it ends the job, so no tablet is lost. ``zone_counts`` needs no width.
    """
    too_wide = F.raise_error(F.format_string(f"replica count %d is beyond the {int(width)} columns", "replica_count"))
    zones = zones.withColumn("tablets", F.when(F.col("replica_count") > width, too_wide.cast("bigint")).otherwise(F.col("tablets")))
    counts = [
        F.sum(F.when(F.col("replica_count") == i, F.col("tablets")).otherwise(0)).alias(f"{i}_replicas")
        for i in range(1, width + 1)
    ]
    keys = [*by, "region", "zone", "tservers", "missing_replicas", "balanced"]
    head = [*by, "region", "zone", "tservers", "missing_replicas"]
    return zones.groupBy(*keys).agg(*counts).select(*head, *[f"{i}_replicas" for i in range(1, width + 1)], "balanced")


def zone_counts(zones: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per zone with ``replicas``, a map from each replica count to its number of tablets."""
    head = [*by, "region", "zone", "tservers", "missing_replicas"]
    entries = F.sort_array(F.collect_list(F.struct("replica_count", "tablets")))
    return zones.groupBy(*head, "balanced").agg(F.map_from_entries(entries).alias("replicas")).select(*head, "replicas", "balanced")
