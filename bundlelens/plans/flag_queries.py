"""Queries over configuration flags and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from bundlelens.adapters import with_views
from bundlelens.functions.timestamps import second_text
from bundlelens.operators import flags
from bundlelens.plans.registry import query

_BASE = with_views("snapshots", "bundle_flags")


def _steps(order: str) -> str:
    newest = order == "newest_first"
    by = '"timestamp" DESC, support_bundle' if newest else '"timestamp", support_bundle DESC'
    return _BASE + f""", steps AS (
      SELECT *, row_number() OVER w - 1 AS step, lag(support_bundle) OVER w AS prev_bundle
      FROM snapshots WINDOW w AS (PARTITION BY cluster_name, organization ORDER BY {by})),
    placed AS (SELECT * FROM steps JOIN bundle_flags USING (support_bundle)),
    earlier AS (SELECT s.*, f.node_name, f.server_type, f.gflag, f.value AS old_value
      FROM steps s JOIN bundle_flags f ON f.support_bundle = s.prev_bundle),
    history AS (
      SELECT coalesce(c.cluster_name, p.cluster_name) AS cluster_name, coalesce(c.organization, p.organization) AS organization,
        coalesce(c.step, p.step) AS step, coalesce(c.prev_bundle, p.prev_bundle) AS prev_bundle, support_bundle,
        coalesce(c."timestamp", p."timestamp") AS "timestamp", node_name, server_type, gflag, old_value, c.value AS new_value,
        CASE WHEN coalesce(c.step, p.step) = 0 THEN 'initial' WHEN p.step IS NULL THEN 'added' WHEN c.step IS NULL THEN 'removed'
          WHEN c.value = old_value THEN 'same' ELSE 'modified' END AS change
      FROM placed c FULL JOIN earlier p USING (support_bundle, node_name, server_type, gflag))"""


_NEWEST = _steps("newest_first")
_HISTORY_COLUMNS = """cluster_name, organization, step, prev_bundle, support_bundle,
    strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", node_name, server_type, gflag, change, old_value, new_value"""
_COUNTS = """count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
    count(*) FILTER (change = 'modified') AS modified"""


def _timed(df):
    return df.withColumn("timestamp", second_text(F.col("timestamp")))


def steps(v, order="newest_first"):
    return flags.snapshot_steps(v.snapshots(), order)


def history(v, order="newest_first"):
    return flags.flag_history(v.bundle_flags(), steps(v, order))


@query("report_flags", _BASE + """
    SELECT CAST(o_orderkey AS VARCHAR) AS id, support_bundle, server_type, gflag, arg_max(value, node_name) AS value
    FROM orders JOIN bundle_flags ON support_bundle = 'o' || o_orderkey GROUP BY o_orderkey, support_bundle, server_type, gflag""")
def report_flags(v):
    """J13, D10, W4"""
    return flags.report_flags(v.flag_reports(), v.bundle_flags())


@query("report_flags_per_node", _BASE + """
    SELECT CAST(o_orderkey AS VARCHAR) AS id, support_bundle, node_name, server_type, gflag, value
    FROM orders JOIN bundle_flags ON support_bundle = 'o' || o_orderkey
    WHERE server_type IN ('master', 'tserver', 'controller')""")
def report_flags_per_node(v):
    """J13 per node, F19"""
    return flags.report_flags(v.flag_reports(), flags.known_servers(v.bundle_flags()), per_node=True)


@query("flag_maps", _BASE + """
    , single AS (SELECT o_orderkey, server_type, gflag, arg_max(value, node_name) AS value
      FROM orders JOIN bundle_flags ON support_bundle = 'o' || o_orderkey GROUP BY ALL)
    SELECT CAST(o_orderkey AS VARCHAR) AS id, server_type, string_agg(gflag || '=' || value, ',' ORDER BY gflag) AS gflags
    FROM single GROUP BY o_orderkey, server_type""")
def flag_maps(v):
    """A16, shown as text"""
    maps = flags.flag_maps(flags.report_flags(v.flag_reports(), v.bundle_flags()))
    pairs = F.transform(F.map_entries("gflags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.select("id", "server_type", F.array_join(pairs, ",").alias("gflags"))


@query("latest_snapshot", _BASE + """
    SELECT cluster_name, organization, strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S') AS latest
    FROM snapshots GROUP BY cluster_name, organization""")
def latest_snapshot(v):
    """A18"""
    rows = flags.latest_snapshot(v.snapshots())
    return rows.withColumn("latest", second_text(F.col("latest")))


_WINDOW = """, ref AS (SELECT cluster_name, organization, max("timestamp") AS latest FROM snapshots GROUP BY ALL),
    chosen AS (SELECT s.* FROM snapshots s JOIN ref USING (cluster_name, organization)
      WHERE s."timestamp" BETWEEN latest - INTERVAL 365 DAY AND latest)"""


@query("snapshots_window", _BASE + _WINDOW + """
    SELECT support_bundle, cluster_name, organization, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp" FROM chosen""")
def snapshots_window(v):
    """one year back from each cluster's latest snapshot"""
    return _timed(flags.snapshots_window(v.snapshots(), days=365))


@query("flags_of_window", _BASE + _WINDOW + """
    SELECT * FROM bundle_flags WHERE support_bundle IN (SELECT support_bundle FROM chosen)""")
def flags_of_window(v):
    """J15"""
    return flags.flags_of(v.bundle_flags(), flags.snapshots_window(v.snapshots(), days=365))


@query("snapshot_steps", _NEWEST + """
    SELECT cluster_name, organization, step, support_bundle, prev_bundle,
      strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp" FROM steps""")
def snapshot_steps(v):
    """Walk order and neighbours"""
    return _timed(flags.snapshot_steps(v.snapshots())).drop("next_bundle", "next_timestamp")


@query("flag_history", _NEWEST + f"SELECT {_HISTORY_COLUMNS} FROM history")
def flag_history(v):
    """Every flag at every step, unchanged ones included"""
    return _timed(history(v))


@query("flag_diff", _NEWEST + f"SELECT {_HISTORY_COLUMNS} FROM history WHERE change IN ('added', 'removed', 'modified')")
def flag_diff(v):
    """U2, U3, U4, newest first"""
    return _timed(flags.flag_diff(v.bundle_flags(), steps(v)))


@query("flag_diff_oldest_first",
       _steps("oldest_first") + f"SELECT {_HISTORY_COLUMNS} FROM history WHERE change IN ('added', 'removed', 'modified')")
def flag_diff_oldest_first(v):
    """U2, U3, U4 in the order of time"""
    return _timed(flags.flag_diff(v.bundle_flags(), steps(v, "oldest_first")))


@query("flag_change_counts", _NEWEST + f"""
    SELECT cluster_name, organization, node_name, server_type, step, {_COUNTS} FROM history GROUP BY ALL""")
def flag_change_counts(v):
    """A23"""
    return flags.change_counts(history(v))


@query("diff_summary_role", _NEWEST + f"""
    SELECT cluster_name, organization, node_name, server_type, {_COUNTS} FROM history GROUP BY ALL""")
def diff_summary_role(v):
    """A15 per (node, role)"""
    return flags.diff_summary(history(v), "role")


@query("diff_summary_node", _NEWEST + f"SELECT cluster_name, organization, node_name, {_COUNTS} FROM history GROUP BY ALL")
def diff_summary_node(v):
    """A15 per node"""
    return flags.diff_summary(history(v), "node")


def _pairs(when: str, value: str) -> str:
    return f"coalesce(string_agg(gflag || '=' || {value}, ',' ORDER BY gflag) FILTER ({when}), '')"


@query("diff_payload", _NEWEST + f"""
      SELECT cluster_name, organization, support_bundle, node_name, server_type, step,
        strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", CASE WHEN step = 0 THEN 'initial' ELSE 'diff' END AS type,
        {_pairs("change = 'added'", 'new_value')} AS added, {_pairs("change = 'removed'", 'old_value')} AS removed,
        {_pairs("change = 'modified'", "old_value || '>' || new_value")} AS modified,
        {_pairs("change <> 'removed'", 'new_value')} AS gflags
      FROM history GROUP BY cluster_name, organization, support_bundle, node_name, server_type, step, "timestamp" """)
def diff_payload(v):
    """M6, M7: every (node, role) at every snapshot that has or lost flags of it, maps shown as text"""
    def shown(name, value=lambda e: e["value"]):
        return F.array_join(F.transform(
            F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), value(e))), ",").alias(name)
    rows = _timed(flags.diff_payload(v.bundle_flags(), steps(v)))
    keep = [c for c in rows.columns if c not in ("added", "removed", "modified", "gflags")]
    return rows.select(
        *keep, shown("added"), shown("removed"),
        shown("modified", lambda e: F.concat(e["value"]["old"], F.lit(">"), e["value"]["new"])), shown("gflags"))
