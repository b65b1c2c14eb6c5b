"""Configuration flags: lookup by report and comparison of snapshots over time.

A snapshot is a support bundle of a cluster. Consecutive snapshots are compared
by one grouping on (bundle, node, role, flag): every flag of a snapshot counts for
its own bundle and, as the old one, for the bundle compared with it, so no cluster,
however large or old, ends up in one task. The header lists each bundle once. Null
clusters and organizations are clusters like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.session import written

CLUSTER = ("cluster_name", "organization")
# Server types shown.
KNOWN_SERVER_TYPES = ("master", "tserver", "controller")


def known_servers(flags: DataFrame) -> DataFrame:
    return flags.filter(F.col("server_type").isin(*KNOWN_SERVER_TYPES))


def report_flags(reports: DataFrame, flags: DataFrame, per_node: bool = False) -> DataFrame:
    """Flags of each report: one value per (report, server type, flag).

    Nodes collapse; the value of the greatest node name is kept. ``per_node``
    keeps every node.
    """
    wanted = reports.select("id", F.col("support_bundle_name").alias("support_bundle"))
    if per_node:
        return wanted.join(flags, "support_bundle")
    single = flags.groupBy("support_bundle", "server_type", "gflag").agg(
        F.max_by("value", F.struct("node_name", "value")).alias("value")
    )
    return wanted.join(single, "support_bundle")


def flag_maps(report_flag_rows: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """Server type -> {flag: value}; a map holds one entry per flag name of a server type."""
    return report_flag_rows.groupBy(*by, "server_type").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("gflag", "value")))).alias("gflags")
    )


def _equal(left: str, right: str, columns: Sequence[str]):
    """Equal columns of two aliases; null equals null."""
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]


def latest_snapshot(header: DataFrame) -> DataFrame:
    """Time of the latest snapshot per (cluster, organization)."""
    return header.groupBy(*CLUSTER).agg(F.max("timestamp").alias("latest"))


def snapshots_window(
    header: DataFrame,
    days: int | None = 90,
    cluster: str | None = None,
    organization: str | None = None,
    reference_bundle: str | None = None,
) -> DataFrame:
    """Snapshots of the last ``days`` days up to the reference snapshot.

    The reference is the latest one of each cluster, or ``reference_bundle``.
    Without ``cluster`` every cluster is taken with its own reference. ``days``
    None sets no lower limit.
    """
    rows = header
    if cluster is not None:
        rows = rows.filter(F.col("cluster_name") == cluster)
    if organization is not None:
        rows = rows.filter(F.col("organization") == organization)
    if reference_bundle is None:
        reference = latest_snapshot(rows)
    else:
        reference = rows.filter(F.col("support_bundle") == reference_bundle).select(
            *CLUSTER, F.col("timestamp").alias("latest")
        ).distinct()
    joined = rows.alias("s").join(reference.alias("r"), _equal("s", "r", CLUSTER)).select("s.*", "r.latest")
    if days is not None:
        joined = joined.filter(F.col("timestamp") >= F.col("latest") - F.make_dt_interval(F.lit(int(days))))
    return joined.filter(F.col("timestamp") <= F.col("latest")).drop("latest")


def flags_of(flags: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Flags of the chosen bundles."""
    return flags.join(snapshots.select("support_bundle").distinct(), "support_bundle", "left_semi")


def snapshot_steps(snapshots: DataFrame, order: str = "newest_first") -> DataFrame:
    """Numbers each cluster's snapshots in walk order and links each to its neighbours.

    Adds ``step`` (0 for the first), ``prev_bundle``, ``next_bundle`` and
    ``next_timestamp``. Snapshots are ranked within their day; days are then
    chained, so that a cluster with very many snapshots is not sorted in one
    task, only its list of days is.
    """
    if order not in ("newest_first", "oldest_first"):
        raise ValueError("order is 'newest_first' or 'oldest_first'")
    newest = order == "newest_first"
    by_time = (
        [F.desc("timestamp"), F.asc("support_bundle")] if newest else [F.asc("timestamp"), F.desc("support_bundle")]
    )
    dated = snapshots.select(
        *CLUSTER, "support_bundle", "timestamp", F.to_date("timestamp").alias("_day")
    )
    in_day = Window.partitionBy(*CLUSTER, "_day").orderBy(*by_time)
    ranked = dated.select(
        "*", F.row_number().over(in_day).alias("_rank"), F.lag("support_bundle").over(in_day).alias("_prev"),
        F.lead(F.struct("support_bundle", "timestamp")).over(in_day).alias("_next"),
    )
    in_walk = Window.partitionBy(*CLUSTER).orderBy(F.desc("_day") if newest else F.asc("_day"))
    days = ranked.groupBy(*CLUSTER, "_day").agg(
        F.max("_rank").alias("_n"),
        F.max_by("support_bundle", "_rank").alias("_last"),
        F.min_by(F.struct("support_bundle", "timestamp"), "_rank").alias("_first"),
    ).select(
        *CLUSTER, "_day",
        (F.sum("_n").over(in_walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"),
        F.lag("_last").over(in_walk).alias("_day_prev"), F.lead("_first").over(in_walk).alias("_day_next"),
    )
    following = F.coalesce("_next", "_day_next")
    return ranked.alias("r").join(days.alias("d"), _equal("r", "d", [*CLUSTER, "_day"])).select(
        *[F.col(f"r.{c}") for c in CLUSTER], (F.col("_before") + F.col("_rank") - 1).cast("bigint").alias("step"), "support_bundle", "timestamp",
        F.coalesce("_prev", "_day_prev").alias("prev_bundle"),
        following["support_bundle"].alias("next_bundle"), following["timestamp"].alias("next_timestamp"),
    )


def single_values(flags: DataFrame) -> DataFrame:
    """One value per (bundle, node, role, flag), the greatest; needed only where the table repeats keys."""
    return flags.groupBy("support_bundle", "node_name", "server_type", "gflag").agg(F.max("value").alias("value"))


def flag_history(flags: DataFrame, steps: DataFrame) -> DataFrame:
    """Every flag at every snapshot that has it or had it one step before.

    ``change`` is initial (first snapshot), added, removed, modified or same,
    always seen from ``prev_bundle`` to ``support_bundle`` in walk order. Values
    are compared as text; of a repeated (bundle, node, role, flag) the greatest
    value counts. ``steps`` comes from ``snapshot_steps``.

    The steps are written once and read twice: only the names of the two bundles travel with a flag, what else is known
    of a step joins it where all flags of the bundle lie.
    """
    process = ["node_name", "server_type", "gflag"]
    steps = written(steps.select("support_bundle", *CLUSTER, "timestamp", "step", "prev_bundle", "next_bundle"), "steps")
    placed = flags.select("support_bundle", *process, "value").join(
        steps.select("support_bundle", "prev_bundle", "next_bundle"), "support_bundle")
    own = F.struct("support_bundle", F.col("prev_bundle").alias("_prev"), F.lit(True).alias("_own"))
    later = F.struct(
        F.col("next_bundle").alias("support_bundle"), F.col("support_bundle").alias("_prev"), F.lit(False).alias("_own"))
    seen = placed.select(*process, "value", F.inline(F.array(own, later))).filter(F.col("support_bundle").isNotNull())
    # Dealt by bundle before it is grouped, so a task sorts its flags once and both joins and groupings by bundle stay in it.
    both = seen.repartition("support_bundle").groupBy("support_bundle", "_prev", *process).agg(
        F.max(F.when(F.col("_own"), F.col("value"))).alias("new_value"),
        F.max(F.when(~F.col("_own"), F.col("value"))).alias("old_value"),
        F.bool_or("_own").alias("_new"), F.bool_or(~F.col("_own")).alias("_old"))
    # Not a key of the join: that would deal the flags out again.
    follows = F.coalesce(F.col("_prev") == F.col("prev_bundle"), F.col("_prev").isNull() & F.col("prev_bundle").isNull())
    same = F.col("new_value").cast("string").eqNullSafe(F.col("old_value").cast("string"))
    return both.join(steps.drop("next_bundle"), "support_bundle").filter(follows).select(
        *CLUSTER, "step", "prev_bundle", "support_bundle", "timestamp", *process,
        F.when(F.col("step") == 0, "initial").when(~F.col("_old"), "added").when(~F.col("_new"), "removed")
        .when(same, "same").otherwise("modified").alias("change"), "old_value", "new_value",
    )


def flag_diff(flags: DataFrame, steps: DataFrame) -> DataFrame:
    """Added, removed and modified flags of every step of every cluster."""
    history = flag_history(flags, steps)
    return history.filter(F.col("change").isin("added", "removed", "modified"))


def _change_counts():
    return [
        F.count_if(F.col("change") == kind).alias(kind) for kind in ("added", "removed", "modified")
    ]


def change_counts(history: DataFrame) -> DataFrame:
    """Changes per (node, role) and step.

    A step has one bundle; with it as a key the rows of ``flag_history`` are counted where they lie.
    """
    return history.groupBy("support_bundle", *CLUSTER, "node_name", "server_type", "step").agg(
        *_change_counts()).drop("support_bundle")


def diff_summary(history: DataFrame, level: str = "role") -> DataFrame:
    """Changes over all steps per node or per (node, role), zeros included."""
    keys = {"node": ["node_name"], "role": ["node_name", "server_type"]}[level]
    return history.groupBy(*CLUSTER, *keys).agg(*_change_counts())


def diff_payload(flags: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per (node, role) and snapshot that has or just lost flags of it, with its flags and changes as maps.

    Maps hold the flag names of one process; the history of a process stays one row per snapshot.
    """
    history = flag_history(flags, steps)
    cell = [*CLUSTER, "support_bundle", "node_name", "server_type", "step", "timestamp"]

    def as_map(condition, value):
        pairs = F.transform(F.filter("_flags", condition), lambda f: F.struct(f["gflag"], value(f).alias("v")))
        return F.map_from_entries(pairs)

    new, old = lambda f: f["new_value"], lambda f: f["old_value"]
    cells = history.groupBy(*cell).agg(
        F.array_sort(F.collect_list(F.struct("gflag", "change", "old_value", "new_value"))).alias("_flags"))
    return cells.select(
        *cell, F.when(F.col("step") == 0, "initial").otherwise("diff").alias("type"),
        as_map(lambda f: f["change"] == "added", new).alias("added"),
        as_map(lambda f: f["change"] == "removed", old).alias("removed"),
        as_map(lambda f: f["change"] == "modified", lambda f: F.struct(old(f).alias("old"), new(f).alias("new"))).alias("modified"),
        as_map(lambda f: f["change"] != "removed", new).alias("gflags"),
    )


def ordered_steps(rows: DataFrame) -> DataFrame:
    """(node, role) ascending, then walk order; for the final export only."""
    return rows.orderBy(*CLUSTER, "node_name", "server_type", "step")
