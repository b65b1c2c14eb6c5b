"""The report catalogue: listing, search, relations, and report documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.functions.encodings import placement, yes_no
from bundlelens.functions.timestamps import iso_second, listing_minute, minute_key, parse_tolerant
from bundlelens.operators.joins import null_safe_join

RELATED_LIMIT = 20
HEADER = ("cluster_name", "organization", "cluster_uuid", "case_id")
HISTOGRAM = "map<string, bigint>"
MESSAGE = f"struct<StartTime: string, EndTime: string, count: bigint, histogram: {HISTOGRAM}, solution: string>"
NODES = f"map<string, map<string, struct<node: string, logType: string, logMessages: map<string, {MESSAGE}>>>>"
WARNING = "struct<message: string, level: string, type: string, additional_details: string>"


# ---- catalogue ------------------------------------------------------------

def with_header(reports: DataFrame, header: DataFrame) -> DataFrame:
    """Reports with the header of their bundle; reports without one are kept."""
    head = header.select(F.col("support_bundle").alias("support_bundle_name"), *HEADER)
    return reports.join(head, "support_bundle_name", "left")


def find_report(reports: DataFrame, report_id: str) -> DataFrame:
    return reports.filter(F.col("id").cast("string") == report_id)


def augmented_reports(reports: DataFrame, header: DataFrame) -> DataFrame:
    """Reports with top-level fields: those of the document, else those of the header."""
    doc = F.try_parse_json(F.col("json_report"))

    def held(name):
        return F.try_variant_get(doc, f"$.{name}", "string")

    cluster, organization = F.nullif("cluster_name", F.lit("")), F.nullif("organization", F.lit(""))
    return with_header(reports, header).select(
        "id", "json_report",
        F.coalesce(held("support_bundle_name"), "support_bundle_name").alias("support_bundle_name"),
        F.coalesce(held("cluster_name"), cluster).alias("cluster_name"),
        F.coalesce(held("universe_name"), cluster).alias("universe_name"),
        F.coalesce(held("organization"), organization).alias("organization"),
        F.coalesce(held("organization_name"), organization).alias("organization_name"),
        F.coalesce(held("case_id"), F.col("case_id").cast("string")).alias("case_id"),
    )


def listing_row(rows: DataFrame) -> DataFrame:
    """Columns of the report list; absent cluster and organization read ''."""
    return rows.select(
        F.col("id").cast("string").alias("id"), "support_bundle_name",
        F.coalesce("cluster_name", F.lit("")).alias("universe_name"),
        F.coalesce("organization", F.lit("")).alias("organization_name"),
        "case_id", listing_minute(F.col("created_at")).alias("created_at"),
    )


def search_reports(reports: DataFrame, header: DataFrame, query: str) -> DataFrame:
    """Reports whose id, bundle, cluster, organization or case contains the text.

    Case-insensitive; ``%`` and ``_`` in the query are wildcards. A blank query
    finds nothing.
    """
    rows = with_header(reports, header)
    text = query.strip()
    if not text:
        return rows.limit(0)
    like = f"%{text}%"
    found = F.lit(False)
    for column in ("id", "support_bundle_name", "cluster_name", "organization", "case_id"):
        found = found | F.coalesce(F.col(column).cast("string").ilike(like), F.lit(False))
    return rows.filter(found)


def list_reports(
    reports: DataFrame, header: DataFrame, page: int = 1, per_page: int = 10, query: str | None = None
) -> DataFrame:
    """One page of the list, newest first, ties by id.

    Without a query the page is cut from the reports before they meet their
    header: a left join never loses a report, so rows past the page cannot enter it.
    """
    offset = (page - 1) * per_page
    order = [F.desc("created_at"), F.asc("id")]
    if query:
        rows = search_reports(reports, header, query)
    else:
        rows = with_header(reports.orderBy(*order).limit(offset + per_page), header)
    return listing_row(rows.orderBy(*order).offset(offset).limit(per_page))


def page_count(reports: DataFrame, header: DataFrame, per_page: int = 10, query: str | None = None) -> DataFrame:
    """Total number of rows and of pages (at least one).

    Without a query the headers are not looked at: a report is listed once, with its header or without.
    """
    rows = search_reports(reports, header, query) if query else reports
    total = F.count("*")
    return rows.agg(
        total.alias("total_reports"),
        F.greatest(F.ceil(total / per_page), F.lit(1)).cast("bigint").alias("total_pages"),
    )


def latest_reports(reports: DataFrame) -> DataFrame:
    """Id of the newest report of each bundle (ties: greatest id)."""
    return reports.groupBy("support_bundle_name").agg(
        F.max_by("id", F.struct("created_at", "id")).alias("id")
    )


# ---- relations ------------------------------------------------------------

_REPORT = ("created_at", "id", "support_bundle_name", *HEADER)


def _newest(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k newest rows per key (ties: smallest id).

    A rank limit: Spark cuts every task's rows to k per key before the shuffle,
    so a hot key sends k rows per task.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.asc("id"))
    return rows.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= k).drop("_rank")


def _newest_first(items: Column) -> Column:
    """Newest first, ties by smallest id."""
    return F.array_sort(items, lambda a, b: F.when(a["created_at"] > b["created_at"], -1)
                        .when(a["created_at"] < b["created_at"], 1)
                        .when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))


def _as_lists(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The few rows of each key as an array, newest first."""
    return rows.groupBy(key).agg(_newest_first(F.collect_list(F.struct(*_REPORT))).alias(name))


def _headed(reports: DataFrame, header: DataFrame) -> DataFrame:
    """Reports that have a header, with it."""
    head = header.select(F.col("support_bundle").alias("support_bundle_name"), *HEADER)
    return reports.select("created_at", F.col("id").cast("string").alias("id"), "support_bundle_name").join(
        head, "support_bundle_name")


def _anchors(headed: DataFrame, anchors: DataFrame | None) -> DataFrame:
    rows = headed if anchors is None else headed.join(
        anchors.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
    return rows.select(F.col("id").alias("anchor_id"), "cluster_uuid", "organization").distinct()


def _cluster_lists(headed: DataFrame) -> DataFrame:
    """The 21 newest reports of each cluster: 20 and, possibly, the anchor itself."""
    named = headed.filter(F.col("cluster_uuid").isNotNull())
    return _as_lists(_newest(named, ["cluster_uuid"], RELATED_LIMIT + 1), "cluster_uuid", "in_cluster")


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select("anchor_id", "relation", F.explode("items").alias("r")).select(
        "anchor_id", "relation", "r.id", "r.support_bundle_name", "r.cluster_name", "r.organization",
        "r.cluster_uuid", "r.case_id", listing_minute(F.col("r.created_at")).alias("created_at"),
    )


def _top(ordered: Column) -> Column:
    return F.slice(ordered, 1, RELATED_LIMIT)


def related_reports(reports: DataFrame, header: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """The 20 newest reports of the same cluster, and of the same organization elsewhere.

    ``relation`` keeps the two lists apart. For the reports in ``anchors`` (a
    column ``id``), or for every report. Reports without a header have no
    relations.

    Of an organization the 40 newest reports suffice once no cluster keeps more
    than 20: leaving out the anchor's own cluster removes at most 20 of them.
    """
    headed = _headed(reports, header)
    placed = headed.filter(F.col("cluster_uuid").isNotNull() & F.col("organization").isNotNull())
    spread = _newest(placed, ["organization", "cluster_uuid"], RELATED_LIMIT)
    elsewhere = _as_lists(_newest(spread, ["organization"], 2 * RELATED_LIMIT), "organization", "in_org")
    rows = (
        _anchors(headed, anchors).join(_cluster_lists(headed), "cluster_uuid", "left")
        .join(elsewhere, "organization", "left")
    )
    own = F.coalesce("cluster_uuid", F.lit("None"))
    near = F.filter("in_cluster", lambda r: r["id"] != F.col("anchor_id"))
    far = F.filter("in_org", lambda r: (r["cluster_uuid"] != own) & (r["id"] != F.col("anchor_id")))
    both = F.array(
        F.struct(F.lit("same_cluster").alias("relation"), _top(near).alias("items")),
        F.struct(F.lit("same_org").alias("relation"), _top(far).alias("items")),
    )
    return _listed(rows.select("anchor_id", F.explode(both).alias("l")).select("anchor_id", "l.relation", "l.items"))


def cluster_or_organization(reports: DataFrame, header: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """The 20 newest other reports that share the cluster or the organization."""
    headed = _headed(reports, header)
    in_org = _newest(headed.filter(F.col("organization").isNotNull()), ["organization"], RELATED_LIMIT + 1)
    rows = (
        _anchors(headed, anchors).join(_cluster_lists(headed), "cluster_uuid", "left")
        .join(_as_lists(in_org, "organization", "in_org"), "organization", "left")
    )
    none = F.coalesce(F.slice("in_cluster", 1, 0), F.slice("in_org", 1, 0))
    either = F.array_distinct(F.concat(F.coalesce("in_cluster", none), F.coalesce("in_org", none)))
    others = F.filter(either, lambda r: r["id"] != F.col("anchor_id"))
    return _listed(rows.select("anchor_id", F.lit("either").alias("relation"), _top(_newest_first(others)).alias("items")))


# ---- node inventory -------------------------------------------------------

def node_info(reports: DataFrame, inventory: DataFrame) -> DataFrame:
    """Nodes of each report's bundle with placement and sizes."""
    wanted = reports.select("id", F.col("support_bundle_name").alias("support_bundle"))
    return wanted.join(inventory, "support_bundle").select(
        "id", "node_name", "state", "is_master", "is_tserver",
        placement(F.col("cloud"), F.col("region"), F.col("az")).alias("placement"),
        "num_cores", F.col("mem_size_gb").cast("double").alias("mem_size_gb"),
        F.col("volume_size_gb").cast("double").alias("volume_size_gb"),
    )


def node_table(nodes: DataFrame) -> DataFrame:
    """Display form: roles as Yes, No or blank."""
    return nodes.withColumns({c: yes_no(F.col(c)) for c in ("is_master", "is_tserver")})


# ---- report documents -----------------------------------------------------

def report_to_rows(reports: DataFrame, by: Sequence[str] = ("id",), json: str = "json_report") -> DataFrame:
    """Histogram rows of stored reports: one per (node, log type, pattern, minute)."""
    return _messages(reports, by, json).select(
        *by, "node_name", "log_type", "pattern", F.explode("m.histogram").alias("minute", "count")
    )


def report_to_stats(reports: DataFrame, by: Sequence[str] = ("id",), json: str = "json_report") -> DataFrame:
    """Statistics rows of stored reports: one per (node, log type, pattern)."""
    return _messages(reports, by, json).select(
        *by, "node_name", "log_type", "pattern", "m.count",
        parse_tolerant(F.col("m.StartTime")).alias("start_time"),
        parse_tolerant(F.col("m.EndTime")).alias("end_time"),
        F.col("m.solution").alias("solution"),
    )


def _messages(reports: DataFrame, by: Sequence[str], json: str) -> DataFrame:
    return (
        reports.select(*by, F.from_json(json, f"struct<nodes: {NODES}>").alias("d"))
        .select(*by, F.explode("d.nodes").alias("node_name", "_types"))
        .select(*by, "node_name", F.explode("_types").alias("log_type", "_t"))
        .select(*by, "node_name", "log_type", F.explode("_t.logMessages").alias("pattern", "m"))
    )


def _map_of(key: str, value: Column) -> Column:
    """Map in key order; values may be maps, which Spark cannot compare."""
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))), by_key))


def _known(df: DataFrame) -> DataFrame:
    return df.filter(F.col("node_name").isNotNull() & F.col("log_type").isNotNull())


def assemble_reports(
    stats: DataFrame,
    hist: DataFrame,
    longops: DataFrame | None = None,
    by: str = "support_bundle",
    pattern: str = "pattern",
    warnings: Sequence[dict] = (),
    config: dict | None = None,
    whole: bool = False,
) -> DataFrame:
    """Nested report documents as JSON from statistics and a histogram that are there already.

    The documents are those of ``assemble_from_minutes``, which needs one table and no join.
    """
    keys = [by, "node_name", "log_type", pattern]
    histograms = _known(hist).filter(F.col("minute").isNotNull()).groupBy(*keys).agg(_map_of("minute", F.col("count")).alias("histogram"))
    messages = null_safe_join(_known(stats), histograms, keys, "left")
    return _documents(messages, longops, by, pattern, warnings, config, whole)


def assemble_from_minutes(
    minutes: DataFrame,
    longops: DataFrame | None = None,
    by: str = "support_bundle",
    pattern: str = "pattern",
    warnings: Sequence[dict] = (),
    config: dict | None = None,
    whole: bool = False,
) -> DataFrame:
    """Nested report documents as JSON, in parts: one per ``by`` value, node and log type.

    ``minutes`` has a row per (``by``, node, log type, pattern, bucket) with count, start and end time: counts, times and
    histogram of a message come from one grouping of it. Each part is a complete report document of its own, whatever its size, and
    ``part`` names it. Long operations split the same way, by prefix. With
    ``whole`` there is one document per ``by`` value, and ``part`` is '': for a
    caller who has chosen one report. The size of a document follows patterns x
    minutes (a whole one: times nodes x log types), not the log volume. Hits
    without a time are in the counts but not in the histograms. Rows without a node or log type have no place in a document and
    are left out; a missing ``by`` value is one like others. The table may carry a ``solution`` column.
    """
    keys = [by, "node_name", "log_type", pattern] + [c for c in ("solution",) if c in minutes.columns]
    point = F.when(F.col("bucket").isNotNull(), F.struct(minute_key(F.col("bucket")).alias("k"), F.col("count").alias("v")))
    points = F.array_sort(F.collect_list(point))
    messages = _known(minutes).groupBy(*keys).agg(
        F.sum("count").alias("count"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.when(F.size(points) > 0, F.map_from_entries(points)).alias("histogram"))
    return _documents(messages, longops, by, pattern, warnings, config, whole)


def _documents(messages: DataFrame, longops: DataFrame | None, by: str, pattern: str, warnings, config, whole: bool) -> DataFrame:
    """Documents from one row per message with its count, times and histogram."""
    named = lambda *parts: F.lit("") if whole else F.concat_ws("/", *parts)
    solution = F.col("solution") if "solution" in messages.columns else F.lit(None).cast("string")
    messages = messages.select(
        by, "node_name", "log_type", pattern,
        named("node_name", "log_type").alias("part"),
        F.struct(
            iso_second(F.col("start_time")).alias("StartTime"), iso_second(F.col("end_time")).alias("EndTime"),
            F.col("count"), F.col("histogram"), solution.alias("solution"),
        ).alias("_m"),
    )
    types = messages.groupBy(by, "part", "node_name", "log_type").agg(
        _map_of(pattern, F.col("_m")).alias("_messages")
    ).withColumn("_t", F.struct(
        F.col("node_name").alias("node"), F.col("log_type").alias("logType"), F.col("_messages").alias("logMessages")))
    nodes = types.groupBy(by, "part", "node_name").agg(_map_of("log_type", F.col("_t")).alias("_types"))
    docs = nodes.groupBy(by, "part").agg(_map_of("node_name", F.col("_types")).alias("nodes"))
    fields = [
        F.col(by).alias("support_bundle_name"),
        F.coalesce("nodes", F.from_json(F.lit("{}"), NODES)).alias("nodes"),
        F.array(*[F.struct(*[F.lit(str(v)).alias(k) for k, v in w.items()]) for w in warnings]).alias("warnings"),
        F.struct(*[F.lit(str(v)).alias(k) for k, v in (config or {"analysis_type": "parquet"}).items()])
        .alias("analysis_config"),
    ]
    if longops is not None:
        placed = longops.withColumn("part", named(F.lit("long operations"), "prefix"))
        docs = null_safe_join(docs, long_operation_maps(placed, by, "part"), [by, "part"], "full")
        fields.append(F.col("long_operations"))
    return docs.select(by, "part", F.to_json(F.struct(*fields)).alias("json_report"))


def long_operation_maps(longops: DataFrame, *by: str) -> DataFrame:
    """Long operations of each report as ``{prefix: {bucket: {c, avg, max}}}``."""
    point = F.struct("c", "avg", "max")
    prefixes = longops.groupBy(*by, "prefix").agg(_map_of("bucket", point).alias("_points"))
    return prefixes.groupBy(*by).agg(_map_of("prefix", F.col("_points")).alias("long_operations"))


def long_operations_of(reports: DataFrame, by: Sequence[str] = ("id",), json: str = "json_report") -> DataFrame:
    """The stored long operations of each report as JSON text, ``{}`` when it has none."""
    held = F.try_variant_get(F.try_parse_json(F.col(json)), "$.long_operations", "variant")
    return reports.select(*by, F.coalesce(F.to_json(held), F.lit("{}")).alias("long_operations"))
