"""Queries over the report catalogue and report documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from bundlelens.adapters import SQL, with_views
from bundlelens.functions.timestamps import iso_second, listing_minute
from bundlelens.operators import longops, match, reports, series
from bundlelens.plans import log_queries, longop_queries
from bundlelens.plans.registry import query
from bundlelens.session import shared_dir
from bundlelens.sources import lookup, store

_BASE = with_views("reports", "bundle_header")
_JOINED = _BASE + """, joined AS (
    SELECT r.*, h.cluster_name, h.organization, h.cluster_uuid, h.case_id
    FROM reports r LEFT JOIN bundle_header h ON r.support_bundle_name = h.support_bundle)"""
_ROW = """id, support_bundle_name, coalesce(cluster_name, '') AS universe_name,
    coalesce(organization, '') AS organization_name, case_id, strftime(created_at, '%Y-%m-%d %H:%M') AS created_at"""
_SEARCH = """id ILIKE '%{q}%' OR support_bundle_name ILIKE '%{q}%' OR cluster_name ILIKE '%{q}%'
    OR organization ILIKE '%{q}%' OR CAST(case_id AS VARCHAR) ILIKE '%{q}%'"""


@query("reports_with_header", _JOINED + "SELECT " + _ROW + " FROM joined")
def reports_with_header(v):
    """J4, S17, P18"""
    return reports.listing_row(reports.with_header(v.reports(), v.bundle_header()))


@query("augmented_reports", _JOINED + """
    SELECT id, support_bundle_name, cluster_name, cluster_name AS universe_name,
      coalesce(own_organization, organization) AS organization, organization AS organization_name,
      CAST(case_id AS VARCHAR) AS case_id FROM joined""")
def augmented_reports(v):
    """Fields of the document, else of the header"""
    return reports.augmented_reports(v.reports(), v.bundle_header()).drop("json_report")


@query("report_page", _JOINED + "SELECT " + _ROW + " FROM joined ORDER BY joined.created_at DESC, id LIMIT 10 OFFSET 20")
def report_page(v):
    """O1: third page of ten"""
    return reports.list_reports(v.reports(), v.bundle_header(), page=3, per_page=10)


@query("report_page_count", _JOINED + """
    SELECT count(*) AS total_reports, CAST(greatest(ceil(count(*) / 10.0), 1) AS BIGINT) AS total_pages FROM joined""")
def report_page_count(v):
    """A17"""
    return reports.page_count(v.reports(), v.bundle_header(), 10)


@query("report_search", _JOINED + "SELECT " + _ROW + " FROM joined WHERE " + _SEARCH.format(q="nation_1"))
def report_search(v):
    """'_' is a wildcard"""
    return reports.listing_row(reports.search_reports(v.reports(), v.bundle_header(), " nation_1 "))


@query("report_search_page", _JOINED + "SELECT " + _ROW + " FROM joined WHERE " + _SEARCH.format(q="77")
       + " ORDER BY joined.created_at DESC, id LIMIT 25 OFFSET 25")
def report_search_page(v):
    """F11, O1"""
    return reports.list_reports(v.reports(), v.bundle_header(), page=2, per_page=25, query="77")


@query("report_search_count", _JOINED + """
    SELECT count(*) AS total_reports, CAST(greatest(ceil(count(*) / 25.0), 1) AS BIGINT) AS total_pages
    FROM joined WHERE """ + _SEARCH.format(q="77"))
def report_search_count(v):
    """F11, A17"""
    return reports.page_count(v.reports(), v.bundle_header(), 25, "77")


@query("latest_reports", _BASE + """
    SELECT support_bundle_name, arg_max(id, (created_at, id)) AS id FROM reports GROUP BY support_bundle_name""")
def latest_reports(v):
    """W3"""
    return reports.latest_reports(v.reports())


def _related_sql(condition: str, relation: str) -> str:
    return f"""
    SELECT anchor_id, '{relation}' AS relation, id, support_bundle_name, cluster_name, organization, cluster_uuid, case_id,
      strftime(made, '%Y-%m-%d %H:%M') AS created_at
    FROM (SELECT a.id AS anchor_id, r.id, r.support_bundle_name, r.cluster_name, r.organization, r.cluster_uuid, r.case_id,
            r.created_at AS made, row_number() OVER (PARTITION BY a.id ORDER BY r.created_at DESC, r.id) AS rank
          FROM headed a JOIN headed r ON {condition} WHERE r.id <> a.id)
    WHERE rank <= 20"""


_HEADED = _BASE + """, headed AS (
    SELECT r.id, r.created_at, r.support_bundle_name, h.cluster_name, h.organization, h.cluster_uuid, h.case_id
    FROM reports r JOIN bundle_header h ON r.support_bundle_name = h.support_bundle)"""


@query("related_reports", _HEADED + _related_sql("r.cluster_uuid = a.cluster_uuid", "same_cluster") + " UNION ALL "
       + _related_sql("r.organization = a.organization AND r.cluster_uuid <> a.cluster_uuid", "same_org"))
def related_reports(v):
    """J5, J6, O2, U7 for every report"""
    return reports.related_reports(v.reports(), v.bundle_header())


@query("cluster_or_organization", _HEADED + _related_sql(
    "r.organization = a.organization OR r.cluster_uuid = a.cluster_uuid", "either"))
def cluster_or_organization(v):
    """J7 for every report"""
    return reports.cluster_or_organization(v.reports(), v.bundle_header())


_NODES = with_views("reports", "node_inventory") + """, nodes AS (
    SELECT r.id, node_name, state, is_master, is_tserver, cloud || '.' || region || '.' || az AS placement, num_cores,
      CAST(mem_size_gb AS DOUBLE) AS mem_size_gb, CAST(volume_size_gb AS DOUBLE) AS volume_size_gb
    FROM reports r JOIN node_inventory i ON i.support_bundle = r.support_bundle_name)"""


@query("node_info", _NODES + "SELECT * FROM nodes")
def node_info(v):
    """J14, P16"""
    return reports.node_info(v.reports(), v.node_inventory())


@query("node_table", _NODES + """
    SELECT * REPLACE (CASE WHEN is_master IS NULL THEN '' WHEN is_master THEN 'Yes' ELSE 'No' END AS is_master,
      CASE WHEN is_tserver IS NULL THEN '' WHEN is_tserver THEN 'Yes' ELSE 'No' END AS is_tserver) FROM nodes""")
def node_table(v):
    """P27"""
    return reports.node_table(reports.node_info(v.reports(), v.node_inventory()))


# ---- documents ------------------------------------------------------------

def documents(v, whole=False):
    """Report documents: one per bundle, node and log type, or whole bundles."""
    by = ["support_bundle"]
    return reports.assemble_from_minutes(
        match.name_patterns(log_queries.minutes(v, by), log_queries.PATTERNS, ["pattern"]), longop_queries.ops(v, by),
        warnings=[{"message": "All patterns were run over the stored logs", "level": "info", "type": "parquet_analysis"}],
        whole=whole)


_BUNDLE_HIST = log_queries.LOOSE_HITS + f"""
    SELECT support_bundle, node_name, log_type, pattern, {log_queries.MINUTE} AS minute, count(*) AS "count"
    FROM hits GROUP BY ALL"""


@query("report_documents_histogram", _BUNDLE_HIST)
def report_documents_histogram(v):
    """Documents assembled, saved as JSON, loaded and flattened"""
    path = shared_dir(v.spark, "documents")
    store.save_documents(documents(v), path)
    return reports.report_to_rows(store.load_documents(v.spark, path), ["support_bundle"])


@query("report_documents_in_parts", _BUNDLE_HIST)
def report_documents_in_parts(v):
    """M5: the parts hold the rows of the whole reports"""
    return reports.report_to_rows(documents(v), ["support_bundle"])


@query("report_documents_stats", log_queries.LOOSE_HITS + """
    SELECT support_bundle, node_name, log_type, pattern, count(*) AS "count",
      strftime(min("timestamp"), '%Y-%m-%dT%H:%M:%SZ') AS start_time, strftime(max("timestamp"), '%Y-%m-%dT%H:%M:%SZ') AS end_time
    FROM hits GROUP BY support_bundle, node_name, log_type, pattern""")
def report_documents_stats(v):
    """Statistics read back out of the documents"""
    rows = reports.report_to_stats(documents(v), ["support_bundle"]).drop("solution")
    return rows.withColumns({c: iso_second(F.col(c)) for c in ("start_time", "end_time")})


@query("report_documents_latest", log_queries.LOOSE_HITS + """
    SELECT support_bundle, strftime(date_trunc('minute', max("timestamp")), '%Y-%m-%dT%H:%M:00Z') AS latest
    FROM hits GROUP BY support_bundle""")
def report_documents_latest(v):
    """A8 on stored documents"""
    rows = reports.report_to_rows(documents(v), ["support_bundle"])
    return series.latest_bucket(rows, ["support_bundle"])


@query("report_documents_long_operations", longop_queries._LABELLED + """
    SELECT support_bundle, prefix, bucket, c, round("avg", 6) AS "avg", round("max", 6) AS "max" FROM bundle_ops""")
def report_documents_long_operations(v):
    """M10, M2"""
    held = reports.long_operations_of(documents(v), ["support_bundle"])
    again = held.select(
        "support_bundle", F.concat(F.lit('{"long_operations":'), "long_operations", F.lit("}")).alias("json_report"))
    rows = longops.stored_longops(again, ["support_bundle"])
    return rows.withColumns({"avg": F.round("avg", 6), "max": F.round("max", 6)})


# ---- store ----------------------------------------------------------------

@query("stored_reports", _BASE + """
    SELECT id, support_bundle_name, strftime(created_at, '%Y-%m-%d %H:%M') AS created_at FROM reports
    WHERE id <> (SELECT arg_max(id, (created_at, id)) FROM reports)""")
def stored_reports(v):
    """Reports appended, the newest one deleted, the store compacted and read"""
    root, compact = shared_dir(v.spark, "reports"), shared_dir(v.spark, "compact")
    rows = v.reports()
    store.append_reports(rows, root, bundle="support_bundle_name", created_at="created_at", partition="month")
    newest = rows.agg(F.max_by("id", F.struct("created_at", "id"))).first()[0]
    store.delete_report(v.spark, root, newest)
    store.compact_reports(v.spark, root, compact, partition="month")
    kept = store.read_reports(v.spark, compact)
    return kept.select("id", "support_bundle_name", listing_minute(F.col("created_at")).alias("created_at"))


@query("stored_documents", log_queries.LOOSE_HITS + f", log_events AS ({SQL['log_events']}), " + longop_queries.OPS + """
    , parts AS (
      SELECT DISTINCT support_bundle, node_name || '/' || log_type AS part FROM hits WHERE log_type IS NOT NULL
      UNION ALL SELECT DISTINCT support_bundle, 'long operations/' || prefix FROM bundle_ops)
    SELECT support_bundle AS support_bundle_name, count(*) AS documents, count(*) AS ids FROM parts GROUP BY support_bundle""")
def stored_documents(v):
    """S9 with new ids, one per document: how many there are of each bundle"""
    root = shared_dir(v.spark, "documents")
    store.append_reports(documents(v), root)
    return store.read_reports(v.spark, root).groupBy("support_bundle_name").agg(
        F.count("*").alias("documents"), F.count_distinct("id").alias("ids"))


@query("report_lookup", _BASE + """
    SELECT id, support_bundle_name, strftime(created_at, '%Y-%m-%d %H:%M') AS created_at FROM reports
    WHERE id IN (SELECT unnest([min(id), max(id)]) FROM reports)""")
def report_lookup(v):
    """two reports by id; the files that can't hold them are not opened"""
    root, rows = shared_dir(v.spark, "lookup"), v.reports()
    lookup.write_lookup(rows, root, rows_per_file=2_000)
    ids = rows.agg(F.min("id"), F.max("id")).first()
    found = lookup.find_reports(v.spark, root, *[i for i in ids if i is not None])
    return found.select("id", "support_bundle_name", listing_minute(F.col("created_at")).alias("created_at"))


@query("stored_catalogue", with_views("bundle_header", "bundle_flags", "node_inventory") + """
    SELECT 'headers' AS name, count(*) AS n, count(DISTINCT support_bundle) AS bundles FROM bundle_header
    UNION ALL SELECT 'flags', count(*), count(DISTINCT support_bundle) FROM bundle_flags
    UNION ALL SELECT 'nodes', count(*), count(DISTINCT support_bundle) FROM node_inventory""")
def stored_catalogue(v):
    """Headers, flags and nodes stored next to the reports and read with their schemas"""
    root = shared_dir(v.spark, "catalogue")
    for name, rows in (("headers", v.bundle_header()), ("flags", v.bundle_flags()), ("nodes", v.node_inventory())):
        rows.write.parquet(f"{root}/{name}")
    parts = [rows.agg(F.count("*").alias("n"), F.count_distinct("support_bundle").alias("bundles")).withColumn("name", F.lit(name))
             for name, rows in zip(("headers", "flags", "nodes"), store.read_catalogue(v.spark, root))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
