"""Queries over log tables: matching, statistics, series."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from bundlelens.adapters import with_views
from bundlelens.functions.timestamps import iso_second
from bundlelens.operators import logstats, match, pattern_index, series
from bundlelens.plans.registry import query
from bundlelens.sources import catalog, logs

PATTERNS = catalog.load_patterns()
# Patterns for the prose tables: plain words, digits, classes, alternatives.
PROSE = [
    catalog.Pattern("custom", regex, regex)
    for regex in (r"licen[sc]e", r"\d+", r"all rights reserved|copyright", r"[a-z0-9._]+@[a-z0-9.]+", r"\bque\b", r"ÉTION")
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _catalogue(patterns) -> str:
    rows = ", ".join(
        f"({i}, {_quoted(p.section)}, {_quoted(p.name)}, {_quoted(p.regex)}, {_quoted(p.solution)})"
        for i, p in enumerate(patterns)
    )
    return f"patterns(ord, section, pattern_name, pattern, solution) AS (VALUES {rows})"


def _hits_by_scan(patterns, source: str, columns: str) -> str:
    """One scan per literal pattern, as an analyst would write it."""
    return "hits AS (" + " UNION ALL ".join(
        f"SELECT {columns}, {i} AS ord, {_quoted(p.name)} AS pattern_name, {_quoted(p.regex)} AS pattern FROM {source} "
        f"WHERE node_name IS NOT NULL AND regexp_matches(message, {_quoted('(?i)' + p.regex)})"
        for i, p in enumerate(patterns)
    ) + ")"


EVENTS = with_views("log_events")
_HIT_COLUMNS = 'event_id, node_name, log_type, support_bundle, "timestamp"'
HITS = EVENTS + ", " + _hits_by_scan(PATTERNS, "log_events", _HIT_COLUMNS)
# Hits of which some have no bundle: for what is shaped per bundle.
BY = ["support_bundle"]
LOOSE_HITS = with_views("loose_events") + ", " + _hits_by_scan(PATTERNS, "loose_events", _HIT_COLUMNS)
MINUTE = "strftime(\"timestamp\", '%Y-%m-%dT%H:%M:00Z')"
HIST = HITS + f""", hist AS (
    SELECT node_name, log_type, pattern, {MINUTE} AS minute, date_trunc('minute', "timestamp") AS bucket,
      count(*) AS "count"
    FROM hits GROUP BY ALL)"""


def hits(v, keep=("event_id", "support_bundle")):
    """Hits of all events; those shaped by bundle include some without one."""
    events = v.loose_events() if list(keep) == BY else v.log_events()
    return match.match_all(events.select("timestamp", "node_name", "log_type", "message", *keep), PATTERNS)


def minutes(v, by=()):
    return logstats.minute_stats(hits(v, keep=by), by)


def histogram(v, by=()):
    return match.name_patterns(logstats.minute_histogram(minutes(v, by), by), PATTERNS, ["pattern"])


def stats(v, by=()):
    return match.name_patterns(logstats.hit_stats(hits(v, keep=by), by), PATTERNS)


def _timed(df):
    return df.withColumns({c: iso_second(F.col(c)) for c in ("start_time", "end_time")})


@query("log_scan", EVENTS + """
    SELECT event_id, strftime("timestamp", '%Y-%m-%dT%H:%M:%SZ') AS at, node_name, log_type, support_bundle, message,
      long_op_value, timing_real_value FROM log_events""")
def log_scan(v):
    """S1"""
    return v.log_events().select(
        "event_id", iso_second(F.col("timestamp")).alias("at"), "node_name", "log_type", "support_bundle", "message",
        "long_op_value", "timing_real_value")


@query("bundle_probe", EVENTS + "SELECT min(support_bundle) AS bundle_name FROM log_events")
def bundle_probe(v):
    """S2"""
    return logs.bundle_name(v.log_events(), v.sf_dir)


@query("pattern_hits", HITS + "SELECT event_id, node_name, log_type, pattern_name, pattern FROM hits")
def pattern_hits(v):
    """Every matching pattern of every message"""
    return match.name_patterns(hits(v).select("event_id", "node_name", "log_type", "pattern_id"), PATTERNS)


_SCOPED = EVENTS + ", " + _catalogue(PATTERNS) + """, scoped AS (
    SELECT event_id, node_name, log_type, ord, pattern_name FROM log_events JOIN patterns
      ON section = CASE WHEN log_type = 'postgres' THEN 'pg' ELSE 'universe' END
     AND regexp_matches(message, '(?i)' || pattern))"""


@query("pattern_hits_by_log_type", _SCOPED + """
    SELECT event_id, node_name, log_type, pattern_name FROM scoped WHERE node_name IS NOT NULL""")
def pattern_hits_by_log_type(v):
    """Postgres logs meet the pg section, all others the universe section"""
    found = match.match_all(v.log_events().select("event_id", "node_name", "log_type", "message"), PATTERNS, "by_log_type")
    return match.name_patterns(found.drop("message"), PATTERNS, ["pattern_name"])


@query("first_match", _SCOPED + """
    SELECT event_id, node_name, log_type, arg_min(pattern_name, ord) AS pattern_name FROM scoped
    GROUP BY event_id, node_name, log_type""")
def first_match(v):
    """The first pattern in catalogue order"""
    found = match.match_first(v.log_events().select("event_id", "node_name", "log_type", "message"), PATTERNS)
    return match.name_patterns(found.drop("message"), PATTERNS, ["pattern_name"])


@query("pattern_stats", HITS + """
    SELECT node_name, log_type, pattern_name, pattern, count(*) AS "count",
      strftime(min("timestamp"), '%Y-%m-%dT%H:%M:%SZ') AS start_time,
      strftime(max("timestamp"), '%Y-%m-%dT%H:%M:%SZ') AS end_time
    FROM hits GROUP BY node_name, log_type, pattern_name, pattern""")
def pattern_stats(v):
    """A1"""
    return _timed(stats(v))


@query("minute_histogram", HIST + """SELECT node_name, log_type, pattern, minute, "count" FROM hist""")
def minute_histogram(v):
    """A2, P5"""
    return histogram(v)


@query("merged_stats", HITS + """
    SELECT node_name, log_type, pattern_name, pattern, count(*) AS "count",
      strftime(min("timestamp"), '%Y-%m-%dT%H:%M:%SZ') AS start_time,
      strftime(max("timestamp"), '%Y-%m-%dT%H:%M:%SZ') AS end_time
    FROM hits GROUP BY node_name, log_type, pattern_name, pattern""")
def merged_stats(v):
    """A3: statistics per bundle, merged"""
    return _timed(logstats.merge_stats(stats(v, BY)))


@query("merged_histogram", HIST + """SELECT node_name, log_type, pattern, minute, "count" FROM hist""")
def merged_histogram(v):
    """A3: histograms per bundle, merged key by key"""
    return logstats.merge_histograms(histogram(v, BY), pattern=["pattern"])


@query("hit_table", LOOSE_HITS + """
    SELECT support_bundle, node_name, log_type, pattern AS message,
      strftime(min("timestamp"), '%Y-%m-%dT%H:%M:%SZ') AS first_occurrence,
      strftime(max("timestamp"), '%Y-%m-%dT%H:%M:%SZ') AS last_occurrence, count(*) AS "count"
    FROM hits GROUP BY support_bundle, node_name, log_type, pattern""")
def hit_table(v):
    """P26, P17, per bundle"""
    return logstats.hit_table(stats(v, BY), BY)


@query("filtered_stats", HITS + """
    SELECT node_name, log_type, pattern, count(*) AS "count" FROM hits
    WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'
      AND node_name IN ('n1', 'n4') AND log_type IN ('postgres', 'yb-tserver', 'odd')
    GROUP BY node_name, log_type, pattern""")
def filtered_stats(v):
    """time range, nodes, log types by alias"""
    rows = logstats.filter_logs(
        v.log_events(), "2024-01-08 00:00:00", "2024-01-20 12:00:00", ["N1", "n4"], ["pg", "ts", "odd"])
    found = logstats.minute_stats(match.match_all(rows, PATTERNS))
    return match.name_patterns(logstats.pattern_stats(found), PATTERNS, ["pattern"]).select(
        "node_name", "log_type", "pattern", "count")


_PROSE_HITS = "WITH docs AS (SELECT doc_id, text AS message, source AS node_name, lang AS log_type FROM documents), " + \
    _hits_by_scan(PROSE, "docs", "doc_id, node_name, log_type")


@query("prose_pattern_counts", _PROSE_HITS + """
    SELECT node_name, log_type, pattern, count(*) AS "count" FROM hits GROUP BY node_name, log_type, pattern""")
def prose_pattern_counts(v):
    """J1, P23 on whole prose texts with the caller's patterns"""
    found = match.match_all(v.documents(), PROSE).groupBy("node_name", "log_type", "pattern_id").agg(
        F.count("*").alias("count"))
    return match.name_patterns(found, PROSE, ["pattern"])


with warnings.catch_warnings():  # the list holds an invalid pattern on purpose
    warnings.simplefilter("ignore")
    CUSTOM = catalog.custom_patterns("took a long, vote.*reset , (broken, LEADER .* detected")


@query("custom_pattern_stats", EVENTS + ", " + _hits_by_scan(CUSTOM, "log_events", "event_id, node_name, log_type") + """
    SELECT node_name, log_type, pattern_name, count(*) AS "count" FROM hits GROUP BY node_name, log_type, pattern_name""")
def custom_pattern_stats(v):
    """A comma list, its invalid entry skipped"""
    found = match.match_all(v.log_events(), CUSTOM).groupBy("node_name", "log_type", "pattern_id").agg(
        F.count("*").alias("count"))
    return match.name_patterns(found, CUSTOM, ["pattern_name"])


_PHRASES = """WITH wanted AS (
    SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,} [a-z]{3,}')) AS phrase FROM benchmark)"""


def _phrase_patterns(v):
    """Pairs of words of the benchmark as patterns: thousands of them."""
    pairs = v.table("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,} [a-z]{3,}"), F.lit(0))).alias("phrase"))
    return [catalog.Pattern("custom", r["phrase"], r["phrase"] + r"\w*") for r in pairs.distinct().orderBy("phrase").collect()]


@query("indexed_pattern_counts", _PHRASES + """
    SELECT source AS node_name, lang AS log_type, phrase AS pattern_name, count(*) AS "count"
    FROM documents JOIN wanted ON contains(lower(text), phrase) WHERE source IS NOT NULL GROUP BY ALL""")
def indexed_pattern_counts(v):
    """J1 for a large catalogue: whole prose texts through the index of required texts"""
    patterns = _phrase_patterns(v)
    found = pattern_index.match_all_indexed(v.documents(), patterns)
    counts = found.groupBy("node_name", "log_type", "pattern_id").agg(F.count("*").alias("count"))
    return match.name_patterns(counts, patterns, ["pattern_name"])


@query("indexed_first_match", _SCOPED + """
    SELECT event_id, node_name, log_type, arg_min(pattern_name, ord) AS pattern_name FROM scoped
    GROUP BY event_id, node_name, log_type""")
def indexed_first_match(v):
    """J2, J3, F9 through the index"""
    found = pattern_index.match_first_indexed(v.log_events().select("event_id", "node_name", "log_type", "message"), PATTERNS)
    return match.name_patterns(found.drop("message"), PATTERNS, ["pattern_name"])


@query("hit_solutions", HITS + ", " + _catalogue(PATTERNS) + """
    , keys AS (SELECT DISTINCT pattern AS k FROM hits UNION SELECT DISTINCT message FROM log_events),
    loose AS (SELECT k, arg_min(pattern_name, ord) AS n FROM keys JOIN patterns ON regexp_matches(k, pattern) GROUP BY k),
    named AS (SELECT k AS pattern, coalesce(p.pattern_name, l.n, k) AS log_name
              FROM keys LEFT JOIN patterns p ON p.pattern = k LEFT JOIN loose l USING (k))
    SELECT named.pattern, log_name, coalesce(s.solution, """ + _quoted(catalog.NO_SOLUTION) + """) AS solution
    FROM named LEFT JOIN patterns s ON s.pattern_name = log_name""")
def hit_solutions(v):
    """Exact pattern, else first pattern that matches the key, else the key itself"""
    keys = stats(v).select("pattern").union(v.log_events().select("message")).distinct()
    return match.hit_names(keys, PATTERNS)


@query("detected_names", HITS + "SELECT DISTINCT pattern_name AS log_name FROM hits")
def detected_names(v):
    """A21"""
    return match.detected_names(stats(v), PATTERNS).select("log_name")


# ---- series ---------------------------------------------------------------

def _rebucket_sql(interval: int, where: str) -> str:
    return HIST + f""", bounds AS (SELECT max(bucket) AS hi FROM hist)
    SELECT node_name, log_type, pattern,
      strftime(time_bucket(INTERVAL '{interval} minutes', bucket), '%Y-%m-%dT%H:%M:00Z') AS minute,
      CAST(sum("count") AS BIGINT) AS "count"
    FROM hist, bounds WHERE {where} GROUP BY ALL"""


@query("rebucket_60", _rebucket_sql(60, "bucket BETWEEN hi - INTERVAL 7 DAY AND hi"))
def rebucket_60(v):
    """Default range, hourly buckets"""
    return series.rebucket(histogram(v), 60)


@query("rebucket_15", _rebucket_sql(15, "bucket BETWEEN TIMESTAMP '2024-01-05 06:30:00' AND hi"))
def rebucket_15(v):
    """Given start, default end"""
    return series.rebucket(histogram(v), 15, start="2024-01-05T06:30:00Z")


@query("rebucket_30_explicit",
       _rebucket_sql(30, "bucket BETWEEN TIMESTAMP '2024-01-05 06:30:00' AND TIMESTAMP '2024-01-15 00:00:00'"))
def rebucket_30_explicit(v):
    """Both bounds given"""
    return series.rebucket(histogram(v), 30, "2024-01-05T06:30:00Z", "2024-01-15T00:00:00Z")


@query("rebucket_by_bundle", LOOSE_HITS + """, hist AS (
      SELECT support_bundle, node_name, log_type, pattern, date_trunc('minute', "timestamp") AS bucket, count(*) AS n
      FROM hits GROUP BY ALL),
    bounds AS (SELECT support_bundle, max(bucket) AS hi FROM hist GROUP BY support_bundle)
    SELECT support_bundle, node_name, log_type, pattern,
      strftime(time_bucket(INTERVAL '60 minutes', bucket), '%Y-%m-%dT%H:%M:00Z') AS minute, CAST(sum(n) AS BIGINT) AS "count"
    FROM hist JOIN (SELECT support_bundle AS of_bundle, hi FROM bounds) ON support_bundle IS NOT DISTINCT FROM of_bundle
    WHERE bucket BETWEEN hi - INTERVAL 7 DAY AND hi GROUP BY ALL""")
def rebucket_by_bundle(v):
    """A7, F14 for many reports at once, each with its own range"""
    return series.rebucket(histogram(v, BY), 60, by=BY)


@query("latest_bucket", LOOSE_HITS + """
    SELECT support_bundle, strftime(date_trunc('minute', max("timestamp")), '%Y-%m-%dT%H:%M:00Z') AS latest
    FROM hits GROUP BY support_bundle""")
def latest_bucket(v):
    """A8 per bundle"""
    return series.latest_bucket(histogram(v, BY), BY)


def _quick_sql(back: str) -> str:
    return HIST + f""", bounds AS (SELECT max(bucket) AS hi FROM hist)
    SELECT node_name, log_type, pattern, minute, "count" FROM hist, bounds
    WHERE bucket BETWEEN hi - INTERVAL '{back}' AND hi"""


@query("quick_range_12h", _quick_sql("12 hours"))
def quick_range_12h(v):
    """F16"""
    return series.quick_range(histogram(v), "12h").drop("bucket")


@query("quick_range_1d", _quick_sql("24 hours"))
def quick_range_1d(v):
    """F16"""
    return series.quick_range(histogram(v), "1d").drop("bucket")


@query("quick_range_3_days", _quick_sql("2 days"))
def quick_range_3_days(v):
    """F16: three days counted inclusively"""
    return series.quick_range(histogram(v), "3d").drop("bucket")


@query("quick_range_by_bundle", LOOSE_HITS + f""", hist AS (
      SELECT support_bundle, node_name, log_type, pattern, {MINUTE} AS minute, date_trunc('minute', "timestamp") AS bucket, count(*) AS "count"
      FROM hits GROUP BY ALL)
    SELECT support_bundle, node_name, log_type, pattern, minute, "count" FROM hist
    QUALIFY bucket BETWEEN max(bucket) OVER (PARTITION BY support_bundle) - INTERVAL 4 DAY AND max(bucket) OVER (PARTITION BY support_bundle)""")
def quick_range_by_bundle(v):
    """F16 for many reports at once: five days of each, counted inclusively"""
    return series.quick_range(histogram(v, BY), "5d", BY).drop("bucket")


@query("message_totals", HIST + """
    SELECT pattern, minute, CAST(sum("count") AS BIGINT) AS "count" FROM hist
    WHERE node_name = 'n2' AND log_type = 'yb-tserver' GROUP BY pattern, minute""")
def message_totals(v):
    """A13, F15"""
    return series.message_totals(histogram(v), "n2", "yb-tserver")


@query("node_series", HIST + """
    SELECT pattern, node_name, minute, CAST(sum("count") AS BIGINT) AS "count" FROM hist
    GROUP BY pattern, node_name, minute""")
def node_series(v):
    """A14"""
    return series.node_series(histogram(v), "all")


@query("gap_filled_totals", HIST + """, slots AS (
      SELECT pattern, time_bucket(INTERVAL '60 minutes', bucket) AS slot, sum("count") AS n FROM hist GROUP BY ALL),
    spine AS (SELECT unnest(generate_series(min(slot), max(slot), INTERVAL '60 minutes')) AS slot FROM slots),
    names AS (SELECT DISTINCT pattern FROM slots)
    SELECT names.pattern, strftime(spine.slot, '%Y-%m-%dT%H:%M:00Z') AS minute, CAST(coalesce(n, 0) AS BIGINT) AS "count"
    FROM names CROSS JOIN spine LEFT JOIN slots ON slots.pattern = names.pattern AND slots.slot = spine.slot""")
def gap_filled_totals(v):
    """Hourly totals of all days, zeros where a pattern has none"""
    hourly = series.rebucket(histogram(v), 60, start="all")
    return series.fill_gaps(series.message_totals(hourly), 60)


@query("gap_filled_nodes", LOOSE_HITS + """, slots AS (
      SELECT support_bundle, pattern, node_name, time_bucket(INTERVAL '60 minutes', "timestamp") AS slot, count(*) AS n
      FROM hits GROUP BY ALL),
    bounds AS (SELECT support_bundle, unnest(generate_series(min(slot), max(slot), INTERVAL '60 minutes')) AS slot
               FROM slots GROUP BY support_bundle),
    names AS (SELECT DISTINCT support_bundle, pattern, node_name FROM slots)
    SELECT names.support_bundle, names.pattern, names.node_name, strftime(b.slot, '%Y-%m-%dT%H:%M:00Z') AS minute,
      CAST(coalesce(n, 0) AS BIGINT) AS "count"
    FROM names JOIN bounds b ON b.support_bundle IS NOT DISTINCT FROM names.support_bundle
    LEFT JOIN slots s ON s.support_bundle IS NOT DISTINCT FROM names.support_bundle AND s.pattern = names.pattern
      AND s.node_name = names.node_name AND s.slot = b.slot""")
def gap_filled_nodes(v):
    """J17 per bundle and node, each bundle on its own axis"""
    by = BY
    hourly = series.rebucket(histogram(v, by), 60, start="all", by=by)
    return series.fill_gaps(series.node_series(hourly, by=by), 60, by, ["pattern", "node_name"])


@query("axis_buckets", HIST + "SELECT DISTINCT minute FROM hist")
def axis_buckets(v):
    """U8, O8"""
    return series.axis_values(histogram(v), "minute")


@query("axis_nodes", LOOSE_HITS + "SELECT DISTINCT support_bundle, node_name FROM hits")
def axis_nodes(v):
    """U8 per bundle"""
    return series.axis_values(histogram(v, BY), "node_name", BY)
