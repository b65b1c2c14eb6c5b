"""Queries over raw log text: lines, files, archives."""

from __future__ import annotations

import gzip
import io
import tarfile

import pandas as pd
from pyspark.sql import functions as F

from bundlelens.adapters import REFERENCE_YEAR, with_views
from bundlelens.functions import paths
from bundlelens.functions.timestamps import iso_second, second_text
from bundlelens.operators import files, logstats, match
from bundlelens.plans.log_queries import PATTERNS, _catalogue
from bundlelens.plans.registry import query
from bundlelens.session import shared_dir, written
from bundlelens.sources import archives, probe, text

_YEAR = REFERENCE_YEAR
# Lines as parsed: year-less lines have minute precision, stray ones no known node.
_LINES = with_views("log_events") + """, lines AS (
    SELECT event_id, support_bundle, message, log_type, coalesce('yb-demo-' || node_name, 'unknown') AS node_name,
      CASE log_type WHEN 'postgres' THEN 'INFO' WHEN 'yb-master' THEN 'WARN' ELSE 'ERROR' END AS sub_type,
      '/' || support_bundle || '/' || coalesce('yb-demo-' || node_name, 'stray') || '/' ||
        CASE log_type WHEN 'postgres' THEN 'postgresql.log' WHEN 'yb-master' THEN 'yb-master.WARNING.log'
          ELSE 'yb-tserver.ERROR.log.1' END AS file_path,
      CASE log_type WHEN 'postgres' THEN "timestamp" ELSE date_trunc('minute', "timestamp") END AS ts
    FROM log_events)"""
_FIRST = _LINES + ", " + _catalogue(PATTERNS) + """, first_hits AS (
    SELECT event_id, support_bundle, node_name, log_type, file_path, ts, arg_min(pattern_name, ord) AS pattern_name
    FROM lines JOIN patterns ON section = CASE WHEN log_type = 'postgres' THEN 'pg' ELSE 'universe' END
      AND regexp_matches(message, '(?i)' || pattern)
    GROUP BY ALL)"""
_STATS = """
    SELECT node_name, log_type, pattern_name, count(*) AS "count", strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS start_time,
      strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS end_time
    FROM first_hits {where} GROUP BY node_name, log_type, pattern_name"""


def parsed(v):
    return files.parse_lines(v.numbered_lines(), _YEAR)


def line_stats(lines, by=()):
    """Statistics of raw lines: the first pattern of the line's section, per node and log type."""
    found = match.match_first(lines, PATTERNS, message="line")
    rows = logstats.pattern_stats(logstats.minute_stats(found, by), by)
    named = match.name_patterns(rows, PATTERNS, ["pattern_name"])
    return named.withColumns({c: iso_second(F.col(c)) for c in ("start_time", "end_time")})


@query("parsed_lines", _LINES + """
    SELECT event_id, file_path, node_name, log_type, sub_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM lines""")
def parsed_lines(v):
    """P1, P2, P3, P4"""
    return files.with_file_facts(parsed(v)).select(
        "event_id", "file_path", "node_name", "log_type", "sub_type", second_text(F.col("timestamp")).alias("at"))


@query("log_files", _LINES + """
    SELECT file_path, any_value(node_name) AS node_name, any_value(log_type) AS log_type, any_value(sub_type) AS sub_type,
      strftime(arg_min(ts, event_id), '%Y-%m-%d %H:%M:%S') AS start_time,
      strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS end_time, count(*) AS lines
    FROM lines GROUP BY file_path""")
def log_files(v):
    """A19, W5"""
    rows = files.valid_files(files.log_files(parsed(v)))
    return rows.select("file_path", "node_name", "log_type", "sub_type", second_text(F.col("start_time")).alias("start_time"),
                       second_text(F.col("end_time")).alias("end_time"), "lines")


_FILES = """, spans AS (
    SELECT file_path, support_bundle, any_value(node_name) AS node_name, any_value(log_type) AS log_type,
      any_value(sub_type) AS sub_type, arg_min(ts, event_id) AS start_time, arg_max(ts, event_id) AS end_time
    FROM lines GROUP BY file_path, support_bundle)"""
_RANGE = "TIMESTAMP '2024-01-10 00:00:00'", "TIMESTAMP '2024-01-11 12:00:00'"


@query("pruned_files", _LINES + _FILES + f"""
    SELECT file_path FROM spans WHERE start_time <= {_RANGE[1]} AND end_time >= {_RANGE[0]}""")
def pruned_files(v):
    """F2"""
    return files.prune_files(files.log_files(parsed(v)), "2024-01-10 00:00:00", "2024-01-11 12:00:00").select("file_path")


@query("file_metadata", _LINES + _FILES + """
    SELECT support_bundle, node_name, log_type, sub_type, file_path,
      strftime(start_time, '%Y-%m-%d %H:%M:%S') AS "logStartsAt", strftime(end_time, '%Y-%m-%d %H:%M:%S') AS "logEndsAt"
    FROM spans""")
def file_metadata(v):
    """S16"""
    by = ["support_bundle"]
    return files.file_metadata(files.log_files(parsed(v), by), by)


@query("bundle_counts", _LINES + _FILES + """
    SELECT support_bundle, count(*) AS files, count(DISTINCT node_name) AS nodes, count(DISTINCT log_type) AS log_types
    FROM spans GROUP BY support_bundle""")
def bundle_counts(v):
    """A20"""
    by = ["support_bundle"]
    return files.bundle_counts(files.log_files(parsed(v), by), by)


@query("bundle_members", _LINES + "SELECT DISTINCT support_bundle, node_name, log_type FROM lines")
def bundle_members(v):
    """Nodes and log types by name"""
    by = ["support_bundle"]
    return files.bundle_members(files.log_files(parsed(v), by), by)


@query("line_stats", _FIRST + _STATS.format(where=f"WHERE ts BETWEEN {_RANGE[0]} AND {_RANGE[1]}"))
def line_stats_in_range(v):
    """Raw lines of the files that overlap the range"""
    lines = parsed(v)
    kept = written(files.prune_files(files.log_files(lines), "2024-01-10 00:00:00", "2024-01-11 12:00:00"), "files")
    chosen = logstats.filter_logs(files.lines_of(lines, kept), "2024-01-10 00:00:00", "2024-01-11 12:00:00")
    return line_stats(chosen)


@query("text_file_stats", _FIRST + _STATS.format(where=""))
def text_file_stats(v):
    """Lines written as gzip text files, discovered, read and matched"""
    root = shared_dir(v.spark, "text")
    rows = v.log_lines().select(
        "line", F.coalesce(F.nullif(F.regexp_extract("file_path", "/(yb-demo-[^/]+)/", 1), F.lit("")), F.lit("stray"))
        .alias("node"), paths.file_name(F.col("file_path")).alias("name"))
    rows.hint("rebalance", "node", "name").write.partitionBy("node", "name").option("compression", "gzip").text(root)
    # Spark names its files itself, so the folder stands for the log file.
    lines = text.read_log_lines(v.spark, root, servers=None).withColumn(
        "file_path", F.regexp_replace(F.regexp_replace("file_path", "/part-[^/]*$", ""), "/(node|name)=", "/"))
    lines = files.parse_lines(lines.filter(paths.is_log_file(F.col("file_path"))), _YEAR)
    return line_stats(files.with_file_facts(lines))


def _as_text(v):
    """The log files as plain text below one folder, a file each, lines in order."""
    root = shared_dir(v.spark, "plain")
    rows = v.log_lines().select(
        "event_id", "support_bundle", F.split_part("file_path", F.lit("/"), F.lit(3)).alias("node"),
        paths.file_name(F.col("file_path")).alias("name"), "line")
    places = ["support_bundle", "node", "name"]
    rows.repartition(*places).sortWithinPartitions(*places, "event_id").drop("event_id").write.partitionBy(*places).text(root)
    return root


def _log_path(column):
    """The path of the log file that a folder of Spark's writer stands for."""
    folder = F.regexp_extract(column, "support_bundle=([^/]*)/node=([^/]*)/name=([^/]*)/", 0)
    return F.concat(F.lit("/"), F.regexp_replace(F.rtrim(folder, F.lit("/")), "(support_bundle|node|name)=", ""))


@query("probed_files", _LINES + _FILES + """
    SELECT file_path, node_name, log_type, sub_type, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time,
      strftime(end_time, '%Y-%m-%d %H:%M:%S') AS end_time FROM spans""")
def probed_files(v):
    """The time range of each text file from its two ends, the file itself unread"""
    found = probe.probe_files(v.spark, _as_text(v), _YEAR, servers=None)
    named = files.with_file_facts(files.valid_files(found).withColumn("file_path", _log_path(F.col("file_path"))))
    return named.select("file_path", "node_name", "log_type", "sub_type", second_text(F.col("start_time")).alias("start_time"),
                        second_text(F.col("end_time")).alias("end_time"))


@query("probed_line_stats", _FIRST + _STATS.format(where=f"WHERE ts BETWEEN {_RANGE[0]} AND {_RANGE[1]}"))
def probed_line_stats(v):
    """Only the text files whose range overlaps are read"""
    bounds = "2024-01-10 00:00:00", "2024-01-11 12:00:00"
    kept = files.prune_files(probe.probe_files(v.spark, _as_text(v), _YEAR, servers=None), *bounds)
    lines = probe.read_files(v.spark, kept).withColumn("file_path", _log_path(F.col("file_path")))
    parsed_lines = files.with_file_facts(files.parse_lines(lines, _YEAR))
    return line_stats(logstats.filter_logs(parsed_lines, *bounds))


def _pack(batches):
    """One archive per Arrow batch: a nested archive of gzip log files, and a broken one."""
    def member(tar, name, data):
        info = tarfile.TarInfo(name)
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))

    def archive(members):
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w:gz", compresslevel=1) as tar:
            for name, data in members:
                member(tar, name, data)
        return buffer.getvalue()

    for pdf in batches:
        logs = [
            (f"{path.split('/')[2]}/{path.rsplit('/', 1)[1]}.gz", gzip.compress(("\n".join(group["line"]) + "\n").encode(), 1))
            for path, group in pdf.groupby("file_path")
        ]
        whole = archive([("nodes/inner.tar.gz", archive(logs)), ("nodes/broken.tgz", b"not an archive"),
                         ("nodes/notes.txt", b"I0101 10:00:00.1 Soft memory limit exceeded")])
        yield pd.DataFrame({"path": ["bundle.tar.gz"], "content": [whole]})


@query("archive_stats", _FIRST + _STATS.format(where=""))
def archive_stats(v):
    """Nested archives read in place and kept as Parquet, what is broken put aside"""
    packed = v.log_lines().select("file_path", "line").mapInPandas(_pack, "path string, content binary")
    root = shared_dir(v.spark, "lines")
    archives.explode_archives(packed).write.parquet(root)
    lines = archives.good_lines(v.spark.read.parquet(root))
    return line_stats(files.with_file_facts(files.parse_lines(lines, _YEAR)))


def _pack_day(pdf):
    """The lines of one bundle and day as an archive with a broken member."""
    made = next(_pack(iter([pdf])))
    made["path"] = f"{pdf['support_bundle'].iloc[0]}-{pdf['day'].iloc[0]}.tar.gz"
    return made


@query("archive_rejects", _LINES + """
    SELECT DISTINCT support_bundle || '-' || strftime(e.ts, '%Y-%m-%d') AS bundle, true AS rejected, 'broken.tgz' AS member
    FROM lines JOIN events e USING (event_id)""")
def archive_rejects(v):
    """One archive per bundle and day, each with a broken member: every one of them is a reject"""
    days = v.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    lines = v.log_lines().join(days, "event_id").select("support_bundle", "day", "file_path", "line")
    packed = lines.groupBy("support_bundle", "day").applyInPandas(_pack_day, "path string, content binary")
    found = archives.rejects(archives.explode_archives(packed))
    return found.groupBy("bundle", "file_path").agg((F.count("*") == 1).alias("rejected")).select(
        "bundle", "rejected", paths.file_name(F.col("file_path")).alias("member"))
