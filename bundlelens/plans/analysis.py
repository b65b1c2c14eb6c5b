"""Whole analyses: Parquet logs, raw bundles, tablet reports.

Each reads its input once, writes what several results need to the shared
folder, and returns DataFrames; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.operators import files, logstats, longops, match, reports, tablets
from bundlelens.session import written
from bundlelens.sources import archives, probe, tablet_reports
from bundlelens.sources.catalog import Pattern, custom_patterns, load_patterns
from bundlelens.sources.logs import read_logs

DEFAULT_DAYS = 30


@dataclass(frozen=True)
class Request:
    """What to analyse; empty fields mean everything."""

    start: datetime | None = None
    end: datetime | None = None
    nodes: Sequence[str] = ()
    log_types: Sequence[str] = ()
    patterns: Sequence[str] = ()

    def __post_init__(self):
        if self.start and self.end and self.start > self.end:
            raise ValueError("start must not be after end")

    def warnings(self) -> list[dict]:
        """A note for the report when it does not cover everything."""
        used = {"node_filter": self.nodes, "log_type_filter": self.log_types, "histogram_mode": self.patterns}
        used = [f"{name}: {list(value)}" for name, value in used.items() if value]
        if not used:
            return []
        return [{
            "message": "The request chose a part of the logs or patterns; what lies outside it is not in these results.",
            "additional_details": f"Chosen: {'; '.join(used)}",
            "level": "info", "type": "custom_options",
        }]

    def config(self) -> dict:
        shown = lambda t: t.isoformat() if t else None
        return {
            "start_time": shown(self.start), "end_time": shown(self.end), "node_filter": list(self.nodes),
            "log_type_filter": list(self.log_types), "histogram_mode": list(self.patterns),
        }


def time_bounds(
    start: str | None, end: str | None, reference_year: int, now: datetime, days: int = DEFAULT_DAYS
) -> tuple[datetime, datetime]:
    """Bounds given as ``MMDD HH:MM`` in the reference year; by default the last 30 days."""
    read = lambda text: datetime.strptime(f"{reference_year:04d}{text}", "%Y%m%d %H:%M")
    return read(start) if start else now - timedelta(days=days), read(end) if end else now


@dataclass(frozen=True)
class LogAnalysis:
    """Results keyed by ``support_bundle``."""

    stats: DataFrame
    histogram: DataFrame
    long_operations: DataFrame | None
    request: Request
    pattern: str
    rejected: DataFrame | None = None
    """Files without a time, or whose times run backwards; dated lines of the latter are matched all the same."""

    def documents(self, whole: bool = False) -> DataFrame:
        """Report documents per bundle, node and log type, or one per bundle."""
        return reports.assemble_reports(
            self.stats, self.histogram, self.long_operations, pattern=self.pattern,
            warnings=self.request.warnings(), config=self.request.config(), whole=whole)


def _results(hits: DataFrame, patterns, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Statistics and histogram from one pass over the hits."""
    by = ["support_bundle"]
    minutes = written(logstats.minute_stats(hits, by), "minutes")
    stats = match.name_patterns(logstats.pattern_stats(minutes, by), patterns, ["pattern_name", "pattern", "solution"])
    return stats, match.name_patterns(logstats.minute_histogram(minutes, by), patterns, [pattern])


def analyze_parquet(
    spark: SparkSession, path: str, patterns: Sequence[Pattern] | None = None, request: Request = Request()
) -> LogAnalysis:
    """Every pattern against every message of the Parquet logs in a folder that the request covers.

    Time range, nodes and log types reach the scan. The logs are read twice: for the patterns and, with other columns, for the
    long operations.
    """
    if patterns is None:
        patterns = custom_patterns(request.patterns) if request.patterns else load_patterns()
    logs = logstats.filter_logs(read_logs(spark, path), request.start, request.end, request.nodes, request.log_types)
    hits = match.match_all(logs.select("support_bundle", "node_name", "log_type", "timestamp", "message"), patterns)
    stats, histogram = _results(hits, patterns, "pattern")
    return LogAnalysis(stats, histogram, longops.long_operations(logs, ["support_bundle"]), request, "pattern")


def analyze_lines(lines: DataFrame, reference_year: int, request: Request = Request()) -> LogAnalysis:
    """The first matching pattern of every raw line.

    ``lines`` has ``support_bundle`` and the columns of ``operators.files``. It is
    read twice, for the files' time ranges and for the lines, so it should
    be a stored table.
    """
    by = ["support_bundle"]
    patterns = custom_patterns(request.patterns) if request.patterns else load_patterns()
    parsed = files.parse_lines(lines, reference_year)
    found = files.log_files(parsed, by)
    found = written(found, "files")
    kept = files.valid_files(found)
    if request.start is not None and request.end is not None:
        kept = files.prune_files(found, request.start, request.end)
    rejected = found.filter(F.col("rejected").isNotNull())
    kept = kept.unionByName(rejected.filter(F.col("start_time").isNotNull()))
    kept = logstats.filter_logs(kept, nodes=request.nodes, log_types=request.log_types)
    chosen = logstats.filter_logs(files.lines_of(parsed, kept, by), request.start, request.end)
    stats, histogram = _results(match.match_first(chosen, patterns, message="line"), patterns, "pattern_name")
    return LogAnalysis(stats, histogram, None, request, "pattern_name", rejected)


def analyze_text(
    spark: SparkSession, path: str, reference_year: int, request: Request = Request(), bundle: str | None = None
) -> LogAnalysis:
    """The first matching pattern of every line of the log files below a folder, one bundle.

    Times come from the ends of the files, so files outside the range, or of other nodes and log types, are not read.
    """
    patterns = custom_patterns(request.patterns) if request.patterns else load_patterns()
    found = written(probe.probe_files(spark, path, reference_year), "files")
    rejected = found.filter(F.col("rejected").isNotNull())
    kept = files.valid_files(found)
    if request.start is not None and request.end is not None:
        kept = files.prune_files(found, request.start, request.end)
    kept = kept.unionByName(rejected.filter(F.col("start_time").isNotNull()))
    kept = written(logstats.filter_logs(kept, nodes=request.nodes, log_types=request.log_types), "kept")
    lines = files.parse_lines(probe.read_files(spark, kept), reference_year)
    name = bundle or path.rstrip("/").rsplit("/", 1)[-1]
    chosen = logstats.filter_logs(files.lines_of(lines, kept), request.start, request.end).withColumn("support_bundle", F.lit(name))
    stats, histogram = _results(match.match_first(chosen, patterns, message="line"), patterns, "pattern_name")
    return LogAnalysis(stats, histogram, None, request, "pattern_name", rejected)


def analyze_bundles(
    spark: SparkSession, path: str, reference_year: int, request: Request = Request()
) -> tuple[LogAnalysis, DataFrame]:
    """All archives below a folder; also returns the rejects."""
    ingested = written(archives.ingest_archives(spark, path), "lines")
    lines = archives.good_lines(ingested).withColumnRenamed("bundle", "support_bundle")
    return analyze_lines(lines, reference_year, request), archives.rejects(ingested)


@dataclass(frozen=True)
class TabletAnalysis:
    """The four tables keyed by ``bundle``, and the files that were left out."""

    cluster: DataFrame
    tablets: DataFrame
    tableinfo: DataFrame
    zones: DataFrame
    rejects: DataFrame


def analyze_tablet_reports(spark: SparkSession, root: str) -> TabletAnalysis:
    """The tablet reports of all bundles below a folder."""
    by = ["bundle"]
    servers = written(
        tablet_reports.tservers(tablet_reports.read_details(spark, root), tablet_reports.read_entities(spark, root))
        .drop("uptime"), "cluster")
    listed = tablet_reports.list_report_files(spark, root)
    entries = written(tablet_reports.scan_report_files(spark, root), "entries")
    replicas = written(tablet_reports.tablets(entries, servers), "tablets")
    unmatched = tablet_reports.unmatched_files(listed, servers).withColumn("error", F.lit("no node has this file's name"))
    bad = entries.filter(F.col("error").isNotNull()).select("bundle", "file_name", "error")
    return TabletAnalysis(
        servers, replicas,
        tablets.table_info(replicas, by, file="file_name", pos="pos"),
        tablets.zone_replicas(replicas, servers, by),
        unmatched.unionByName(bad),
    )
