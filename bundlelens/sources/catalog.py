"""Pattern catalogue: sections of named regular expressions with advice."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

NO_SOLUTION = "No solution available for this log message."


@dataclass(frozen=True)
class Pattern:
    section: str
    name: str
    regex: str
    solution: str = NO_SOLUTION


# Section, name, regular expression. The order is the match order.
# The advice is this project's own wording.
DEFAULT_PATTERNS: tuple[Pattern, ...] = (
    Pattern("universe", "Soft memory limit exceeded",
            r"Soft memory limit exceeded",
            "Reads and writes are throttled above the soft memory limit. Harmless when rare."),
    Pattern("universe", "Number of aborted transactions not cleaned up on account of reaching size limits",
            r"Number of aborted transactions not cleaned up on account of reaching size limits",
            "Compact the tablets concerned."),
    Pattern("universe", "Long wait for safe op id",
            r"Long wait for safe op id",
            "Writes to disk are slow. Check the disk when this is frequent."),
    Pattern("universe", "SST files limit exceeded",
            r"SST files limit exceeded",
            "Compaction cannot keep up with the writes to a tablet."),
    Pattern("universe", "Operation memory consumption has exceeded its limit",
            r"Operation failed.*operation memory consumption.*has exceeded",
            "A hot tablet used up its memory for operations in flight. Spread the load."),
    Pattern("universe", "Too big clock skew is detected",
            r"Too big clock skew is detected",
            "Node clocks differ too much. Fix time synchronisation at once."),
    Pattern("universe", "Stopping writes because we have immutable memtables",
            r"Stopping writes because we have \d+ immutable memtables",
            "Memtables are not flushed as fast as they fill. Slow disk or hot tablet."),
    Pattern("universe", "UpdateConsensus requests dropped due to backpressure",
            r"UpdateConsensus request.*dropped due to backpressure",
            "The server is overloaded with replication requests, or holds too many tablets."),
    Pattern("universe", "Fail of leader detected",
            r"Fail of leader.*detected",
            "Followers stopped hearing from their leader."),
    Pattern("universe", "Could not locate the leader master",
            r"Could not locate the leader master",
            "Network trouble, or the masters cannot elect a leader. Matters when continuous."),
    Pattern("universe", "Logs have been garbage collected",
            r"logs.*have been garbage collected*",
            "Write-ahead segments a peer or consumer still needed are gone. Raise retention; rebuild the peer or stream."),
    Pattern("universe", "VoteRequest RPC timed out",
            r"VoteRequest.*timed out",
            "Voters did not answer in time. Check the network and load."),
    Pattern("universe", "VoteRequest RPC Connection reset by peer",
            r"VoteRequest.*Connection reset by peer",
            "Voters closed the connection before answering. Check the network and load."),
    Pattern("universe", "Call rejected due to memory pressure",
            r"Call rejected due to memory pressure",
            "The server refuses calls because it is short of memory."),
    Pattern("universe", "Unable to pick leader",
            r"Unable to pick leader",
            "No replica of the tablet is known as leader. Watch whether a new one appears."),
    Pattern("universe", "Time spent Fsync log took a long time",
            r"Time spent Fsync log took a long time",
            "Syncing the write-ahead log is slow. Compare user, system and real time."),
    Pattern("universe", "Time spent Append to log took a long time",
            r"Time spent Append to log took a long time",
            "Appending to the write-ahead log is slow. Check the disk."),
    Pattern("universe", "Table <table-id> is undergoing DDL verification",
            r"Table [a-f0-9]+ is undergoing DDL verification",
            "A schema change is still being verified."),
    Pattern("universe", "Snapshot Too Old Error in YSQL can occur due to prefetch pg_authid",
            r"pg_sys_table_prefetcher\.cc.*Sys table prefetching is enabled but table \{[^}]+\} was not prefetched",
            "A system table was read outside the prefetched set."),
    Pattern("universe", "Long time to resolve DNS for hostname",
            r"Long time to (resolve|resolse) DNS for [^ ]+",
            "Name resolution is slow. Check the DNS server."),
    Pattern("pg", "latch already owned by",
            r"latch already owned by",
            "A backend died without releasing its latch. Look for crashes and out-of-memory kills."),
    Pattern("pg", "connection reset by peer",
            r"connection reset by peer",
            "The client went away without closing its connection. Check clients and idle timeouts."),
    Pattern("pg", "database system is ready to accept connections",
            r"database system is ready to accept connections",
            "The database was started. Informational unless frequent."),
)

# Short names accepted for log types.
LOG_TYPE_ALIASES = {
    "pg": "postgres",
    "ts": "yb-tserver",
    "ms": "yb-master",
    "ybc": "yb-controller",
}


def _read_document(path: str) -> dict:
    with open(path, encoding="utf-8") as handle:
        if path.endswith((".yml", ".yaml")):
            try:
                import yaml
            except ImportError as exc:
                raise RuntimeError("reading a YAML catalogue needs PyYAML; use JSON") from exc
            return yaml.safe_load(handle)
        return json.load(handle)


def load_patterns(path: str | None = None, sections: Sequence[str] = ("universe", "pg")) -> list[Pattern]:
    """The catalogue of the named sections, in section order (a few dozen rows).

    A file maps each section to ``{"log_messages": [{"name", "pattern", "solution"}]}``.
    Blank patterns are left out.
    """
    if path is None:
        return [p for s in sections for p in DEFAULT_PATTERNS if p.section == s]
    document = _read_document(path)
    return [
        Pattern(section, entry["name"], entry["pattern"], entry.get("solution") or NO_SOLUTION)
        for section in sections
        for entry in (document.get(section) or {}).get("log_messages", [])
        if (entry.get("pattern") or "").strip()
    ]


def merge_sections(patterns: Iterable[Pattern]) -> list[Pattern]:
    """One pattern per name; a later one replaces an earlier one in its place."""
    by_name: dict[str, Pattern] = {}
    for pattern in patterns:
        by_name[pattern.name] = pattern
    return list(by_name.values())


def custom_patterns(patterns: str | Iterable[str], named: bool = True) -> list[Pattern]:
    """Patterns given by the user as a list or a comma-separated string.

    ``named`` gives them the names ``custom_pattern_<i>``; otherwise the regular
    expression is the name. Invalid ones are skipped with a warning.
    """
    items = patterns.split(",") if isinstance(patterns, str) else list(patterns)
    items = [item.strip() for item in items if item.strip()]
    valid = []
    for i, regex in enumerate(items):
        try:
            re.compile(regex, re.IGNORECASE)
        except re.error as exc:
            warnings.warn(f"skipping invalid pattern {regex!r}: {exc}", stacklevel=2)
            continue
        valid.append(Pattern("custom", f"custom_pattern_{i}" if named else regex, regex))
    return valid


def patterns_frame(spark: SparkSession, patterns: Sequence[Pattern]) -> DataFrame:
    """The catalogue as a table; ``pattern_id`` is the position in the list."""
    rows = [(i, p.section, p.name, p.regex, p.solution) for i, p in enumerate(patterns)]
    return spark.createDataFrame(
        rows, "pattern_id int, section string, pattern_name string, pattern string, solution string"
    )
