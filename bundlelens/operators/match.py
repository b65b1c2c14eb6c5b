"""Matching log messages against the pattern catalogue in one scan.

All patterns are literals of one expression, so the table is read once whatever
their number, and each regular expression is compiled once per task. Before a
regular expression runs, a plain substring test on the lower-cased message must
hold: the longest text every match contains. Most lines fail it for every
pattern and never reach the regex engine.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundlelens.sources.catalog import NO_SOLUTION, Pattern

# i: any case, u: beyond ASCII too, d: only \n ends a line. For raw lines U makes
# \d \w \s \b cover all of Unicode; for tables they are ASCII.
REGEX_FLAGS = {"ascii": "(?iud)", "unicode": "(?iUd)"}
_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_INSIDE = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"

PG_LOG_TYPE = "postgres"

# Patterns per array of tests; the arrays of a catalogue are joined, whatever its size.
GROUP = 40


def required_text(regex: str) -> str | None:
    """A lower-case ASCII text that every match must contain, or None.

    Only plain characters outside groups and classes count; anything the scan
    does not know ends the current run. Alternatives at top level, inline flags
    and unusual classes leave nothing to require.
    """
    if re.search(r"\(\?[a-zA-Z-]+[:)]|\[\^?\]", regex):
        return None
    runs, run, depth, i = [""], "", 0, 0
    while i < len(regex):
        char = regex[i]
        if char == "\\":
            literal = regex[i + 1:i + 2] if not regex[i + 1:i + 2].isalnum() else ""
            if not literal and regex[i + 1:i + 2] not in "dDsSwWbB":
                return None
            i += 2
        elif char == "[":
            end = regex.find("]", i + 2)
            if end < 0 or "\\" in regex[i:end] or "[" in regex[i + 1:end]:
                return None
            literal, i = "", end + 1
        elif char == "{":
            count = re.match(r"\{\d*,?\d*\}", regex[i:])
            if not count:
                return None
            literal, i = "", i + count.end()
        else:
            literal = char if char not in ".^$*+?|()" else ""
            if char == "|" and depth == 0:
                return None
            depth += {"(": 1, ")": -1}.get(char, 0)
            i += 1
        follower = regex[i:i + 1]
        if literal and depth == 0 and literal.isascii() and follower not in ("*", "?", "{"):
            run += literal
            if follower == "+":
                runs.append(run)
                run = ""
        else:
            runs.append(run)
            run = ""
    runs.append(run)
    return max(runs, key=len).lower() or None


def folded(message: Column, classes: str = "ascii") -> Column:
    """Lower case, with the other letters that fold to ASCII ones in the regex dialect."""
    text = F.replace(F.lower(message), F.lit("ſ"), F.lit("s"))
    if classes == "unicode":
        text = F.replace(F.replace(text, F.lit("ı"), F.lit("i")), F.lit("i\u0307"), F.lit("i"))
    return text


def java_regex(regex: str, classes: str = "ascii") -> str:
    """The pattern for Spark's regex engine, whose word edges are not ASCII by themselves."""
    if classes == "ascii":
        regex = re.sub(
            r"\\(.)", lambda m: {"b": _EDGE, "B": _INSIDE}.get(m.group(1), m.group(0)), regex, flags=re.DOTALL)
    return REGEX_FLAGS[classes] + regex


def matches(message: Column, lowered: Column, regex: str, classes: str = "ascii") -> Column:
    """Unanchored, case-insensitive regular-expression test; null messages do not match."""
    test = message.rlike(java_regex(regex, classes))
    text = required_text(regex)
    if text:
        test = lowered.contains(text) & test
    return F.coalesce(test, F.lit(False))


def _kept(tests: Sequence[Column]) -> Column:
    """The results of the tests as one array without -1."""
    groups = [F.array(*tests[at:at + GROUP]) for at in range(0, len(tests), GROUP)]
    return F.concat(*[F.array_remove(group, F.lit(-1)) for group in groups])


def _scopes(patterns: Sequence[Pattern], scope: str, log_type: str):
    """Condition and pattern positions of each pattern set."""
    everything = list(range(len(patterns)))
    if scope == "all":
        return [(F.lit(True), everything)]
    if scope != "by_log_type":
        raise ValueError("scope is 'all' or 'by_log_type'")
    custom = [i for i in everything if patterns[i].section == "custom"]
    pg = [i for i in everything if patterns[i].section == "pg"] + custom
    rest = [i for i in everything if patterns[i].section not in ("pg", "custom")] + custom
    is_pg = F.coalesce(F.col(log_type) == PG_LOG_TYPE, F.lit(False))
    return [(is_pg, pg), (~is_pg, rest)]


def match_all(
    logs: DataFrame,
    patterns: Sequence[Pattern],
    scope: str = "all",
    message: str = "message",
    log_type: str = "log_type",
    node: str | None = "node_name",
    classes: str = "ascii",
) -> DataFrame:
    """One row per message and matching pattern, with ``pattern_id`` added.

    Every pattern counts on its own. Rows without node are dropped; pass
    ``node=None`` to keep them.
    """
    lowered = F.col("_lowered")

    def hits(ids):
        tests = [
            F.when(matches(F.col(message), lowered, patterns[i].regex, classes), F.lit(i)).otherwise(F.lit(-1))
            for i in ids
        ]
        return _kept(tests) if tests else F.array().cast("array<int>")

    parts = _scopes(patterns, scope, log_type)
    found = hits(parts[0][1])
    if len(parts) > 1:
        found = F.when(parts[0][0], found).otherwise(hits(parts[1][1]))
    rows = logs.filter(F.col(node).isNotNull()) if node else logs
    return (
        rows.withColumn("_lowered", folded(F.col(message), classes))
        .select("*", F.explode(found).alias("pattern_id"))
        .drop("_lowered")
    )


def match_first(
    logs: DataFrame,
    patterns: Sequence[Pattern],
    scope: str = "by_log_type",
    message: str = "message",
    log_type: str = "log_type",
    classes: str = "unicode",
) -> DataFrame:
    """Each message with the first pattern, in catalogue order, that matches it.

    Blank messages and messages no pattern matches are dropped.
    """
    lowered = F.col("_lowered")

    def first(ids):
        tests = [F.when(matches(F.col(message), lowered, patterns[i].regex, classes), F.lit(i)) for i in ids]
        return F.coalesce(*tests) if tests else F.lit(None).cast("int")

    parts = _scopes(patterns, scope, log_type)
    found = first(parts[0][1])
    if len(parts) > 1:
        found = F.when(parts[0][0], found).otherwise(first(parts[1][1]))
    # The id leaves through a generator: a filter on it would be pushed below and
    # run the regular expressions twice.
    hit = _kept([F.coalesce(found, F.lit(-1))])
    return (
        logs.filter(F.col(message).rlike(r"\S"))
        .withColumn("_lowered", folded(F.col(message), classes))
        .select("*", F.explode(hit).alias("pattern_id"))
        .drop("_lowered")
    )


def name_patterns(df: DataFrame, patterns: Sequence[Pattern], columns=("pattern_name", "pattern")) -> DataFrame:
    """Replace ``pattern_id`` by columns of the catalogue, looked up in constant arrays (no join)."""
    values = {"section": "section", "pattern_name": "name", "pattern": "regex", "solution": "solution"}
    at = F.col("pattern_id") + 1
    named = {c: F.element_at(F.lit([getattr(p, values[c]) for p in patterns]), at) for c in columns}
    return df.withColumns(named).drop("pattern_id")


def hit_names(keys: DataFrame, patterns: Sequence[Pattern], key: str = "pattern") -> DataFrame:
    """The catalogue name of each stored pattern key, and its advice.

    A key equal to a pattern takes that pattern's name; otherwise the first
    pattern whose regular expression (case-sensitive) matches the key decides;
    otherwise the key is its own name. Names without advice get a default text.
    """
    by_regex = {p.regex: p.name for p in patterns}
    exact = F.coalesce(*[F.when(F.col(key) == regex, F.lit(name)) for regex, name in by_regex.items()])
    loose = F.coalesce(*[F.when(F.col(key).rlike("(?d)" + regex), F.lit(name)) for regex, name in by_regex.items()])
    advice = {p.name: p.solution for p in patterns}
    name = F.col("log_name")
    text = F.coalesce(*[F.when(name == n, F.lit(s)) for n, s in advice.items()], F.lit(NO_SOLUTION))
    return keys.withColumn("log_name", F.coalesce(exact, loose, F.col(key))).withColumn("solution", text)


def detected_names(keys: DataFrame, patterns: Sequence[Pattern], key: str = "pattern") -> DataFrame:
    """Distinct names among the stored keys, with their advice."""
    return hit_names(keys.select(key).distinct(), patterns, key).select("log_name", "solution").distinct()
