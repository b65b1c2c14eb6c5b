"""Matching messages against thousands of patterns through an index of required texts.

The one-scan form of ``operators.match`` tests every pattern on every message. Here each pattern is found by one gram (a run of
characters) that all its matches contain: the grams of a message meet the index by an equi-join, and only the few
patterns that share a gram with it run their regular expression. Patterns without such a text are tested on every message by
the one-scan form.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundlelens.operators.match import PG_LOG_TYPE, folded, java_regex, match_all, required_text
from bundlelens.sources.catalog import Pattern

SIZES = (6, 3)
"""Lengths of grams; a text takes the first it is long enough for."""
SIDE = 3
"""Characters on either side of a space in the grams of a text that has such a space: a message has far fewer of them than of others."""
JOINT = 2 * SIDE + 1
BROADCAST_ROWS = 50_000
"""Index rows (a gram, a regular expression) up to which the index is broadcast; a larger one is joined by a shuffle."""


def alternatives(regex: str) -> Iterator[str]:
    """The alternatives of a regular expression at top level."""
    depth, begin, i, in_class = 0, 0, 0, False
    while i < len(regex):
        char = regex[i]
        if char == "\\":
            i += 1
        elif in_class:
            in_class = char != "]" or regex[i - 1] == "["
        elif char == "[":
            in_class = True
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "|" and depth == 0:
            yield regex[begin:i]
            begin = i + 1
        i += 1
    yield regex[begin:]


def required_texts(regex: str) -> list[str] | None:
    """Texts of which every match contains at least one; None where there are no such texts of three characters or more."""
    texts = [required_text(part) for part in alternatives(regex)]
    if any(text is None or len(text) < min(SIZES) for text in texts):
        return None
    return list(dict.fromkeys(texts))


def _grams(text: str) -> list[str]:
    joints = [text[i - SIDE:i + SIDE + 1] for i in range(SIDE, len(text) - SIDE) if text[i] == " "]
    if joints:
        return joints
    size = next(n for n in SIZES if len(text) >= n)
    return [text[i:i + size] for i in range(len(text) - size + 1)]


def index_rows(patterns: Sequence[Pattern], frequency=None) -> tuple[list[tuple], list[int]]:
    """((gram, pattern, regex, section, text, earlier) for the index, positions of patterns without a required text).

    Of a text's grams the rarest is taken: by ``frequency`` (gram to number of messages), else by the number of patterns that share it.
    A pattern with several texts has a row for each; ``earlier`` is a regular expression for the texts of the rows before, which
    find the pattern first, or None.
    """
    texts = [required_texts(p.regex) for p in patterns]
    shared = Counter(gram for found in texts for text in found or () for gram in set(_grams(text)))
    rank = (lambda g: (frequency.get(g, 0), shared[g], g)) if frequency else (lambda g: (shared[g], g))
    rows, apart = [], []
    for i, (pattern, found) in enumerate(zip(patterns, texts)):
        if found is None:
            apart.append(i)
        for at, text in enumerate(found or ()):
            earlier = "|".join(re.escape(t) for t in found[:at]) or None
            rows.append((min(_grams(text), key=rank), i, pattern.regex, pattern.section, text, earlier))
    return rows, apart


def _message_grams(lowered: Column, sizes) -> Column:
    """The distinct grams of a text, all of it in one pass of a regular expression."""
    runs = [f".{{{SIDE}}} .{{{SIDE}}}" if n == JOINT else f".{{{n}}}" for n in sizes]
    found = [F.regexp_extract_all(lowered, F.lit(f"(?s)(?=({run}))"), F.lit(1)) for run in runs]
    return F.array_distinct(F.concat(*found) if len(found) > 1 else found[0])


def gram_frequency(logs: DataFrame, patterns: Sequence[Pattern], message: str = "message", classes: str = "ascii") -> dict[str, int]:
    """In how many messages each gram of the patterns' required texts occurs: one pass, one row per gram that occurs."""
    wanted = sorted({g for p in patterns for text in required_texts(p.regex) or () for g in _grams(text)})
    if not wanted:
        return {}
    index = logs.sparkSession.createDataFrame([(g,) for g in wanted], "gram string")
    index = F.broadcast(index) if len(wanted) <= BROADCAST_ROWS else index
    grams = logs.select(F.explode(_message_grams(folded(F.col(message), classes), sorted({len(g) for g in wanted}))).alias("gram"))
    return {row["gram"]: row["count"] for row in grams.join(index, "gram").groupBy("gram").count().collect()}


def _in_scope(scope: str, section: Column, log_type: str) -> Column:
    if scope == "all":
        return F.lit(True)
    if scope != "by_log_type":
        raise ValueError("scope is 'all' or 'by_log_type'")
    is_pg = F.coalesce(F.col(log_type) == PG_LOG_TYPE, F.lit(False))
    return (section == "custom") | (is_pg & (section == "pg")) | (~is_pg & (section != "pg"))


def match_all_indexed(
    logs: DataFrame,
    patterns: Sequence[Pattern],
    scope: str = "all",
    message: str = "message",
    log_type: str = "log_type",
    node: str | None = "node_name",
    classes: str = "ascii",
    frequency=None,
) -> DataFrame:
    """The rows of ``match_all``: one per message and matching pattern, with ``pattern_id`` added.

    The index holds one row per required text; it is broadcast while it is small, so messages stay where they are.
    """
    rows, apart = index_rows(patterns, frequency)
    parts = []
    if rows:
        parts.append(_through_index(logs.filter(F.col(node).isNotNull()) if node else logs, rows, scope, message, log_type, classes))
    if apart or not rows:
        one_scan = match_all(logs, [patterns[i] for i in apart], scope, message, log_type, node, classes)
        place = F.element_at(F.lit(apart), F.col("pattern_id") + 1) if apart else F.col("pattern_id")
        parts.append(one_scan.withColumn("pattern_id", place))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def _through_index(logs: DataFrame, rows, scope: str, message: str, log_type: str, classes: str) -> DataFrame:
    schema = "_key string, _id int, _regex string, _section string, _text string, _earlier string"
    index = logs.sparkSession.createDataFrame([(g, i, java_regex(r, classes), s, t, e) for g, i, r, s, t, e in rows], schema)
    index = F.broadcast(index) if len(rows) <= BROADCAST_ROWS else index
    lowered = F.col("_lowered")
    each = logs.withColumn("_lowered", folded(F.col(message), classes)).select(
        "*", F.explode(_message_grams(lowered, sorted({len(r[0]) for r in rows}))).alias("_gram"))
    # Cheap tests first: a regular expression is compiled for each message it is run on. No lambdas here: they
    # would take the join out of the generated code, and each gram would be written out with its message.
    confirmed = (_in_scope(scope, F.col("_section"), log_type) & F.contains(lowered, F.col("_text"))
                 & F.coalesce(~F.rlike(lowered, F.col("_earlier")), F.lit(True)) & F.rlike(F.col(message), F.col("_regex")))
    return each.join(index, F.col("_gram") == F.col("_key")).filter(confirmed).select(
        *[F.col(c) for c in logs.columns], F.col("_id").alias("pattern_id"))


def match_first_indexed(
    logs: DataFrame,
    patterns: Sequence[Pattern],
    scope: str = "by_log_type",
    message: str = "message",
    log_type: str = "log_type",
    classes: str = "unicode",
    frequency=None,
) -> DataFrame:
    """The rows of ``match_first``: each message with the first pattern, in catalogue order, that matches it.

    By log type, custom patterns come after those of the section. Only messages that match something are shuffled, by a
    row number.
    """
    numbered = logs.filter(F.col(message).rlike(r"\S")).withColumn("_at", F.monotonically_increasing_id())
    found = match_all_indexed(numbered, patterns, scope, message, log_type, None, classes, frequency)
    late = [p.section == "custom" and scope == "by_log_type" for p in patterns] or [False]
    order = F.struct(F.element_at(F.lit(late), F.col("pattern_id") + 1).alias("late"), F.col("pattern_id").alias("id"))
    row = F.struct(*[F.col(c) for c in logs.columns])
    return found.groupBy("_at").agg(F.min(order).alias("_first"), F.first(row).alias("_row")).select(
        "_row.*", F.col("_first.id").alias("pattern_id"))
