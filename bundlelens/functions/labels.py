"""Labels of long operations, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The phrases beside which a label stands.
LONG_TIME, LONG, SPENT = "took a long time", "took a long", "Time spent"


def _near(message: Column, place: str) -> Column:
    """The two words at a place, or the one that is there; ``%s`` marks where the words stand."""
    found = [F.regexp_extract(message, place % rf"(\S+(?:\s+\S+){{{more}}})", 1) for more in (1, 0)]
    return F.trim(F.coalesce(*[F.nullif(words, F.lit("")) for words in found]))


def is_candidate(message: Column, *measures: Column) -> Column:
    """Messages about a long operation that carry a measure (case-sensitive)."""
    return F.coalesce(*measures).isNotNull() & (
        message.contains(LONG) | message.startswith(SPENT)
    )


def operation_label(message: Column) -> Column:
    """Up to two words before 'took a long [time]', else up to two after a leading 'Time spent'."""
    ended = F.when(message.contains(LONG_TIME), _near(message, rf"%s\s+{LONG_TIME}")).when(
        message.contains(LONG), _near(message, rf"%s\s+{LONG}"))
    return F.coalesce(ended, F.when(message.startswith(SPENT), _near(message, rf"{SPENT}\s+%s")))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_label(label: Column) -> Column:
    """Without ids in parentheses and without closing ':' or ';'; may become ''."""
    bare = _strip(F.regexp_replace(_strip(label), r"\([^)]+\)", ""))
    return _strip(F.regexp_replace(bare, r"[:;]+$", ""))


def display_label(label: Column) -> Column:
    """Without a closing 'took a long'."""
    return _strip(F.regexp_replace(label, r"(?i)\s+took a long\s*$", ""))
