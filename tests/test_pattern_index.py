"""The indexed matcher against the one-scan matcher and against plain regular expressions."""

import random
import re

import pytest

from bundlelens.operators import match, pattern_index
from bundlelens.sources import catalog
from bundlelens.sources.catalog import Pattern
from tests.conftest import rows

SECTIONS = ("universe", "pg", "custom")
REGEXES = [r"took a long", r"vote.*reset", r"\d+ rows", r"license|copyright|all rights reserved", r"a|timed out", r"(abc|def)ghi", r"x?yz",
           r"Soft memory", r"[a-z]+@mail", r"ÉTION", r"\bque\b", r"^start of", r"end$", r"a{2}bcd", r"wal-\d+\.log", r"(?i)flag", r"ab", r"reset by peer",
           r"reset by peer|vote", r"\(at 8\d%\)", r"straſse", r"kelvin"]


@pytest.fixture
def logs(spark):
    dice = random.Random(4)
    words = ["UpdateReplica", "took", "a", "long", "time", "Vote", "reset", "by", "peer", "12", "rows", "License", "COPYRIGHT", "yz", "xyz", "abcghi",
             "soft MEMORY", "me@mail", "étion", "ÉTION", "que", "question", "start", "of", "end", "aabcd", "wal-7.log", "flag", "timed out", "(at 85%)", "straSSe",
             "Kelvin", "ſtart of", "all rights reserved", "\n"]
    messages = [" ".join(dice.choices(words, k=dice.randint(0, 9))) for _ in range(600)] + [None, "", " ", "took a long " * 4000 + "me@mail"]
    data = [(i, dice.choice(["n1", "n2", None]), dice.choice(["postgres", "yb-tserver", None]), m) for i, m in enumerate(messages)]
    return spark.createDataFrame(data, "i int, node_name string, log_type string, message string").repartition(3)


def some_patterns(n):
    dice = random.Random(n)
    found = [Pattern(SECTIONS[i % 3], f"p{i}", r) for i, r in enumerate(REGEXES)]
    while len(found) < n:
        found.append(Pattern(dice.choice(SECTIONS), f"p{len(found)}", dice.choice(["took", "reset", "flag", "rights"]) + dice.choice([" ", ".", r"\s"]) + f"word{len(found)}"))
    return found


@pytest.mark.parametrize("scope", ["all", "by_log_type"])
@pytest.mark.parametrize("limit", [50_000, 3])
def test_same_rows_as_one_scan(spark, logs, scope, limit, monkeypatch):
    monkeypatch.setattr(pattern_index, "BROADCAST_ROWS", limit)
    patterns = some_patterns(60)
    one = match.match_all(logs, patterns, scope)
    assert rows(pattern_index.match_all_indexed(logs, patterns, scope), "i", "pattern_id") == rows(one, "i", "pattern_id")
    loose = match.match_all(logs, patterns, scope, node=None)
    frequency = pattern_index.gram_frequency(logs, patterns)
    assert rows(pattern_index.match_all_indexed(logs, patterns, scope, node=None, frequency=frequency), "i", "pattern_id") == rows(loose, "i", "pattern_id")
    first = match.match_first(logs, patterns, scope)
    found = pattern_index.match_first_indexed(logs, patterns, scope)
    assert found.columns == first.columns and rows(found, "i", "pattern_id") == rows(first, "i", "pattern_id")


def test_default_catalogue(spark, logs):
    patterns = catalog.load_patterns()
    assert rows(pattern_index.match_all_indexed(logs, patterns), "i", "pattern_id") == rows(match.match_all(logs, patterns), "i", "pattern_id")
    assert pattern_index.match_all_indexed(logs, []).count() == 0
    assert pattern_index.match_all_indexed(logs.filter("false"), patterns).count() == 0


def test_five_thousand_patterns(spark):
    dice = random.Random(9)
    syllables = ["ta", "ro", "mi", "ken", "sol", "vu", "pra", "est"]
    word = lambda: "".join(dice.choices(syllables, k=dice.randint(2, 4)))
    patterns = [Pattern("custom", f"p{i}", dice.choice([r"{0}\s+{1}", "{0} {1}", r"\b{0}.{{0,5}}{1}", "{0}{1}x?"]).format(word(), word())) for i in range(5000)]
    messages = [" ".join(word() for _ in range(dice.randint(1, 40))) for _ in range(400)]
    logs = spark.createDataFrame([(i, "n", "t", m) for i, m in enumerate(messages)], "i int, node_name string, log_type string, message string")
    compiled = [re.compile(p.regex, re.IGNORECASE) for p in patterns]
    expected = sorted((i, k) for i, m in enumerate(messages) for k, c in enumerate(compiled) if c.search(m))
    found = pattern_index.match_all_indexed(logs, patterns)
    assert sorted(map(tuple, found.select("i", "pattern_id").collect())) == expected and len(expected) > 500


def test_index_rows():
    texts = pattern_index.required_texts
    assert texts("license|copyright") == ["license", "copyright"] and texts("a|copyright") is None and texts(r"[|]abcd") == ["abcd"]
    assert texts(r"(a|b)cdef\|gh") == ["cdef|gh"] and texts("(?i)abcd") is None
    found, apart = pattern_index.index_rows([Pattern("custom", "p", r) for r in ("license fee", "license plate", "xy", "abcx|abcy")])
    assert apart == [2] and [r[1] for r in found] == [0, 1, 3, 3] and found[0][0] != found[1][0] and (found[2][5], found[3][5]) == (None, "abcx")
    rare, _ = pattern_index.index_rows([Pattern("custom", "p", "abcdefgh")], {"abcdef": 5, "bcdefg": 1, "cdefgh": 9})
    assert rare[0][0] == "bcdefg"
