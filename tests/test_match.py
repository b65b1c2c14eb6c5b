import random
import re
import warnings

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from bundlelens.operators import match
from bundlelens.sources import catalog
from bundlelens.sources.catalog import Pattern
from tests.conftest import rows

PATTERNS = catalog.load_patterns()


def logs(spark, *messages, log_type="yb-tserver", node="n1"):
    return spark.createDataFrame(
        [(i, node, log_type, m) for i, m in enumerate(messages)], "i int, node_name string, log_type string, message string")


def names(df, patterns=PATTERNS):
    return [r[1] for r in rows(match.name_patterns(df, patterns), "i", "pattern_name")]


def test_catalogue_has_both_sections():
    assert [p.section for p in PATTERNS].count("universe") == 20
    assert [p.section for p in PATTERNS].count("pg") == 3
    assert len({p.name for p in PATTERNS}) == 23


def test_backslash_pattern(spark):
    df = match.match_all(logs(spark, "Stopping writes because we have 2 immutable memtables"), PATTERNS)
    assert names(df) == ["Stopping writes because we have immutable memtables"]


def test_any_case(spark):
    assert names(match.match_all(logs(spark, "FAIL OF LEADER p1 DETECTED"), PATTERNS)) == ["Fail of leader detected"]


def test_several_hits_and_first_hit(spark):
    line = "VoteRequest to p1 timed out, VoteRequest Connection reset by peer"
    assert names(match.match_all(logs(spark, line), PATTERNS)) == [
        "VoteRequest RPC Connection reset by peer", "VoteRequest RPC timed out", "connection reset by peer"]
    assert names(match.match_first(logs(spark, line), PATTERNS)) == ["VoteRequest RPC timed out"]
    pg = logs(spark, line, log_type="postgres")
    assert names(match.match_first(pg, PATTERNS)) == ["connection reset by peer"]
    assert names(match.match_all(pg, PATTERNS, scope="by_log_type")) == ["connection reset by peer"]


def test_blank_null_and_nodeless_rows_are_dropped(spark):
    anything = [Pattern("custom", "any", r".*")]
    assert names(match.match_all(logs(spark, " ", None), PATTERNS)) == []
    assert names(match.match_first(logs(spark, " ", "\t", "", None), anything), anything) == []
    assert names(match.match_all(logs(spark, "Soft memory limit exceeded", node=None), PATTERNS)) == []
    assert len(names(match.match_all(logs(spark, "Soft memory limit exceeded", node=None), PATTERNS, node=None))) == 1


@pytest.mark.parametrize("regex, message, hit", [
    ("a.b", "a\rb", True), ("a.b", "a b", True), ("a.b", "a\nb", False),
    ("ÉA", "éa", True), ("soft", "ſoft", True), ("kilo", "Kilo", True),
    (r"\bque\b", "qué", False), (r"\bque\b", "équeé", True), (r"\Bx", "ax", True), (r"\Bx", "éx", False),
    ("a|zzz", "zzz", True), ("colou?r", "color", True), ("ab{0,1}c", "ac", True), ("x*yes", "yes", True),
    ("(?x) a b", "ab", True), ("[^]]z", "az", True), (r"a\.b", "a.b", True), (r"a\.b", "axb", False), ("", "x", True),
])
def test_regex_dialect(spark, regex, message, hit):
    pattern = [Pattern("custom", "p", regex)]
    assert names(match.match_all(logs(spark, message), pattern), pattern) == (["p"] if hit else [])


@given(st.lists(st.sampled_from(
    ["a", "b", "X", ".", ".*", "a+", "b?", "(a|b)", "[ab]", "[^a]", r"\d", r"\.", "a{2}", "a{0,1}", "X{2,}", "(?:ab)*", "(a(b|X))", "[^]a]", "$", "^", r"\b", "|", " "]), min_size=1, max_size=7))
@example(["a", "a{2}", "|"])
@example(["b", "a{2}", "(a|b)", "X", "|", "b"])
@settings(max_examples=3000, deadline=None)
def test_required_text_is_in_every_match(parts):
    regex = "".join(parts)
    try:
        compiled = re.compile(regex, re.IGNORECASE)
    except re.error:
        return
    needed = match.required_text(regex)
    if needed is None:
        return
    rng = random.Random(regex)
    for _ in range(60):
        text = "".join(rng.choice("abX.1 ") for _ in range(rng.randint(0, 8)))
        if compiled.search(text):
            assert needed in text.lower()


def test_match_all_agrees_with_python_on_random_messages(spark):
    rng = random.Random(7)
    words = "soft memory limit exceeded voterequest timed out connection reset by peer logs have been garbage collected \
 fail of leader detected long time to resolve dns for host1 stopping writes because we have 12 immutable memtables".split()
    messages = [" ".join(rng.choice(words).upper() if rng.random() < .2 else rng.choice(words) for _ in range(rng.randint(1, 14)))
                for _ in range(400)] + [p.regex for p in PATTERNS] + [p.name for p in PATTERNS]
    expected = sorted((i, p.name) for i, m in enumerate(messages) for p in PATTERNS if re.search(p.regex, m, re.IGNORECASE))
    got = match.name_patterns(match.match_all(logs(spark, *messages), PATTERNS), PATTERNS)
    assert sorted((r.i, r.pattern_name) for r in got.collect()) == expected
    first = match.name_patterns(match.match_first(logs(spark, *messages), PATTERNS), PATTERNS)
    universe = [p for p in PATTERNS if p.section == "universe"]
    wanted = {i: next((p.name for p in universe if re.search(p.regex, m, re.IGNORECASE)), None) for i, m in enumerate(messages)}
    assert {r.i: r.pattern_name for r in first.collect()} == {i: n for i, n in wanted.items() if n}


def test_first_match_runs_each_regex_once(spark):
    plan = match.match_first(logs(spark, "x"), PATTERNS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("latch already owned by") == 2  # the substring test and the regex, nowhere else


def test_custom_patterns():
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        got = catalog.custom_patterns("a+, (bad , ,c")
    assert [(p.name, p.regex) for p in got] == [("custom_pattern_0", "a+"), ("custom_pattern_2", "c")]
    assert len(caught) == 1
    assert [p.name for p in catalog.custom_patterns(["x", " y "], named=False)] == ["x", "y"]


def test_merge_and_load(tmp_path, spark):
    merged = catalog.merge_sections([Pattern("a", "n", "1"), Pattern("a", "m", "2"), Pattern("b", "n", "3")])
    assert [(p.name, p.regex) for p in merged] == [("n", "3"), ("m", "2")]
    path = tmp_path / "c.json"
    path.write_text('{"universe": {"log_messages": [{"name": "x", "pattern": "y"}, {"name": "blank", "pattern": " "}]},'
                    '"pg": {"log_messages": [{"name": "p", "pattern": "q", "solution": "s"}]}}')
    got = catalog.load_patterns(str(path))
    assert [(p.section, p.name, p.solution) for p in got] == [("universe", "x", catalog.NO_SOLUTION), ("pg", "p", "s")]
    assert rows(catalog.patterns_frame(spark, got), "pattern_id", "pattern") == [(0, "y"), (1, "q")]


def test_solutions(spark):
    pats = [Pattern("u", "one", "abc.*x", "do one"), Pattern("u", "two", "abc", "do two")]
    keys = spark.createDataFrame([("abc.*x",), ("zabcz",), ("ABC",), ("other",)], "pattern string")
    assert rows(match.hit_names(keys, pats), "pattern", "log_name", "solution") == [
        ("ABC", "ABC", catalog.NO_SOLUTION), ("abc.*x", "one", "do one"), ("other", "other", catalog.NO_SOLUTION),
        ("zabcz", "two", "do two")]
    assert rows(match.detected_names(keys.limit(1).union(keys.limit(1)), pats)) == [("one", "do one")]


def test_large_catalogue_gives_the_same_hits(spark):
    filler = [Pattern("custom", f"filler {i}", f"nothing{i}.*here") for i in range(match.GROUP + 1)]
    many = filler + PATTERNS
    df = logs(spark, *[p.name for p in PATTERNS], "VoteRequest timed out Connection reset by peer", "nothing3 is here", " ")
    small = set(match.name_patterns(match.match_all(df, PATTERNS), PATTERNS).select("i", "pattern_name").collect())
    large = set(match.name_patterns(match.match_all(df, many), many).select("i", "pattern_name").collect())
    assert large - small == {(len(PATTERNS) + 1, "filler 3")} and small <= large
    for scope in ("all", "by_log_type"):
        first = [dict(match.name_patterns(match.match_first(df, p, scope), p).select("i", "pattern_name").collect()) for p in (PATTERNS, many)]
        assert first[0].items() <= first[1].items() and set(first[1]) - set(first[0]) == {len(PATTERNS) + 1}


@pytest.mark.parametrize("message", ["SOFT MEMORY LİMIT EXCEEDED", "soft memory lımıt exceeded", "ſoft memory limit exceeded"])
def test_raw_lines_fold_like_their_engine(spark, message):
    assert re.search("soft memory limit", message, re.IGNORECASE)
    assert names(match.match_first(logs(spark, message), PATTERNS)) == ["Soft memory limit exceeded"]
