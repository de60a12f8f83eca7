"""Thousands of rules by one pass over a line, and patterns that could take exponential time."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import patterns, rules

SLOW = ["(a+)+$", "(a*)*b", "(a|a)*c", "(a|aa)+$", r"(\w|a)+b", r"(\w+\s?)*$", "([a-z]+)*x", "(x+x+)+y", "(?i)(a|A)*b", r"(a+){12}b", r"^(([a-z])+.)+[A-Z]([a-z])+$"]
FAST = ["(a|b)*c", r"(\w+\s)*$", "a{1,5}b{2}", ".*.*x", "(a?){9}b", "x(abc|de+f)y*", "(a+b)+", "(.a)+(.b)+", "(ab|a)(c|bcd)+", "[a-z]+", r"(?:\d+,)*\d+$", r"([^|]+\|)+", r"\p{Han}+", "(?>a+)+b"]


@pytest.mark.parametrize("pattern", SLOW)
def test_slow_patterns_are_told(pattern):
    assert patterns.ambiguity(pattern)


@pytest.mark.parametrize("pattern", FAST + [p for _, p, _, _ in rules.BUILTIN])
def test_fast_patterns_are_not(pattern):
    assert patterns.ambiguity(pattern) is None


ATOM = st.sampled_from(["a", "b", "[ab]", "c", r"\w", "ab", "x{2}", "^", "(?:a|bc)", "(b|a)", "[^a]"])
PATTERN = st.recursive(ATOM, lambda p: st.one_of(st.lists(p, min_size=1, max_size=3).map("".join), st.lists(p, min_size=2, max_size=3).map(lambda x: f"(?:{'|'.join(x)})"), p.map(lambda x: f"(?:{x})?"), p.map(lambda x: f"(?:{x}){{1,2}}")), max_leaves=8)


@given(PATTERN, st.lists(st.text("abcx", max_size=8), min_size=5, max_size=20))
@settings(max_examples=400, deadline=None)
def test_no_match_without_a_needed_word(pattern, lines):
    words = patterns.needed_words(pattern)
    for line in lines:
        if words and re.search(pattern, line):
            assert any(w in line for w in words)


def test_needed_words():
    assert patterns.needed_words(r"\d+(?:foo|bars)?x{1,3}(?:alpha|be)ta\b") == ["alphata", "beta"]
    assert patterns.needed_words(r"(?:^|[\s\x{3000}(\[【])www\.[a-z]{3,}") == ["www."]
    assert patterns.needed_words("(?i)abc") is None and patterns.needed_words("a*") is None and patterns.needed_words(r"\p{Han}x") is None


def many_rules(spark, n):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shapes = [lambda: f"{word()}", lambda: f"{word()}\\d+", lambda: f"(?:{word()}|{word()})[.!]", lambda: f"^{word()}", lambda: f"{word()}.{{0,9}}{word()}"]
    rows = [(f"r{k}", rng.choice(shapes)(), "watermark", True, 1, "user", "", k) for k in range(n)]
    rows += [("digits", r"\d{6}", "watermark", True, 1, "user", "", n)]
    return spark.createDataFrame(rows, rules.RULE_SCHEMA + ", ord int"), [(r[0], r[1]) for r in rows]


def test_thousands_of_rules_match_as_one_by_one(spark):
    table, plain = many_rules(spark, 5000)
    rng = random.Random(5)
    words = [re.findall("[a-h]{5}", p) for _, p in plain if re.findall("[a-h]{5}", p)]
    lines = [" ".join(rng.choice(rng.choice(words)) + rng.choice(["", ".", "!", "7", "123456"]) for _ in range(6)) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, line string").repartition(4)
    order = rules.compiled(table, "watermark")
    began = time.time()
    got = {r["k"]: r for r in df.select("k", rules.match_all_rules("line", order).alias("all"), rules.match_first_rule("line", order).alias("first")).collect()}
    assert time.time() - began < 60
    tried = [(i, re.compile(p).search) for i, p in plain]
    for k, line in enumerate(lines):
        want = [i for i, search in tried if line is not None and search(line)]
        assert got[k]["all"] == want and got[k]["first"] == (want[0] if want else None)
    assert sum(len(r["all"]) for r in got.values()) > 300


def test_one_bad_rule_among_many(spark):
    table, _ = many_rules(spark, 1000)
    bad = spark.createDataFrame([("open", "(", "watermark", True, 1, "user", "", 9), ("slow", "(b+)+$", "watermark", True, 1, "user", "", 10)], table.schema)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("validate", "validate")
    found = {r["id"]: r["error"] for r in rules.validate_rules(table.union(bad)).collect()}
    jobs = len(tracker.getJobIdsForGroup("validate"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(found) == {"open", "slow"} and "exponentially" in found["slow"] and jobs <= 3
    # the bad watermark rules are skipped, the others stay
    assert len(rules.compiled(table.union(bad), "watermark")) == 1001


def test_rules_are_validated_where_their_rows_are(spark, monkeypatch):
    """More rules than are remembered: each is analysed once, and none on the driver."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(rules, "REMEMBERED", 50)
    monkeypatch.setattr(rules, "check_patterns", lambda *a: 1 / 0)
    ends = F.expr("CASE id % 4 WHEN 0 THEN 'w' || id WHEN 1 THEN '(?:w' || id || '|w' || id || ')+$' WHEN 2 THEN '(w' || id WHEN 3 THEN NULL END")
    told = {r["id"]: r["error"] for r in rules.validate_rules(spark.range(400).select("id", ends.alias("pattern"))).collect()}
    assert set(told) == {k for k in range(400) if k % 4}
    assert "exponentially" in told[1] and told[2] == "does not compile: missing ), unterminated subpattern" and told[3] == "does not compile"


def test_rules_beyond_those_remembered_are_compiled_once(spark, monkeypatch):
    monkeypatch.setattr(rules, "REMEMBERED", 50)
    rules._errors.clear()
    seen, own = [], rules.ambiguity
    monkeypatch.setattr(rules, "ambiguity", lambda p: seen.append(p) or own(p))
    table = spark.range(120).selectExpr("'r' || id AS id", "'once' || id AS pattern", "'watermark' AS kind", "true AS enabled", "1 AS priority", "cast(id AS int) AS ord")
    assert len(rules.compiled(table, "watermark")) == 120 and len(seen) == 120 and len(rules._errors) <= 50
