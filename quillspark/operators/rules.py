"""Heading and boilerplate rules: the built-in ones, merging and validation, and matching lines against them.

A rule set is small: it is collected, and each pattern enters the plan as a literal, so that it is compiled once.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.patterns import ambiguity, needed_words, not_compiled

RULE_SCHEMA = "id string, pattern string, kind string, enabled boolean, priority int, source string, description string"
DIALECT = "(?dU)"

#: Numerals, the tail of a heading, and the built-in rules as (id, pattern, kind, priority).
NUMERALS = "[0-9零一二三四五六七八九十百千万亿两〇壹贰叁肆伍陆柒捌玖拾佰仟]{1,15}"
TAIL = r"(?:[\s\.\-—–:：、].{0,60})?"
BUILTIN = (
    ("builtin-chapter-cn-zhang", f"^第{NUMERALS}章{TAIL}$", "chapter", 200),
    ("builtin-chapter-cn-hui", f"^第{NUMERALS}回{TAIL}$", "chapter", 190),
    ("builtin-chapter-cn-hua", f"^第{NUMERALS}话{TAIL}$", "chapter", 180),
    ("builtin-chapter-cn-jie", f"^第{NUMERALS}[节節]{TAIL}$", "chapter", 170),
    ("builtin-chapter-prologue", f"^(?:序章|序言|楔子|前言|引子){TAIL}$", "chapter", 160),
    ("builtin-chapter-extra", f"^(?:番外|外传|后记|尾声|终章)(?:篇|章)?{TAIL}$", "chapter", 150),
    ("builtin-volume-cn-juan", f"^第{NUMERALS}卷{TAIL}$", "volume", 200),
    ("builtin-volume-juan-x", f"^卷{NUMERALS}{TAIL}$", "volume", 190),
    ("builtin-volume-positional", f"^(?:上|中|下)卷{TAIL}$", "volume", 180),
    ("builtin-volume-cn-bu", f"^第{NUMERALS}部{TAIL}$", "volume", 200),
    ("builtin-watermark-url-http", r"https?://[A-Za-z0-9_./\-?#=&%+:~]+", "watermark", 200),
    ("builtin-watermark-url-www", r"(?:^|[\s\x{3000}(\[【「『])www\.[A-Za-z0-9_./\-]{3,}", "watermark", 190),
    ("builtin-watermark-tg-handle", r"@[A-Za-z0-9_]{5,}", "watermark", 150),
    (
        "builtin-watermark-domain",
        r"\b[A-Za-z][A-Za-z0-9\-]{1,}\.(?:com|net|org|cc|cn|io|me|xyz|info|tv|club|app|top|vip|biz)\b",
        "watermark",
        180,
    ),
    (
        "builtin-watermark-first-publish",
        "(?:本(?:文|书|章|站)\\s*首发|首发(?:于|地址|平台|网址|站点)|更新最快|最快(?:更新|阅读))",
        "watermark",
        170,
    ),
    ("builtin-watermark-piracy-warn", "(?:盗版必究|盗文可耻|抄袭可耻|搬运可耻|严禁转载|未经授权请勿转载)", "watermark", 160),
    ("builtin-watermark-free-read", "(?:免费(?:阅读|看书|小说)|无广告(?:阅读|追书)|全本(?:免费|无弹窗))", "watermark", 140),
)

#: So many rules are tried one by one on a line that holds a word they need; more go by one pass over the line for all their words.
FEW_RULES = 64
#: What is remembered of patterns that were compiled.
REMEMBERED = 50_000
_errors: OrderedDict[str, str | None] = OrderedDict()


def builtin_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules, with ord, their place."""
    rows = [(i, p, k, True, n, "builtin", "", at) for at, (i, p, k, n) in enumerate(BUILTIN)]
    return spark.createDataFrame(rows, RULE_SCHEMA + ", ord int")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON documents {"rules": [...]}; missing fields take their defaults, a bad document raises."""
    item = "id string, pattern string, kind string, enabled boolean, priority int, source string, description string"
    read = spark.read.schema(f"rules array<struct<{item.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True)
    rows = read.option("mode", "FAILFAST").json(path).select(F.posexplode("rules").alias("ord", "r")).select("r.*", "ord")
    return rows.withColumns(
        {
            "enabled": F.coalesce("enabled", F.lit(True)),
            "priority": F.coalesce("priority", F.lit(0)),
            "source": F.coalesce("source", F.lit("user")),
            "description": F.coalesce("description", F.lit("")),
        }
    )


def write_rules(rules: DataFrame, path: str) -> None:
    """Write a rule set as one JSON document that read_rules reads."""
    fields = [f.name for f in rules.schema if f.name != "ord"]
    item = F.array_sort(F.collect_list(F.struct("ord", *fields)))
    slim = F.transform(item, lambda r: F.struct(*(r[n].alias(n) for n in fields)))
    rules.agg(slim.alias("rules")).write.mode("overwrite").json(path)


def upsert_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rules of new: those with a known id in its place, the others behind."""
    last = old.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    fields = [c for c in old.columns if c not in ("id", "ord")]
    joined = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full_outer").join(F.broadcast(last))
    pick = [F.when(F.col("n.id").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fields]
    ordinal = F.coalesce("o.ord", F.col("last") + 1 + F.coalesce("n.ord", F.lit(0))).cast("int")
    return joined.select(F.coalesce("n.id", "o.id").alias("id"), *pick, ordinal.alias("ord"))


def merge_rules(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """Built-in rules overridden and extended by a user's."""
    return upsert_rules(builtin, user)


def remove_rules(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """rules without those whose id is in ids."""
    return rules.join(ids.select("id"), "id", "left_anti")


def find_rule(rules: DataFrame, rule_id: str) -> DataFrame:
    """The rule with this id."""
    return rules.where(F.col("id") == rule_id)


def enabled_rules(rules: DataFrame, kind: str) -> DataFrame:
    """Enabled rules of one kind, highest priority first, then by place."""
    return rules.where(F.col("enabled") & (F.col("kind") == kind)).orderBy(F.desc("priority"), "ord")


def compiled(rules: DataFrame, kind: str) -> list[tuple[str, str]]:
    """(id, pattern) of the enabled rules of one kind, in order, in Java's dialect; only what compiles for watermark rules.

    A chapter or volume rule that does not compile raises.
    """
    found, rows = [], enabled_rules(rules, kind).collect()
    problems = check_patterns(rules.sparkSession, [row["pattern"] for row in rows])
    for row in rows:
        problem = problems[row["pattern"]]
        if problem is None:
            found.append((row["id"], java_pattern(row["pattern"])))
        elif kind != "watermark":
            raise ValueError(f"rule {row['id']}: {problem}")
    return found


def java_pattern(pattern: str) -> str:
    """A rule's pattern for Spark: Unicode classes, newline alone ends a line."""
    return DIALECT + pattern.replace("\\u{", "\\x{")


def check_patterns(spark: SparkSession, patterns: list[str]) -> dict[str, str | None]:
    """What is wrong with each pattern, found out without a job: those not known yet are compiled where the driver is.

    Patterns that backtracking could take exponential time for are refused too, as matching has to be linear in a line's length.
    """
    compile_, out = spark._jvm.java.util.regex.Pattern.compile, {}
    for p in dict.fromkeys(patterns):
        if p not in _errors:
            try:
                compile_(java_pattern(p))
                _errors[p] = ambiguity(p)
            except IllegalArgumentException as e:
                _errors[p] = str(e).splitlines()[0]
            while len(_errors) > REMEMBERED:
                _errors.popitem(last=False)
        out[p] = _errors[p]
    return out


def pattern_error(spark: SparkSession, pattern: str) -> str | None:
    """What is wrong with a pattern; None if it compiles and is matched in reasonable time."""
    return check_patterns(spark, [pattern])[pattern]


def validate_rules(rules: DataFrame) -> DataFrame:
    """(id, error) of the rules that do not compile, or that backtracking could take exponential time for.

    Rules are checked by tasks, as a table of rules may be large; they are dealt out by a number of parts, as few bytes take much work.
    """

    @F.pandas_udf("string")
    def fault(patterns: pd.Series, compile_: pd.Series) -> pd.Series:
        return pd.Series([ambiguity(p) if ok else not_compiled(p) for p, ok in zip(patterns, compile_)], dtype=object)

    java = F.concat(F.lit(DIALECT), F.replace("pattern", F.lit("\\u{"), F.lit("\\x{")))
    compiles = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), java).isNotNull()
    dealt = rules.select("id", "pattern").repartition(2 * rules.sparkSession.sparkContext.defaultParallelism, "id", "pattern")
    return dealt.select("id", fault("pattern", compiles).alias("error")).where("error is not null")


def usable_rules(rules: DataFrame) -> DataFrame:
    """rules without those that validate_rules finds fault with, such as what a model has made up."""
    return rules.join(validate_rules(rules), "id", "left_anti")


@lru_cache(maxsize=4)
def _automaton(patterns: tuple[str, ...]) -> tuple[ahocorasick.Automaton | None, frozenset[int]]:
    """An automaton from the words that rules need to the places of the rules, and the places of rules that need none."""
    by_word: dict[str, set[int]] = {}
    always = set()
    for k, p in enumerate(patterns):
        for word in needed_words(p.removeprefix(DIALECT)) or [""]:
            by_word.setdefault(word, set()).add(k)
    always |= by_word.pop("", set())
    found = ahocorasick.Automaton()
    for word, places in by_word.items():
        found.add_word(word, tuple(places))
    found.make_automaton()
    return found if by_word else None, frozenset(always)


def _candidates(c: str, patterns: list[tuple[str, str]]) -> Column:
    """The places of the rules that a line holds a needed word of, or that need none, in order."""
    texts = tuple(p for _, p in patterns)

    @F.pandas_udf("array<int>")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, always = _automaton(texts)
        for lines in batches:
            hits = [set(always).union(*(k for _, k in words.iter(x))) if words is not None and x is not None else always for x in lines]
            yield pd.Series([sorted(h) for h in hits])

    return places(c)


def _matching(c: str, patterns: list[tuple[str, str]]) -> Column:
    """The places of the rules that a line matches, by one pass for the words of all, and the patterns of those found."""
    texts = _listed([p for _, p in patterns])
    return F.filter(_candidates(c, patterns), lambda k: F.rlike(F.col(c), F.get(texts, k)))


def _listed(texts: list[str]) -> Column:
    """A literal array of many texts."""
    return F.from_json(F.lit(json.dumps(texts)), "array<string>")


def match_first_rule(c: str, patterns: list[tuple[str, str]]) -> Column:
    """The id of the first rule that a line matches; null without one."""
    if len(patterns) > FEW_RULES:
        return F.get(_listed([i for i, _ in patterns]), F.get(_matching(c, patterns), F.lit(0)))
    return F.coalesce(*(F.when(_may_match(c, p) & F.col(c).rlike(p), F.lit(i)) for i, p in patterns), F.lit(None).cast("string"))


def match_all_rules(c: str, patterns: list[tuple[str, str]]) -> Column:
    """The ids of all rules that a line matches, in order, as an array; null lines match none."""
    if not patterns:
        return F.array().cast("array<string>")
    if len(patterns) > FEW_RULES:
        ids = _listed([i for i, _ in patterns])
        return F.transform(_matching(c, patterns), lambda k: F.get(ids, k))
    return F.array_compact(F.array(*(F.when(_may_match(c, p) & F.col(c).rlike(p), F.lit(i)) for i, p in patterns)))


def _may_match(c: str, pattern: str) -> Column:
    """Whether a line holds a word that the pattern needs; true if it needs none."""
    words = needed_words(pattern.removeprefix(DIALECT))
    return reduce(lambda a, b: a | b, (F.col(c).contains(w) for w in words)) if words else F.lit(True)


def heading_candidates(lines: DataFrame, rules: DataFrame, longest: int = 100) -> DataFrame:
    """(book_id, start, end, level, title, rule_id, n_bytes) of lines that read like a volume's or chapter's heading."""
    volume, chapter = compiled(rules, "volume"), compiled(rules, "chapter")
    short = lines.where((F.col("trimmed") != "") & (F.length("trimmed") <= longest))
    level = [(i, "volume") for i, _ in volume] + [(i, "chapter") for i, _ in chapter]
    found = short.withColumn("rule_id", match_first_rule("trimmed", volume + chapter)).where("rule_id is not null")
    of = reduce(lambda a, x: a.when(F.col("rule_id") == x[0], x[1]), level[1:], F.when(F.col("rule_id") == level[0][0], level[0][1])) if level else F.lit(None)
    return found.select(
        "book_id", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"), of.alias("level"), F.col("trimmed").alias("title"), "rule_id", "n_bytes"
    )


