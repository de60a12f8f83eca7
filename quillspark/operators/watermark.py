"""Boilerplate scoring of lines: how often a line repeats in its book, its script, and rules on its words.

Three signals are weighed into a score, which is classed as auto, suspect, or nothing. All of it runs on
the lines table partitioned by book_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.config import WatermarkConfig
from quillspark.functions.text import cjk_count, is_dialogue_line
from quillspark.operators.rules import compiled, match_all_rules
from quillspark.operators.spans import merge_spans

#: The count at which repetition saturates, where the script signal begins, and its range.
FULL_COUNT = 50
ONSET = 0.4
RANGE = 0.4


def heading_starts(chapters: DataFrame, volumes: DataFrame | None = None) -> DataFrame:
    """(book_id, start) of every heading that is not empty."""
    some = chapters.where("heading_end > heading_start").select("book_id", F.col("heading_start").alias("start"))
    if volumes is None:
        return some
    more = volumes.where("heading_end > heading_start").select("book_id", F.col("heading_start").alias("start"))
    return some.union(more)


def eligible_lines(lines: DataFrame, headings: DataFrame | None = None, config: WatermarkConfig = WatermarkConfig()) -> DataFrame:
    """Lines that may be boilerplate: no heading, not blank, long enough, no dialogue."""
    if headings is not None:
        lines = lines.join(headings.select("book_id", F.col("start").alias("byte_start")), ["book_id", "byte_start"], "left_anti")
    some = lines.where((F.col("trimmed") != "") & (F.length("trimmed") >= config.min_line_chars))
    return some.where(~is_dialogue_line("trimmed"))


#: A text that makes up more than one in so many lines is hot; there are fewer hot texts than this, which bounds their broadcast.
HOT_SHARE = 1000


def line_frequency(eligible: DataFrame) -> DataFrame:
    """eligible with `repeats`, how many eligible lines of the book read the same when trimmed.

    Texts are counted by 128 bits of hash, with combining before the exchange, and only counts over one are joined back. The
    few hot texts are broadcast; their lines go through the join spread by place, where no count waits for them, so that no
    task gets all copies of a line.
    """
    named = eligible.select(F.struct(*eligible.columns).alias("row"), "book_id", F.xxhash64("trimmed").alias("h"), F.xxhash64(F.lit(1), "trimmed").alias("g"), F.xxhash64("book_id", "line_no").alias("place"))
    counts = named.groupBy("book_id", "h", "g").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    many = counts.where("n > 1")
    hot = many.join(F.broadcast(total), F.col("n") * HOT_SHARE > F.col("total")).select(F.col("book_id").alias("b1"), F.col("h").alias("h1"), F.col("g").alias("g1"), F.col("n").alias("n1"))
    rest = many.select(F.col("book_id").alias("b2"), F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("n").alias("n2"))
    same = lambda b, g: F.col("book_id").eqNullSafe(F.col(b)) & (F.col("g") == F.col(g))
    told = named.join(F.broadcast(hot), same("b1", "g1") & (F.col("h") == F.col("h1")), "left")
    spread = F.when(F.col("n1").isNull(), F.col("h")).otherwise(F.col("place"))
    told = told.join(rest, same("b2", "g2") & (spread == F.col("h2")), "left")
    return told.select("row.*", F.coalesce("n1", "n2", F.lit(1).cast("long")).alias("repeats"))


def repetition_signal(config: WatermarkConfig = WatermarkConfig()) -> Column:
    """Score of repeats; null below the least count."""
    raw = F.log10("repeats") / F.log10(F.lit(float(FULL_COUNT)))
    return F.when(F.col("repeats") >= config.repeat_count_min, F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def non_cjk_ratio() -> Column:
    """Share of characters outside Chinese context."""
    return (F.length("trimmed") - cjk_count("trimmed")) / F.length("trimmed")


def non_cjk_signal() -> Column:
    """Score of the share of foreign characters; null below the onset."""
    raw = (F.col("non_cjk") - ONSET) / RANGE
    return F.when(F.col("non_cjk") >= ONSET, F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def keyword_signal(hits: str = "hits") -> Column:
    """1 where any rule is hit, else null."""
    return F.when(F.size(hits) > 0, 1.0)


def fused_score(config: WatermarkConfig = WatermarkConfig()) -> Column:
    """The weighed sum of the signals, from 0 to 1."""
    parts = (("s_repeat", config.weight_repeat), ("s_non_cjk", config.weight_non_cjk), ("s_keyword", config.weight_keyword))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts), F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def classify(score: str = "score", config: WatermarkConfig = WatermarkConfig()) -> Column:
    """auto, suspect, or null."""
    return F.when(F.col(score) >= config.auto_threshold, "auto").when(F.col(score) >= config.suspect_threshold, "suspect")


def line_signals(eligible: DataFrame, rules: DataFrame, config: WatermarkConfig = WatermarkConfig()) -> DataFrame:
    """eligible with non_cjk, hits, repeats, the three signals, and score.

    What is read from the text is told below the exchange of line_frequency: above it, a filter on the score, which names
    these columns many times over, would match all patterns anew for each time.
    """
    read = eligible.withColumns({"non_cjk": non_cjk_ratio(), "hits": match_all_rules("trimmed", compiled(rules, "watermark"))})
    counted = line_frequency(read)
    counted = counted.withColumns({"s_repeat": repetition_signal(config), "s_non_cjk": non_cjk_signal(), "s_keyword": keyword_signal()})
    return counted.withColumn("score", fused_score(config))


def watermarks(lines: DataFrame, rules: DataFrame, headings: DataFrame | None = None, config: WatermarkConfig = WatermarkConfig()) -> DataFrame:
    """(book_id, start, end, verdict, score, signals) of the lines that score enough; the span is the whole line."""
    some = eligible_lines(lines, headings, config).select("book_id", "line_no", "byte_start", "byte_end", "trimmed")
    scored = line_signals(some, rules, config).withColumn("verdict", classify("score", config))
    percent = F.floor(F.col("non_cjk") * 100 + 0.5).cast("int")
    signal = lambda kind, score, detail: F.when(
        F.col(score).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(score).alias("score"), detail.alias("detail"))
    )
    signals = F.array_compact(
        F.array(
            signal("repetition", "s_repeat", F.format_string("出现 %d 次", "repeats")),
            signal("non_cjk_ratio", "s_non_cjk", F.format_string("%d%% 非中文字符", percent)),
            signal("keyword_regex", "s_keyword", F.concat(F.lit("命中规则 "), F.array_join("hits", ", "))),
        )
    )
    found = scored.where("verdict is not null") if config.enabled else scored.limit(0)
    return found.select(
        "book_id", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"), "verdict", "score", signals.alias("signals")
    )


def watermark_counts(found: DataFrame) -> DataFrame:
    """Number of auto and suspect rows and of both, by book."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return found.groupBy("book_id").agg(count("auto").alias("n_auto"), count("suspect").alias("n_suspect"), F.count("*").alias("n"))


def filter_verdict(found: DataFrame, verdict: str = "all") -> DataFrame:
    """Rows with this verdict, or all."""
    return found if verdict == "all" else found.where(F.col("verdict") == verdict)


def signal_to_kind(signals: str = "signals") -> Column:
    """The cleaning kind of the best signal: highest score, then keyword, repetition, script, then the first."""
    rank = lambda s: F.when(s["kind"].isin("keyword_regex", "llm_adjudication"), 3).when(s["kind"] == "repetition", 2).otherwise(1)
    ranked = F.transform(signals, lambda s, i: F.struct((-s["score"]).alias("s"), (-rank(s)).alias("p"), i.alias("i"), s["kind"].alias("kind")))
    best = F.array_min(ranked)["kind"]
    return F.when(best.isin("keyword_regex", "llm_adjudication"), "watermark_keyword").when(best == "repetition", "watermark_repetition").otherwise("watermark_non_cjk")


def mirror_auto(found: DataFrame) -> DataFrame:
    """The auto rows as rows that delete the line."""
    auto = found.where("verdict = 'auto'")
    return auto.select("book_id", "start", "end", signal_to_kind().alias("kind"), F.lit(None).cast("string").alias("replacement"))


def merge_auto_into_cleaning(cleaning: DataFrame, found: DataFrame) -> DataFrame:
    """Cleaning rows and the auto rows, merged where they overlap."""
    return merge_spans(cleaning.unionByName(mirror_auto(found)))
