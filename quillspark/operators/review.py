"""Review of findings: decisions of reviewers, verdicts of a model on uncertain lines, and rules induced from rejected ones.

No model is called here: candidate tables go out, and reply tables come in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import is_watermark_kind, trim_unicode
from quillspark.operators.spans import merge_spans
from quillspark.operators.watermark import signal_to_kind

KEY = ["book_id", "start", "end"]
#: Words of a reply, and reasons where a reply gives none.
YES, NO, REASON = "水印", "正文", "LLM 判定为水印"


def apply_decisions(cleaning: DataFrame, watermarks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cleaning rows after decisions (book_id, start, end, scope, verdict), merged.

    Rejected cleaning rows and mirrors of rejected lines go, approved suspect lines come in; all else has no effect.
    """
    pick = lambda scope, verdict: decisions.where((F.col("scope") == scope) & (F.col("verdict") == verdict)).select(*KEY).distinct()
    formats = cleaning.where(~is_watermark_kind("kind")).join(pick("cleaning", "rejected"), KEY, "left_anti")
    mirrors = cleaning.where(is_watermark_kind("kind")).join(pick("watermark", "rejected"), KEY, "left_anti")
    approved = watermarks.where("verdict = 'suspect'").join(pick("watermark", "approved"), KEY, "left_semi")
    approved = approved.select(*KEY, signal_to_kind().alias("kind"), F.lit(None).cast("string").alias("replacement"))
    columns = [*KEY, "kind", "replacement"]
    return merge_spans(formats.select(*columns).unionByName(mirrors.select(*columns)).unionByName(approved))


def bulk_decide(decisions: DataFrame, spans: DataFrame, scope: str, verdict: str) -> DataFrame:
    """decisions with one verdict for all spans, in place of earlier ones."""
    new = spans.select(*KEY, F.lit(scope).alias("scope"), F.lit(verdict).alias("verdict")).distinct()
    return decisions.join(new.select(*KEY, "scope"), [*KEY, "scope"], "left_anti").select(*new.columns).unionByName(new)


def toggle_decisions(decisions: DataFrame, spans: DataFrame, scope: str, verdict: str) -> DataFrame:
    """decisions where the spans take the verdict, and those that have it already lose it."""
    new = spans.select(*KEY, F.lit(scope).alias("scope"), F.lit(verdict).alias("verdict")).distinct()
    fresh = new.join(decisions, [*KEY, "scope", "verdict"], "left_anti")
    return clear_decisions(decisions, spans, scope).select(*new.columns).unionByName(fresh)


def clear_decisions(decisions: DataFrame, spans: DataFrame, scope: str) -> DataFrame:
    """decisions without those on the spans."""
    return decisions.join(spans.select(*KEY).distinct().withColumn("scope", F.lit(scope)), [*KEY, "scope"], "left_anti")


def last_decisions(log: DataFrame) -> DataFrame:
    """The last decision by ts on every span and scope."""
    return log.groupBy(*KEY, "scope").agg(F.max_by("verdict", "ts").alias("verdict"))


def effective_layers(cleaning: DataFrame, watermarks: DataFrame, decisions: DataFrame) -> DataFrame:
    """(book_id, start, end, layer): what is removed, and which auto and suspect lines still stand as such."""
    rejected = decisions.where("verdict = 'rejected'")
    off = rejected.where("scope = 'watermark'").select(*KEY).distinct()
    on = decisions.where("scope = 'watermark' and verdict = 'approved'").select(*KEY).distinct()
    removed = cleaning.where(~is_watermark_kind("kind")).join(rejected.where("scope = 'cleaning'").select(*KEY).distinct(), KEY, "left_anti")
    auto = watermarks.where("verdict = 'auto'").join(off, KEY, "left_anti")
    suspect = watermarks.where("verdict = 'suspect'")
    gone = suspect.join(on, KEY, "left_semi")
    left = suspect.join(on, KEY, "left_anti").join(off, KEY, "left_anti")
    layer = lambda df, name: df.select(*KEY, F.lit(name).alias("layer"))
    return layer(removed, "removed").union(layer(gone, "removed")).union(layer(auto, "auto")).union(layer(left, "suspect"))


def llm_candidates(lines: DataFrame, watermarks: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(book_id, start, end, text, context_before, context_after) of suspect lines with the nearest lines that are not blank."""
    suspects = watermarks.where("verdict = 'suspect'").select(*KEY)
    if spans is not None:
        suspects = suspects.join(spans.select(*KEY).distinct(), KEY, "left_semi")
    order = Window.partitionBy("book_id").orderBy("line_no")
    written = F.when(F.col("trimmed") != "", F.col("trimmed"))
    told = lines.select(
        "book_id", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"), F.col("trimmed").alias("text"),
        F.last(written, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("context_before"),
        F.first(written, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("context_after"),
    )
    return told.join(suspects, KEY)


def number_candidates(candidates: DataFrame, size: int = 20) -> DataFrame:
    """(book_id, batch, n, prompt): candidates of a book numbered from 1 in batches of so many lines."""
    order = Window.partitionBy("book_id").orderBy("start")
    at = F.row_number().over(order) - 1
    numbered = candidates.withColumn("batch", F.floor(at / size)).withColumn("i", at % size + 1)
    item = F.struct("i", F.concat_ws(". ", F.col("i").cast("string"), "text").alias("t"))
    return numbered.groupBy("book_id", "batch").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(item))["t"], "\n").alias("prompt")
    )


def parse_verdict_lines(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """(book_id, batch, i, verdict, reason): each candidate of a batch with its line of the reply (book_id, batch, reply).

    A line counts by its place among the lines that are not blank; what says neither is uncertain, as is what is missing.
    """
    said = replies.select("book_id", "batch", F.posexplode(F.split("reply", r"\r?\n")).alias("at", "row")).where(trim_unicode("row") != "")
    said = said.withColumn("i", F.row_number().over(Window.partitionBy("book_id", "batch").orderBy("at")))
    after = F.locate(". ", F.col("row"))
    body = trim_unicode(F.when(after > 0, F.substring("row", after + 2, F.length("row"))).otherwise(F.col("row")))
    colon = F.locate(":", body)
    tag = F.when(colon > 0, F.substring(body, F.lit(1), colon - 1)).otherwise(body)
    said = said.withColumn("tag", tag).withColumn("reason", F.when(colon > 0, trim_unicode(F.substring(body, colon + 1, F.length(body)))))
    asked = batches.select("book_id", "batch", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    joined = asked.join(said.select("book_id", "batch", "i", "tag", "reason"), ["book_id", "batch", "i"], "left")
    verdict = F.when(F.col("tag").contains(YES), "is_watermark").when(F.col("tag").contains(NO), "is_content").otherwise("uncertain")
    told = F.when(F.col("reason") != "", F.col("reason")).otherwise(REASON)
    reason = F.when(verdict == "is_watermark", told)
    return joined.select("book_id", "batch", "i", verdict.alias("verdict"), reason.alias("reason"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Number of verdicts of each kind by book."""
    return verdicts.groupBy("book_id", "verdict").agg(F.count("*").alias("n"))


def apply_verdicts(watermarks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """watermarks where suspect lines that a verdict (book_id, start, end, verdict, reason) calls boilerplate are auto.

    They get a signal of their own, and their score stays.
    """
    yes = verdicts.where("verdict = 'is_watermark'").groupBy(*KEY).agg(F.first("reason").alias("reason"), F.lit(True).alias("yes"))
    joined = watermarks.join(yes, KEY, "left")
    up = F.col("yes").isNotNull() & (F.col("verdict") == "suspect")
    signal = F.struct(F.lit("llm_adjudication").alias("kind"), F.lit(1.0).alias("score"), F.col("reason").alias("detail"))
    return joined.withColumn("signals", F.when(up, F.array_append("signals", signal)).otherwise(F.col("signals"))).withColumn(
        "verdict", F.when(up, "auto").otherwise(F.col("verdict"))
    ).select(*watermarks.columns)


def upgraded_cleaning(cleaning: DataFrame, watermarks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cleaning rows with those of suspect lines that verdicts call boilerplate, merged."""
    yes = verdicts.where("verdict = 'is_watermark'").select(*KEY).distinct()
    rows = watermarks.where("verdict = 'suspect'").join(yes, KEY, "left_semi")
    rows = rows.select(*KEY, F.lit("watermark_keyword").alias("kind"), F.lit(None).cast("string").alias("replacement"))
    return merge_spans(cleaning.unionByName(rows))


def induction_samples(lines: DataFrame, decisions: DataFrame, verdict: str = "rejected", first: int = 10) -> DataFrame:
    """(book_id, n, samples): the first trimmed lines of each book that were decided so, joined by newlines."""
    spans = decisions.where((F.col("scope") == "watermark") & (F.col("verdict") == verdict)).select(*KEY).distinct()
    told = lines.where("trimmed <> ''").select("book_id", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"), "trimmed")
    found = told.join(spans, KEY, "left_semi").withColumn("i", F.row_number().over(Window.partitionBy("book_id").orderBy("start")))
    item = F.struct("i", "trimmed")
    return found.where(F.col("i") <= first).groupBy("book_id").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(item))["trimmed"], "\n").alias("samples")
    )


def induced_rule(replies: DataFrame) -> DataFrame:
    """Rules from replies (pattern): trimmed, named by their hash, with a low priority."""
    pattern = F.trim(F.regexp_replace("pattern", r"^`+|`+$", ""))
    some = replies.select(pattern.alias("pattern")).where("pattern <> ''").distinct()
    return some.select(
        F.concat(F.lit("llm-"), F.substring(F.sha2("pattern", 256), 1, 12)).alias("id"), "pattern", F.lit("watermark").alias("kind"), F.lit(True).alias("enabled"), F.lit(50).alias("priority"), F.lit("llm_generated").alias("source"), F.lit("").alias("description")
    )
