"""Cleaning detectors: each finds spans to delete or replace, and none changes a text.

All read the lines table. Rows are (book_id, start, end, kind, replacement); a null replacement deletes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import CleaningConfig
from quillspark.functions.text import CONTROL, LINE_SPACE, right_trimmed
from quillspark.operators.scan import CHUNK_BYTES, carried, chunked, inside, with_carried
from quillspark.operators.spans import apply_spans, drop_contained

COLUMNS = ("book_id", "start", "end", "kind", "replacement")
IDEOGRAPHIC = "　"


def _written(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, with eff, the line without white space at its end."""
    return lines.withColumn("eff", right_trimmed("line")).where("eff <> ''")


def _rows(df: DataFrame, kind: str) -> DataFrame:
    return df.select("book_id", "start", "end", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("replacement"))


def clean_trailing_ws(lines: DataFrame) -> DataFrame:
    """White space at the end of lines that are not blank."""
    run = F.octet_length(F.regexp_extract("line", rf"{LINE_SPACE}+\z", 0))
    found = _written(lines).withColumn("start", F.col("byte_end") - run).withColumn("end", F.col("byte_end"))
    return _rows(found.where("start < end"), "trailing_whitespace")


def clean_leading_fullwidth(lines: DataFrame) -> DataFrame:
    """Ideographic spaces that lines begin with."""
    run = F.octet_length(F.regexp_extract("eff", rf"^{IDEOGRAPHIC}+", 0))
    found = _written(lines).withColumn("start", F.col("byte_start")).withColumn("end", F.col("byte_start") + run)
    return _rows(found.where("start < end"), "leading_fullwidth_space")


def _matches(lines: DataFrame, pattern: str) -> DataFrame:
    """Byte spans of all matches behind the ideographic spaces that a line begins with."""
    rest = _written(lines).withColumn("rest", F.regexp_replace("eff", rf"^{IDEOGRAPHIC}+", "")).where(F.col("rest").rlike(pattern))
    rest = rest.withColumn("from", F.col("byte_start") + F.octet_length("eff") - F.octet_length("rest"))
    values, gaps = F.regexp_extract_all("rest", F.lit(f"({pattern})"), F.lit(1)), F.split("rest", pattern, -1)
    spots = F.transform(values, lambda v, i: F.struct(i.alias("i"), F.octet_length(v).alias("size"), F.octet_length(F.get(gaps, i)).alias("gap")))
    spots = rest.select("book_id", "line_no", "from", F.inline(spots))
    until = Window.partitionBy("book_id", "line_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spots = spots.withColumn("end", F.col("from") + F.sum(F.col("gap") + F.col("size")).over(until))
    return spots.withColumn("start", F.col("end") - F.col("size"))


def clean_inline_fullwidth(lines: DataFrame) -> DataFrame:
    """Runs of two or more ideographic spaces inside lines; single ones stay."""
    return _rows(_matches(lines, f"{IDEOGRAPHIC}{{2,}}"), "inline_fullwidth_space")


def clean_control_chars(lines: DataFrame) -> DataFrame:
    """Control characters, one row each."""
    return _rows(_matches(lines, CONTROL), "control_char")


def clean_blank_runs(lines: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Three or more newlines with only blanks between them; two newlines take their place.

    A newline continues a run if nothing but blanks lies between it and the one before. Runs are numbered and summed up inside
    each chunk of a book; their numbers in the book follow from how many the chunks before have opened, and the parts of a run
    over the edge of chunks meet by it.
    """
    cr = F.col("line").endswith("\r").cast("int")
    between = F.col("line").rlike(rf"^[ \t{IDEOGRAPHIC}]*\r?\z") & (F.col("line_no") > 0)
    token = lines.where("ended").select("book_id", "line_no", "byte_start", "byte_end", (F.col("byte_end") - cr).alias("at"), F.when(between, 0).otherwise(1).alias("new"))
    rows = chunked(token, "byte_start", chunk_bytes)
    marked = rows.withColumn("run", F.sum("new").over(inside("line_no")))
    parts = marked.groupBy("book_id", "chunk", "run").agg(F.min("at").alias("start"), F.max("byte_end").alias("stop"), F.count("*").alias("n"))
    opened = parts.groupBy("book_id", "chunk").agg(F.max(F.struct("run", "start", "stop", "n")).alias("last"))
    before = carried(opened.select("book_id", "chunk", F.col("last.run").alias("opened")), carry=F.sum("opened"))
    # inside a chunk a run is whole, unless it is the first or the last; those few meet by number
    numbered = with_carried(parts, before).withColumn("run", F.col("run") + F.coalesce("carry", F.lit(0)))
    runs = numbered.groupBy("book_id", "run").agg(F.min("start").alias("start"), (F.max("stop") + 1).alias("end"), F.sum("n").alias("n"))
    kind = F.lit("blank_line_compression")
    return runs.where("n >= 3").select("book_id", "start", "end", kind.alias("kind"), F.lit("\n\n").alias("replacement"))


def cleaning_annotations(lines: DataFrame, config: CleaningConfig = CleaningConfig(), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The spans of all detectors that are on, sorted apart: none lies inside or overlaps another.

    White space at a line's end stops where a run of blank lines begins, so that a carriage return is not claimed twice.
    """
    parts = []
    if config.trailing_whitespace:
        trailing = clean_trailing_ws(lines)
        if config.blank_line_compression:
            stops = clean_blank_runs(lines, chunk_bytes).select("book_id", F.col("start").alias("stop"))
            ends = trailing.withColumn("stop", F.col("end") - 1)
            trailing = ends.join(stops.withColumn("hit", F.lit(1)), ["book_id", "stop"], "left")
            trailing = trailing.withColumn("end", F.col("end") - F.coalesce("hit", F.lit(0))).where("start < end").select(*COLUMNS)
        parts.append(trailing)
    if config.leading_fullwidth_space:
        parts.append(clean_leading_fullwidth(lines))
    if config.inline_fullwidth_space:
        parts.append(clean_inline_fullwidth(lines))
    if config.control_char:
        parts.append(clean_control_chars(lines))
    if config.blank_line_compression:
        parts.append(clean_blank_runs(lines, chunk_bytes))
    if not parts:
        return lines.sparkSession.createDataFrame([], lines.select("book_id").schema.add("start", "long").add("end", "long").add("kind", "string").add("replacement", "string"))
    return drop_contained(reduce(DataFrame.unionByName, parts), chunk_bytes)


def apply_cleaning(books: DataFrame, cleaning: DataFrame) -> DataFrame:
    """books with `cleaned`, the text with the cleaning rows applied."""
    return apply_spans(books, cleaning, ["book_id"])


def cleaning_kind_counts(cleaning: DataFrame) -> DataFrame:
    """Number of cleaning rows by book and kind."""
    return cleaning.groupBy("book_id", "kind").agg(F.count("*").alias("n"))
