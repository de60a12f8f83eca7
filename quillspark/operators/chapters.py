"""Chapters and volumes from headings, by windows over book_id.

Chapters are rows (book_id, volume_no, title, heading_start, heading_end, body_start, body_end, origin,
matched_rule_id); volume_no is null for chapters before the first volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import ChapterConfig
from quillspark.functions.text import trim_unicode
from quillspark.operators.rules import heading_candidates
from quillspark.operators.scan import CHUNK_BYTES, inside
from quillspark.operators.spans import assign_to_ranges, reaching, spliced

COLUMNS = ("book_id", "volume_no", "title", "heading_start", "heading_end", "body_start", "body_end", "origin", "matched_rule_id")


def chapter_bodies(headings: DataFrame) -> DataFrame:
    """headings with body_start and body_end: from behind the heading's line to the next heading or the book's end."""
    order = Window.partitionBy("book_id").orderBy("start")
    found = headings.withColumn("body_end", F.coalesce(F.lead("start").over(order), F.col("n_bytes")))
    return found.withColumn("body_start", F.least(F.col("end") + 1, "body_end"))


def assign_volumes(headings: DataFrame) -> DataFrame:
    """headings with volume_no, that of the nearest volume heading at or before it; null before the first."""
    until = Window.partitionBy("book_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(F.when(F.col("level") == "volume", 1).otherwise(0)).over(until)
    return headings.withColumn("volume_no", F.when(number > 0, number.cast("int")))


def volumes(headings: DataFrame) -> DataFrame:
    """(book_id, volume_no, title, heading_start, heading_end, origin, matched_rule_id)."""
    found = assign_volumes(headings).where("level = 'volume'")
    return found.select(
        "book_id", "volume_no", "title", F.col("start").alias("heading_start"), F.col("end").alias("heading_end"), F.lit("regex_match").alias("origin"), F.col("rule_id").alias("matched_rule_id")
    )


def _made(df: DataFrame, title, start, end, volume_no) -> DataFrame:
    """Chapters that have no heading of their own."""
    return df.select(
        "book_id", volume_no.cast("int").alias("volume_no"), title.alias("title"), start.alias("heading_start"), end.alias("heading_end"), "body_start", "body_end", F.lit("fallback").alias("origin"), F.lit(None).cast("string").alias("matched_rule_id")
    )


def preface_chapter(lines: DataFrame, headings: DataFrame, config: ChapterConfig = ChapterConfig()) -> DataFrame:
    """A chapter for text before a book's first heading, if any is not blank."""
    first = headings.groupBy("book_id").agg(F.min("start").alias("body_end"))
    some = lines.where("trimmed <> ''").groupBy("book_id").agg(F.min("byte_start").alias("text_start"))
    found = first.join(some, "book_id").where("text_start < body_end").withColumn("body_start", F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    return _made(found, F.lit(config.preface_title), zero, zero, F.lit(None))


def volume_preface(lines: DataFrame, bodies: DataFrame, config: ChapterConfig = ChapterConfig()) -> DataFrame:
    """A chapter for text between a volume's heading and the next, if any is not blank."""
    opened = assign_volumes(bodies).where("level = 'volume' and body_end > body_start")
    ranges = opened.select("book_id", F.col("body_start").alias("start"), F.col("body_end").alias("end"), "volume_no", F.col("end").alias("at"))
    text = lines.where("trimmed <> ''").select("book_id", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"))
    inside = assign_to_ranges(text, ranges, ["volume_no", "at"]).where("start < range_end")
    found = inside.groupBy("book_id", "volume_no", "at").agg(F.first("range_start").alias("body_start"), F.first("range_end").alias("body_end"))
    return _made(found, F.lit(config.volume_preface_title), F.col("at"), F.col("at"), F.col("volume_no"))


def fallback_chapter(books: DataFrame, headings: DataFrame, title: str = "title") -> DataFrame:
    """One chapter with the book's title for a book without any heading."""
    none = books.join(headings.select("book_id").distinct(), "book_id", "left_anti")
    none = none.withColumn("body_start", F.lit(0).cast("long")).withColumn("body_end", F.coalesce(F.octet_length("source_text").cast("long"), F.lit(0)))
    zero = F.lit(0).cast("long")
    return _made(none, F.col(title), zero, zero, F.lit(None))


def body_chars(chapters: DataFrame, lines: DataFrame) -> DataFrame:
    """chapters with n_chars, the code points of their bodies.

    Bodies begin and end at lines, so that the difference of the character offsets there is the length.
    """
    ends = lines.groupBy("book_id").agg(F.max(F.col("char_start") + F.col("n_chars") + F.col("ended").cast("int")).alias("book_chars"))
    at = lines.select("book_id", "byte_start", "char_start")
    found = chapters.join(ends, "book_id", "left")
    for side in ("start", "end"):
        spot = at.select("book_id", F.col("byte_start").alias(f"body_{side}"), F.col("char_start").alias(f"__{side}"))
        found = found.join(spot, ["book_id", f"body_{side}"], "left")
        found = found.withColumn(f"__{side}", F.coalesce(f"__{side}", "book_chars", F.lit(0)))
    return found.withColumn("n_chars", F.when(F.col("body_end") > F.col("body_start"), F.col("__end") - F.col("__start")).otherwise(0)).drop("__start", "__end", "book_chars")


def chapter_length_median(sized: DataFrame) -> DataFrame:
    """(book_id, median, n_chapters): the exact median of n_chars; of an even number the whole mean of the middle two."""
    return sized.groupBy("book_id").agg(F.floor(F.percentile("n_chars", 0.5)).alias("median"), F.count("*").alias("n_chapters"))


def oversized_chapters(sized: DataFrame, factor: float = 2.5) -> DataFrame:
    """The chapters over factor times the median of their book, if it has two or more and the median is not 0."""
    found = sized.join(chapter_length_median(sized), "book_id")
    return found.where((F.col("n_chapters") >= 2) & (F.col("median") > 0) & (F.col("n_chars") > F.floor(F.col("median") * factor))).drop("n_chapters")


def split_oversized(oversized: DataFrame, lines: DataFrame, config: ChapterConfig = ChapterConfig()) -> DataFrame:
    """What oversized chapters become: a short line with blank lines or the body's edge on both sides begins a chapter.

    The first piece keeps title, heading, origin, and rule; the others are structural. Chapters without such lines stay whole.
    """
    names = ["volume_no", "title", "heading_start", "heading_end", "origin", "matched_rule_id"]
    ranges = oversized.where("body_end > body_start").select("book_id", F.col("body_start").alias("start"), F.col("body_end").alias("end"), *names)
    spans = lines.select("book_id", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"), "line_no", "trimmed")
    inside = assign_to_ranges(spans, ranges.withColumnRenamed("title", "own_title"), ["own_title" if n == "title" else n for n in names]).where("start < range_end")
    body = Window.partitionBy("book_id", "range_start").orderBy("line_no")
    blank = F.col("trimmed") == ""
    alone = F.coalesce(F.lag(blank).over(body), F.lit(True)) & F.coalesce(F.lead(blank).over(body), F.lit(True))
    marked = inside.withColumn("splits", alone & ~blank & (F.length("trimmed") <= config.structural_chars))
    cuts = marked.where("splits")
    next_cut = F.coalesce(F.lead("start").over(body), F.col("range_end"))
    pieces = cuts.withColumn("piece_end", next_cut).withColumn("piece_start", F.least(F.col("end") + 1, "piece_end"))
    null = F.lit(None).cast("string")
    later = pieces.select(
        "book_id", "volume_no", F.col("trimmed").alias("title"), F.col("start").alias("heading_start"), F.col("end").alias("heading_end"), F.col("piece_start").alias("body_start"), F.col("piece_end").alias("body_end"), F.lit("structural").alias("origin"), null.alias("matched_rule_id")
    )
    first = cuts.groupBy("book_id", F.col("range_start").alias("body_start")).agg(F.min("start").alias("cut"))
    kept = oversized.select(*COLUMNS).join(first, ["book_id", "body_start"], "left")
    kept = kept.withColumn("body_end", F.when(F.col("body_end") > F.col("body_start"), F.coalesce("cut", "body_end")).otherwise(F.col("body_end")))
    return kept.select(*COLUMNS).unionByName(later.select(*COLUMNS))


def unsplit_chapters(books: DataFrame, lines: DataFrame, headings: DataFrame, config: ChapterConfig = ChapterConfig()) -> DataFrame:
    """Chapters of headings, prefaces, and books without headings, before oversized ones are split."""
    bodies = chapter_bodies(headings)
    own = assign_volumes(bodies).where("level = 'chapter'").select(
        "book_id", "volume_no", "title", F.col("start").alias("heading_start"), F.col("end").alias("heading_end"), "body_start", "body_end", F.lit("regex_match").alias("origin"), F.col("rule_id").alias("matched_rule_id")
    )
    parts = (preface_chapter(lines, headings, config), volume_preface(lines, bodies, config), fallback_chapter(books, headings))
    for more in parts:
        own = own.unionByName(more)
    return own


def split_long(sized: DataFrame, lines: DataFrame, config: ChapterConfig = ChapterConfig()) -> DataFrame:
    """Chapters with n_chars, with the oversized ones split."""
    large = oversized_chapters(sized, config.oversize_factor)
    key = ["book_id", "heading_start", "body_start", "body_end"]
    rest = sized.join(large.select(*key), key, "left_anti")
    return rest.select(*COLUMNS).unionByName(split_oversized(large, lines, config))


def number_chapters(every: DataFrame) -> DataFrame:
    """chapters with chapter_no, their place in reading order from 0."""
    order = Window.partitionBy("book_id").orderBy("body_start", "heading_start")
    return every.withColumn("chapter_no", F.row_number().over(order) - 1)


def chapters(books: DataFrame, lines: DataFrame, rules: DataFrame, config: ChapterConfig = ChapterConfig()) -> DataFrame:
    """All chapters of books (book_id, source_text, title), numbered in reading order from 0."""
    headings = heading_candidates(lines, rules, config.heading_chars)
    sized = body_chars(unsplit_chapters(books, lines, headings, config), lines)
    return number_chapters(split_long(sized, lines, config))


def materialize_paragraphs(lines: DataFrame, chapters: DataFrame, cleaning: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(book_id, chapter_no, para_no, text): the lines of each body with the cleaning rows inside it applied, trimmed.

    Edits apply line by line; runs of blank lines make no paragraph, so only edits within lines matter. An edit across the edge
    of a body is left out. One that goes on behind its line deletes what it covers of further lines; its replacement stands
    where it begins. Cleaning rows lie apart, as merged spans do.

    One scan by chunks of a book tells lines and edits their body, edits their line, and lines how far earlier edits reach; bodies,
    lines, and edits stand in every chunk that they reach. Lines and edits then meet by chapter, where lines are numbered.
    """
    none = lambda kind: F.lit(None).cast(kind)
    body_type, line_type, edit_type = "struct<no:long,start:long,end:long>", "struct<no:long,start:long,end:long>", "struct<start:long,end:long,replacement:string>"

    def rows(table: DataFrame, start: str, end: str, side: int, body=None, line=None, edit=None, text=None) -> DataFrame:
        held = table.select("book_id", F.inline(reaching(start, end, chunk_bytes, side)), *((none(kind) if c is None else c.cast(kind)).alias(name) for name, c, kind in (("body", body, body_type), ("line", line, line_type), ("edit", edit, edit_type), ("text", text, "string"))))
        return held.withColumn("text", F.when(F.col("side") == side, F.col("text"))) if text is not None else held

    bodies = chapters.where("body_end > body_start")
    parts = rows(bodies, "body_start", "body_end", 1, body=F.struct("chapter_no", "body_start", "body_end"))
    parts = parts.unionByName(rows(lines, "byte_start", "byte_end", 3, line=F.struct("line_no", "byte_start", "byte_end"), text=F.col("line")))
    edits = cleaning.where("kind <> 'blank_line_compression'")
    edits = rows(edits, "start", "end", 5, edit=F.struct("start", "end", "replacement"))
    # an edit that reaches into a chunk comes before the line that begins with it, one that begins there behind
    parts = parts.unionByName(edits.withColumn("side", F.when(F.col("side") == 5, 5).otherwise(0)))

    so_far = inside("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    placed = parts.repartition("book_id", "chunk").withColumns({"body": last("body"), "line": last("line"), "before": last("edit")})
    within = lambda e: (F.col(f"{e}.start") >= F.col("body.start")) & (F.col(f"{e}.end") <= F.col("body.end"))
    size, rest = F.col("line.end") - F.col("line.start"), F.col("before.end") - F.col("line.start")
    own = F.struct((F.col("edit.start") - F.col("line.start")).alias("start"), (F.least("edit.end", "line.end") - F.col("line.start")).alias("end"), F.col("edit.replacement").alias("replacement"))
    from_before = F.struct(F.lit(0).cast("long").alias("start"), F.least(rest, size).alias("end"), none("string").alias("replacement"))
    is_line = (F.col("side") == 3) & (F.col("line.start") < F.col("body.end"))
    is_edit = (F.col("side") == 5) & within("edit") & (F.col("edit.start") <= F.col("line.end"))
    cut = F.when(is_edit, own).when(within("before") & (F.col("before.start") < F.col("line.start")) & (rest > 0), from_before)
    met = placed.where(is_line | is_edit).select("book_id", F.col("body.no").cast(chapters.schema["chapter_no"].dataType).alias("chapter_no"), F.col("line.no").cast("int").alias("line_no"), "side", "text", cut.alias("cut"))

    per_line = Window.partitionBy("book_id", "chapter_no", "line_no").orderBy("side", "cut").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    read = met.repartition("book_id", "chapter_no").withColumn("cuts", F.collect_list("cut").over(per_line)).where("side = 3")
    read = read.withColumn("text", trim_unicode(spliced("text", "cuts")))
    until = Window.partitionBy("book_id", "chapter_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # counted before blank ones go, so that the filter stays above and texts are spliced once
    numbered = read.withColumn("para_no", F.count_if(F.col("text") != "").over(until).cast("int") - 1)
    return numbered.where("text <> ''").select("book_id", "chapter_no", "para_no", "text")


def chapter_stats(chapters: DataFrame, volumes: DataFrame) -> DataFrame:
    """Numbers of volumes, chapters, and chapters without a heading of their own, by book."""
    own = chapters.groupBy("book_id").agg(
        F.count("*").alias("n_chapters"), F.count_if(F.col("origin") == "fallback").alias("n_fallback"), F.count_if(F.col("origin") == "structural").alias("n_structural")
    )
    many = volumes.groupBy("book_id").agg(F.count("*").alias("n_volumes"))
    return own.join(many, "book_id", "left").na.fill(0, ["n_volumes"])


def book_tree(chapters: DataFrame, volumes: DataFrame) -> DataFrame:
    """(book_id, entries): root chapters and volumes with their chapters, in reading order, as one array."""
    item = F.struct("chapter_no", "title", "heading_start", "heading_end", "body_start", "body_end", "origin", "matched_rule_id")
    held = chapters.where("volume_no is not null").groupBy("book_id", "volume_no").agg(F.array_sort(F.collect_list(item)).alias("chapters"))
    none = F.array().cast(held.schema["chapters"].dataType)
    inner = volumes.join(held, ["book_id", "volume_no"], "left").select(
        "book_id", F.struct(F.col("heading_start").alias("at"), F.lit("volume").alias("type"), "title", F.coalesce("chapters", none).alias("chapters")).alias("entry")
    )
    root = chapters.where("volume_no is null").select(
        "book_id", F.struct(F.greatest("heading_start", F.lit(0)).alias("at"), F.lit("chapter").alias("type"), "title", F.array(item).cast(held.schema["chapters"].dataType).alias("chapters")).alias("entry")
    )
    return root.unionByName(inner).groupBy("book_id").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
