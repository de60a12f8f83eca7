"""Spans: merging, assignment to disjoint ranges, and applying edits to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.scan import CHUNK_BYTES, carried, chunked, inside, with_carried


def kind_priority(kind: str | Column = "kind") -> Column:
    """Which kind a merged span takes: formats first, then keyword, repetition, and script."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return (
        F.when(kind == "watermark_keyword", 3).when(kind == "watermark_repetition", 2).when(kind == "watermark_non_cjk", 1).otherwise(10)
    )


def reaching(start: str, end: str, chunk_bytes: int, side: int) -> Column:
    """Rows (chunk, at, side) that put something from start to end into every chunk that it reaches: as it is where it begins,
    and with a smaller side at the beginning of each further one. A row more is made for each chunk_bytes that are covered."""
    first, last = F.floor(F.col(start) / chunk_bytes), F.floor(F.greatest(start, end) / chunk_bytes)
    here = lambda k: F.struct(k.alias("chunk"), F.greatest(F.col(start), k * chunk_bytes).alias("at"), F.when(k == first, side).otherwise(side - 1).alias("side"))
    return F.transform(F.sequence(first, last), here)


def drop_contained(spans: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Spans (book_id, start, end, ...) without those that lie inside an earlier one, by start and then end.

    A span also stands at the beginning of each further chunk of the book that it reaches, so that chunks are looked at alone.
    """
    rows = spans.select("book_id", "start", "end", "kind", F.struct(*spans.columns).alias("row"))
    rows = rows.select("*", F.inline(reaching("start", "end", chunk_bytes, 1))).repartition("book_id", "chunk")
    before = inside("at", "side", "start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("reach", F.max("end").over(before)).where("side = 1")
    return marked.where("reach is null or end > reach").select("row.*")


def merge_spans(spans: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(book_id, start, end, kind, replacement): overlapping spans become one.

    Adjacent spans stay apart. A merged span takes kind and replacement of the highest priority, the first by
    start and end where several have it.

    Spans are merged inside each chunk of a book. Of a chunk's runs only the last can reach beyond it, and those of later
    chunks that begin before its end belong to it: how far the chunks before reach, and where the run that does begins, is
    known from one row a chunk.
    """
    rows = chunked(spans.select("book_id", "start", "end", "kind", "replacement"), "start", chunk_bytes)
    order = inside("start", "end", "kind", "replacement")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    best = F.min(F.struct((-kind_priority()).alias("p"), "start", "end", "kind", "replacement"))
    runs = marked.groupBy("book_id", "chunk", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("best"))

    last = runs.groupBy("book_id", "chunk").agg(F.max(F.struct("start", "end", "run", "best")).alias("last"))
    last = last.select("book_id", "chunk", F.col("last.start").alias("start"), F.col("last.end").alias("end"))
    earlier = Window.partitionBy("book_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("reach", F.max("end").over(earlier)).withColumn("opened", F.when(F.col("reach").isNull() | (F.col("start") >= F.col("reach")), F.col("start")))
    before = carried(last, carry=F.max("end"), opened=F.last("opened", ignorenulls=True))
    placed = with_carried(runs, before).withColumn("key", F.when(F.col("start") < F.col("carry"), F.col("opened")).otherwise(F.col("start")))
    merged = placed.groupBy("book_id", "key").agg(F.max("end").alias("end"), F.min("best").alias("best"))
    return merged.select("book_id", F.col("key").alias("start"), "end", "best.kind", "best.replacement")


def assign_to_ranges(spans: DataFrame, ranges: DataFrame, names: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """spans with the columns `names` and range_start, range_end of that of the disjoint ranges (book_id, start, end) which holds
    the span's start or ends there; of two that touch there the later; null where none does.

    An as-of fill over the union, not a range join. A range also stands at the beginning of each further chunk of the book that
    it reaches, so that chunks are filled alone.
    """
    own = F.struct("start", "end", *names)
    none = lambda df, what: F.lit(None).cast(df.select(what.alias("x")).schema["x"].dataType)
    row, at = F.struct(*spans.columns), F.col("start")
    left = spans.select("book_id", F.floor(at / chunk_bytes).alias("chunk"), at.alias("at"), F.lit(1).alias("side"), row.alias("row"), none(ranges, own).alias("range"))
    right = ranges.select("book_id", F.inline(reaching("start", "end", chunk_bytes, 0)), none(spans, row).alias("row"), own.alias("range"))
    rows = left.unionByName(right).repartition("book_id", "chunk")
    until = inside("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("r", F.last("range", ignorenulls=True).over(until)).where("side = 1")
    held = filled.withColumn("r", F.when(F.col("at") <= F.col("r.end"), F.col("r")))
    return held.select("row.*", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"), *(F.col(f"r.{n}").alias(n) for n in names))


def _apart(edits: Column) -> Column:
    """Sorted edits without those that begin before the end of the last one that is kept."""
    before = lambda i: F.coalesce(F.get(edits, i - 1)["end"], F.lit(0))
    overlap = F.exists(F.transform(edits, lambda e, i: e["start"] < before(i)), lambda x: x)
    none = F.struct(F.lit(0).cast("long").alias("at"), F.filter(edits, lambda e: F.lit(False)).alias("kept"))
    add = lambda acc, e: F.struct(e["end"].cast("long").alias("at"), F.array_append(acc["kept"], e).alias("kept"))
    return F.when(overlap, F.aggregate(edits, none, lambda acc, e: F.when(e["start"] < acc["at"], acc).otherwise(add(acc, e)), lambda acc: acc["kept"])).otherwise(edits)


def spliced(text: str | Column, edits: str | Column) -> Column:
    """text with sorted edits (start, end, replacement), spans in bytes, put in place of what they cover; null replacements delete.

    The pieces between the edits are slices of the text's bytes, which with the replacements are joined once. An edit that begins
    before the end of the last one applied is skipped; edits that overlap, which merged spans do not, are picked one by one and
    take time by the square of their number. Null edits leave the text as it is, and a null text stays null.
    """
    text, edits = (F.col(c) if isinstance(c, str) else c for c in (text, edits))

    def joined(x: Column) -> Column:
        raw, own = x["raw"], x["edits"]
        cut = lambda start, end: F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string")
        end_of = lambda i: F.coalesce(F.get(own, i)["end"], F.lit(0))
        pieces = F.transform(own, lambda e, i: F.concat(cut(end_of(i - 1), e["start"]), F.coalesce(e["replacement"], F.lit(""))))
        return F.concat(F.array_join(pieces, ""), cut(end_of(F.size(own) - 1), F.octet_length(raw)))

    # an array of one binds the bytes and the edits, so that they are made once and not for every piece
    bound = F.transform(F.array(edits), lambda e: F.struct(text.cast("binary").alias("raw"), _apart(e).alias("edits")))
    return F.when(edits.isNull() | text.isNull() | (F.size(edits) == 0), text).otherwise(F.get(F.transform(bound, joined), F.lit(0)))


def apply_spans(texts: DataFrame, spans: DataFrame, keys: list[str], text: str = "source_text") -> DataFrame:
    """texts with `cleaned`: its text with the spans (keys, start, end, replacement) of the same keys applied.

    Offsets are bytes of the text; edits of one text meet in one row, whose text they belong to.
    """
    edits = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("__edits"))
    return texts.join(edits, keys, "left").withColumn("cleaned", spliced(text, "__edits")).drop("__edits")
