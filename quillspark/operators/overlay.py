"""Annotations against lines and against the whole book: highlighted segments and a density ruler."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.spans import assign_to_ranges


def overlap_lines(lines: DataFrame, layers: DataFrame) -> DataFrame:
    """(book_id, line_no, s, e, layer): spans (book_id, start, end, layer) cut to each line that they meet, offsets from its start."""
    ranges = lines.select("book_id", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"), "line_no")
    first = assign_to_ranges(layers.select("book_id", "start", "end", "layer"), ranges, ["line_no"]).withColumnRenamed("line_no", "first_line")
    ends = first.select("book_id", (F.col("end") - 1).alias("start"), F.col("end"), "layer", F.col("start").alias("own_start"), "first_line").where("end > own_start")
    both = assign_to_ranges(ends, ranges, ["line_no"])
    spread = both.select("book_id", "own_start", "end", "layer", F.explode(F.sequence("first_line", "line_no")).alias("line_no"))
    joined = spread.join(lines.select("book_id", "line_no", "byte_start", "byte_end"), ["book_id", "line_no"])
    cut = joined.select("book_id", "line_no", (F.greatest("own_start", "byte_start") - F.col("byte_start")).alias("s"), (F.least("end", "byte_end") - F.col("byte_start")).alias("e"), "layer")
    return cut.where("e > s")


def highlight_segments(lines: DataFrame, layers: DataFrame) -> DataFrame:
    """(book_id, line_no, seg_no, text, layer): each line in segments; layer is null where nothing is highlighted.

    Spans are taken by start, then the longer first; one that begins before the end of the last taken is skipped.
    """
    item = F.struct("s", (-F.col("e")).alias("n"), "layer")
    held = overlap_lines(lines, layers).groupBy("book_id", "line_no").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    kind = "struct<at:bigint,out:array<struct<s:bigint,e:bigint,layer:string>>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint,layer:string>>").alias("out")).cast(kind)

    def take(acc, x):
        s, e = x["s"], -x["n"]
        gap = F.when(s > acc["at"], F.array(F.struct(acc["at"].alias("s"), s.alias("e"), F.lit(None).cast("string").alias("layer")))).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,layer:string>>"))
        more = F.concat(acc["out"], gap, F.array(F.struct(s.alias("s"), e.alias("e"), x["layer"].alias("layer"))))
        return F.when(s < acc["at"], acc).otherwise(F.struct(e.alias("at"), more.alias("out")).cast(kind))

    joined = lines.join(held, ["book_id", "line_no"], "left").withColumn("size", F.octet_length("line").cast("long"))
    empty = F.array().cast(held.schema["xs"].dataType)
    done = joined.withColumn("acc", F.aggregate(F.coalesce("xs", empty), start, take))
    tail = F.when((F.col("acc.at") < F.col("size")) | (F.col("size") == 0), F.array(F.struct(F.col("acc.at").alias("s"), F.col("size").alias("e"), F.lit(None).cast("string").alias("layer")))).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,layer:string>>"))
    parts = done.select("book_id", "line_no", "line", F.posexplode(F.concat("acc.out", tail)).alias("seg_no", "p"))
    text = F.decode(F.substring(F.encode("line", "UTF-8"), (F.col("p.s") + 1).cast("int"), (F.col("p.e") - F.col("p.s")).cast("int")), "UTF-8")
    return parts.select("book_id", "line_no", "seg_no", text.alias("text"), F.col("p.layer").alias("layer"))


def density_ruler(layers: DataFrame, books: DataFrame, height: int = 200, least: int = 2) -> DataFrame:
    """(book_id, layer, bucket, n, longest): spans by where in the book they begin, on a ruler of so many steps."""
    sized = layers.join(books.select("book_id", F.octet_length("source_text").cast("long").alias("total")), "book_id").where("total > 0")
    bucket = F.floor(F.col("start") / F.col("total") * height)
    size = F.greatest(F.lit(least), F.ceil((F.col("end") - F.col("start")) / F.col("total") * height))
    return sized.groupBy("book_id", "layer", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max(size).alias("longest"))
