"""Lines of books with byte and character offsets: the table that nearly everything else reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import trim_unicode
from quillspark.operators.scan import CHUNK_BYTES, carried, with_carried

LINE_COLUMNS = ("book_id", "line_no", "line", "trimmed", "n_chars", "byte_start", "byte_end", "char_start", "ended", "n_bytes")
#: A text is only cut where a character begins, which is up to three bytes before any place.
LEAST_CHUNK = 4


def _cuts(raw: memoryview, chunk_bytes: int) -> list[int]:
    """Where to cut a text: the last places up to each multiple of chunk_bytes where a character of UTF-8 begins, and both ends."""
    out = [0]
    for at in range(chunk_bytes, len(raw), chunk_bytes):
        while raw[at] & 0xC0 == 0x80:
            at -= 1
        out.append(at)
    return [*out, len(raw)]


def text_chunks(books: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two tables (book_id, n_bytes, n_chunks, chunk, byte_start, piece) of books (book_id, source_text): short texts, whole, and
    those over chunk_bytes in pieces of about that size.

    Pieces are cut between characters. Null and empty texts have none. Only long texts go through Arrow, where a piece is
    a slice; columns of Spark would copy the whole text for each.
    """
    chunk_bytes = max(chunk_bytes, LEAST_CHUNK)
    sized = books.select("book_id", F.octet_length("source_text").cast("long").alias("n_bytes"), F.col("source_text").alias("piece")).where("n_bytes > 0")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    short = sized.where(F.col("n_bytes") <= chunk_bytes).select("book_id", "n_bytes", one.alias("n_chunks"), zero.alias("chunk"), zero.alias("byte_start"), "piece")
    names = short.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                raw = memoryview(rows.column(2)[k].as_buffer())
                cuts = _cuts(raw, chunk_bytes)
                n = len(cuts) - 1
                for chunk, (start, end) in enumerate(zip(cuts, cuts[1:])):
                    own = [rows.column(0).slice(k, 1), rows.column(1).slice(k, 1), *(pa.array([x], pa.int64()) for x in (n, chunk, start))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([bytes(raw[start:end])], pa.string())], names=names)

    return short, sized.where(F.col("n_bytes") > chunk_bytes).mapInArrow(each, short.schema)


def split_lines(books: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per line of books (book_id, source_text), without the newline.

    A newline at the end opens no further line; null and empty texts have no lines. `ended` tells whether a newline
    follows, n_bytes is the book's size.

    A text is cut into chunks, dealt out by book and chunk before they are split, which is the only exchange of texts; what
    comes before a chunk is summed up over the chunks of long books and joined back. A line over the edge of chunks
    is put together from its parts.
    """
    short, long = text_chunks(books, chunk_bytes)
    breaks = F.octet_length("piece") - F.octet_length(F.replace("piece", F.lit("\n"), F.lit("")))
    counted = long.withColumns({"breaks": breaks.cast("long"), "chars": F.length("piece").cast("long")})
    before = carried(counted.select("book_id", "chunk", "breaks", "chars"), first_line=F.sum("breaks"), first_char=F.sum("chars"))
    zeros = lambda df: df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("first_line", "first_char")})

    dealt = zeros(with_carried(short.unionByName(long).repartition("book_id", "chunk"), before)).withColumn("parts", F.split("piece", "\n", -1))
    dealt = dealt.withColumn("last", F.size("parts") - 1).drop("piece")
    parts = dealt.select(*(c for c in dealt.columns if c != "parts"), F.posexplode("parts").alias("i", "line"))
    earlier = Window.partitionBy("book_id", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c: F.coalesce(F.sum(c.cast("long") + 1).over(earlier), F.lit(0))
    # trimmed below the window, so that what reads it many times does not trim many times
    placed = parts.withColumn("trimmed", trim_unicode("line"))
    placed = placed.withColumns({"at_byte": F.col("byte_start") + run(F.octet_length("line")), "at_char": F.col("first_char") + run(F.length("line"))})
    ended = F.col("i") < F.col("last")
    torn = ((F.col("i") == 0) & (F.col("chunk") > 0)) | (~ended & (F.col("chunk") < F.col("n_chunks") - 1))
    whole = placed.where(~torn).select("book_id", "n_bytes", (F.col("first_line") + F.col("i")).alias("line_no"), "line", "trimmed", "at_byte", "at_char", ended.alias("ended"))
    every = whole.unionByName(_mended(zeros(with_carried(counted, before)))).where("ended or line <> ''")
    return every.select(
        "book_id", F.col("line_no").cast("int").alias("line_no"), "line", "trimmed", F.length("line").alias("n_chars"), F.col("at_byte").alias("byte_start"),
        (F.col("at_byte") + F.octet_length("line")).alias("byte_end"), F.col("at_char").alias("char_start"), "ended", "n_bytes",
    )


def _mended(long: DataFrame) -> DataFrame:
    """The lines of long books that go over the edge of a chunk, from the ends of the chunks that they touch."""
    head, tail = F.substring_index("piece", "\n", 1), F.substring_index("piece", "\n", -1)
    part = lambda line_no, line, at_byte, at_char, ended: F.struct(line_no.alias("line_no"), line.alias("line"), at_byte.alias("at_byte"), at_char.alias("at_char"), F.lit(ended).alias("ended"))
    broken = F.col("breaks") > 0
    first = part(F.col("first_line"), head, F.col("byte_start"), F.col("first_char"), True)
    rest_byte, rest_char = F.octet_length("piece") - F.octet_length(tail), F.col("chars") - F.length(tail)
    last = part(F.col("first_line") + F.col("breaks"), tail, F.col("byte_start") + rest_byte, F.col("first_char") + rest_char, False)
    ends = F.when(~broken, F.array(last)).otherwise(F.array_compact(F.array(F.when(F.col("chunk") > 0, first), F.when(F.col("chunk") < F.col("n_chunks") - 1, last))))
    parts = long.select("book_id", "n_bytes", "chunk", F.inline(ends))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "line"))), lambda p: p["line"]), "")
    found = parts.groupBy("book_id", "n_bytes", "line_no").agg(whole.alias("line"), F.min("at_byte").alias("at_byte"), F.min("at_char").alias("at_char"), F.max("ended").alias("ended"))
    return found.withColumn("trimmed", trim_unicode("line"))


def book_profile(books: DataFrame, cleaning: DataFrame | None = None, chapters: DataFrame | None = None) -> DataFrame:
    """Characters and bytes of every book, its encoding where books tell it, and how many cleaning rows and chapters it has."""
    out = books.select(
        "book_id",
        *(c for c in ("source_encoding",) if c in books.columns),
        F.length("source_text").cast("long").alias("n_chars"),
        F.octet_length("source_text").cast("long").alias("n_bytes"),
    )
    for table, name in ((cleaning, "n_cleaning"), (chapters, "n_chapters")):
        if table is not None:
            counts = table.groupBy("book_id").agg(F.count("*").alias(name))
            out = out.join(counts, "book_id", "left").na.fill(0, [name])
    return out
