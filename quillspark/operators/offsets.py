"""Offsets of texts in bytes, code points and UTF-16 units, changed into each other by a sparse index.

The index has a row for every few KiB of a text, with what comes before it. An offset meets its piece by an equi-join on the text
and the bucket that it lies in, and only that piece is counted: long texts and many offsets of one text spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.scan import carried, inside, with_carried

#: Bytes of a text that a row of the index covers, and rows that are summed up together.
PIECE_BYTES = 4096
CHUNK_PIECES = 256
#: Bytes before a piece that stand in it too: what a character can have before its last byte.
LEAD = 3
#: Bytes of UTF-8 that go on with a character, and those that begin one of two UTF-16 units, as characters of ISO-8859-1.
GOES_ON = "".join(map(chr, range(0x80, 0xC0)))
TWO_UNITS = "".join(map(chr, range(0xF0, 0xF8)))


def _latin(raw: Column) -> Column:
    return F.decode(raw, "ISO-8859-1")


def _chars(raw: Column) -> Column:
    """Number of characters that begin in a part of a valid text, which may begin and end inside one.

    Spark's length steps from character to character; bytes that go on with the one before the part, LEAD at most, count as one each there.
    """
    going_on = F.length(F.regexp_extract(_latin(F.substring(raw, 1, LEAD)), f"^[{GOES_ON}]*", 0))
    return (F.length(raw.cast("string")) - going_on).cast("long")


def _units(raw: Column) -> Column:
    twice = F.octet_length(raw) - F.length(F.translate(_latin(raw), TWO_UNITS, ""))
    return _chars(raw) + F.when(_latin(raw).rlike(f"[{TWO_UNITS}]"), twice).otherwise(0)


def offset_index(texts: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(book_id, piece_no, n_bytes, n_chars, char_from, held, byte_at, char_at, unit_at, piece) of texts (book_id, source_text).

    Piece k has the characters that begin in the k-th piece_bytes of a text, `held` many from char_from on; its bytes begin up to LEAD
    before that, at byte_at, with char_at characters and unit_at UTF-16 units before. n_bytes and n_chars are those of the text. An empty
    text has one empty piece, a null one and one without a name none; other columns of texts are not read. Names are unique.
    """
    start, raw = lambda k: F.greatest(k * piece_bytes - LEAD, F.lit(0)), F.col("raw")
    cut = lambda raw: F.transform(F.sequence(F.lit(0), F.floor(F.octet_length(raw) / piece_bytes).cast("int")), lambda k: F.substring(raw, start(k) + 1, (k + 1) * piece_bytes - start(k)))
    named = texts.where("book_id is not null and source_text is not null").select("book_id", F.col("source_text").cast("binary").alias("raw"))
    # an array of one binds the bytes, so that they are not made anew for every piece
    pieces = named.select("book_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.posexplode(F.get(F.transform(F.array(raw), cut), F.lit(0))).alias("piece_no", "piece"))
    pieces = pieces.withColumn("chunk", F.floor(F.col("piece_no") / CHUNK_PIECES)).repartition("book_id", "chunk")
    byte_at = start(F.col("piece_no").cast("long"))
    lead = F.substring("piece", F.lit(1), (F.col("piece_no").cast("long") * piece_bytes - byte_at).cast("int"))
    counted = pieces.withColumns({"lead_chars": _chars(lead), "lead_units": _units(lead)})
    counted = counted.withColumns({"held": _chars(F.col("piece")) - F.col("lead_chars"), "units": _units(F.col("piece")) - F.col("lead_units")})
    until = inside("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c: F.coalesce(F.sum(c).over(until), F.lit(0))
    placed = counted.withColumns({"char_run": run("held"), "unit_run": run("units")})
    sums = counted.groupBy("book_id", "chunk").agg(F.sum("held").alias("held"), F.sum("units").alias("units"))
    found = with_carried(placed, carried(sums, before_chars=F.sum("held"), before_units=F.sum("units")))
    total = sums.groupBy("book_id").agg(F.sum("held").alias("n_chars"))
    at = lambda a, b: F.coalesce(a, F.lit(0)) + F.col(b)
    return found.join(total, "book_id").select(
        "book_id", "piece_no", "n_bytes", "n_chars", at("before_chars", "char_run").alias("char_from"), "held", byte_at.alias("byte_at"),
        (at("before_chars", "char_run") - F.col("lead_chars")).alias("char_at"), (at("before_units", "unit_run") - F.col("lead_units")).alias("unit_at"), "piece",
    )


def _clamped(offsets: DataFrame, index: DataFrame, name: str, size: str) -> DataFrame:
    """(row, book_id, at, n_bytes, n_chars): rows of offsets with the offset moved into its text; null where that is not known."""
    sizes = index.where("piece_no = 0").select("book_id", "n_bytes", "n_chars")
    rows = offsets.select(F.struct(*offsets.columns).alias("row"), "book_id", F.col(name).cast("long").alias("at")).join(sizes, "book_id", "left")
    return rows.withColumn("at", F.when(F.col("at").isNotNull() & F.col(size).isNotNull(), F.least(F.greatest("at", F.lit(0)), F.col(size))))


def _with(row: DataFrame, columns: list[str], **more: Column) -> DataFrame:
    return row.select(*(F.col("row")[c].alias(c) for c in columns if c not in more), *(v.alias(k) for k, v in more.items()))


def bytes_to_chars(offsets: DataFrame, index: DataFrame, byte: str = "byte", char: str = "char", utf16: str = "utf16", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """offsets (book_id, byte, ...) with the code points and the UTF-16 units before each; columns so named give way.

    An offset inside a character counts as the character's start, one outside the text is clamped; the result is null where the offset
    is, or the text not known. Repeated rows stay. The index has to be of the same piece_bytes.
    """
    at = _clamped(offsets, index, byte, "n_bytes").withColumn("piece_no", F.floor(F.col("at") / piece_bytes).cast("int"))
    met = at.join(index.select("book_id", "piece_no", "byte_at", "char_at", "unit_at", "piece"), ["book_id", "piece_no"], "left")
    off = (F.col("at") - F.col("byte_at")).cast("int")
    goes_on = lambda back: F.hex(F.substring("piece", off + 1 - back, F.lit(1))).rlike("^[89AB]")
    back = F.when(~goes_on(0), 0).when(~goes_on(1), 1).when(~goes_on(2), 2).otherwise(3)
    headed = met.withColumn("head", F.substring(F.col("piece"), F.lit(1), off - back))
    return _with(headed, offsets.columns, **{char: F.col("char_at") + _chars(F.col("head")), utf16: F.col("unit_at") + _units(F.col("head"))})


def chars_to_bytes(offsets: DataFrame, index: DataFrame, char: str = "char", byte: str = "byte", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """offsets (book_id, char, ...) with the bytes before each code point; clamped, null, and repeated as in bytes_to_chars."""
    at = _clamped(offsets, index, char, "n_chars").withColumn("bucket", F.floor(F.col("at") / piece_bytes))
    # a piece holds no more characters than bytes, and so lies in one or two buckets of as many characters
    last = F.col("char_from") + F.col("held") - 1
    spread = index.where("held > 0").select("book_id", F.explode(F.sequence(F.floor(F.col("char_from") / piece_bytes), F.floor(last / piece_bytes))).alias("bucket"), "char_from", last.alias("char_last"), "byte_at", "char_at", "piece")
    met = at.alias("o").join(spread.alias("p"), (F.col("o.book_id") == F.col("p.book_id")) & (F.col("o.bucket") == F.col("p.bucket")) & F.col("o.at").between(F.col("p.char_from"), F.col("p.char_last")), "left")
    skip = F.length(F.regexp_extract(F.decode("piece", "ISO-8859-1"), r"^[\x{80}-\x{BF}]*", 0))
    text = F.substring(F.col("piece"), skip + 1, F.octet_length("piece")).cast("string")
    found = F.col("byte_at") + skip + F.octet_length(F.substring(text, F.lit(1), (F.col("at") - F.col("char_at")).cast("int")))
    return _with(met, offsets.columns, **{byte: F.when(F.col("at") == F.col("n_chars"), F.col("n_bytes")).otherwise(found)})
