"""Running values over a book in two levels, so that a long book is the work of many tasks.

A book's rows are cut into chunks by their place. Within a chunk a window gives the running value; each chunk is summed up in
one row, and a second window over these few rows gives what every chunk starts from, which is joined back. Sums,
maxima and last values can be run this way, as what is carried into a chunk combines with what is found inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a book that one chunk covers: a few ten thousand lines, and a task's share of a very long book.
CHUNK_BYTES = 1 << 20


def chunked(rows: DataFrame, at: str, chunk_bytes: int) -> DataFrame:
    """rows with chunk, by the byte offset in the column `at`, dealt out by book and chunk.

    What reads the result more than once shares the exchange, as long as it asks for all columns.
    """
    return rows.withColumn("chunk", F.floor(F.col(at) / chunk_bytes)).repartition("book_id", "chunk")


def inside(*order) -> Window:
    """The window over one chunk of a book."""
    return Window.partitionBy("book_id", "chunk").orderBy(*order)


def carried(sums: DataFrame, **values: Column) -> DataFrame:
    """(book_id, chunk, …) with what comes before each chunk of a book but the first.

    sums has one row for each book and chunk; the values are aggregates over all chunks before. The first chunk of a book
    has no row, so that books of one chunk, as most are, have nothing to join.
    """
    before = Window.partitionBy("book_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("book_id").orderBy("chunk")) == 1
    found = sums.withColumns({name: value.over(before) for name, value in values.items()} | {"__first": first})
    return found.where("not __first").select(F.col("book_id").alias("__book"), F.col("chunk").alias("__chunk"), *values)


def with_carried(rows: DataFrame, before: DataFrame) -> DataFrame:
    """rows with what is carried into their chunk; null in a book's first. Books without a name are a book."""
    same = F.col("book_id").eqNullSafe(F.col("__book")) & (F.col("chunk") == F.col("__chunk"))
    return rows.join(before, same, "left").drop("__book", "__chunk")
