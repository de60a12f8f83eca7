"""Books that queries derive from the conversations table, with all that the operators look for.

A book is a conversation and a chapter one of its turns; volumes, prefaces, indents, runs of blanks and of blank lines, control
characters and a line of boilerplate are put in by rules on conversation and turn that SQL states as well.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import CleaningConfig
from quillspark.operators import chapters, cleaning, lines, rules, watermark
from quillspark.tables import materialize, release

BOILERPLATE = "本文首发于 https://example.com/novel 更新最快"
IDEOGRAPHIC = "　"


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, title, source_text) of all conversations."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id is not null and turn is not null and text is not null")
    turn, conv = F.col("turn"), F.col("conv_id")
    plain = conv % 7 == 3
    dirty = F.replace(F.replace("text", F.lit(", "), F.lit("," + IDEOGRAPHIC * 2)), F.lit("\n"), F.lit("  \n\n\n\n"))
    dirty = F.when(turn % 3 == 0, F.replace(dirty, F.lit(". "), F.lit(".\x01 "))).otherwise(dirty)
    part = F.concat(
        F.when((turn == 0) & (conv % 3 == 0) & ~plain, "开篇的话\n").otherwise(""),
        F.when((turn % 4 == 0) & ~plain, F.concat(F.lit("第"), F.floor(turn / 4) + 1, F.lit("卷\n"))).otherwise(""),
        F.when((turn % 4 == 0) & (conv % 5 == 1) & ~plain, "卷首语一行\n").otherwise(""),
        F.when(plain, "").otherwise(F.concat(F.lit("第"), turn + 1, F.lit("章 "), F.coalesce("role", F.lit("")), F.lit("\n"))),
        F.when(turn % 2 == 1, IDEOGRAPHIC * 2).otherwise(""),
        dirty,
        F.lit(f"\n{BOILERPLATE}\n"),
    )
    told = turns.select("conv_id", F.struct("turn", part.alias("t")).alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return told.select(F.col("conv_id").alias("book_id"), F.concat(F.lit("Book "), "conv_id").alias("title"), F.array_join(F.col("ps.t"), "").alias("source_text"))


def document_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, title, source_text) of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("book_id"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("text").alias("source_text"))


class Curation:
    """The tables of one curation run, each derived from the books when first asked for.

    Lines, chapters, and boilerplate rows are read by many operators and so written out once; close() deletes them.
    """

    def __init__(self, books: DataFrame, config: CleaningConfig = CleaningConfig.everything()):
        self.books, self.config = books, config
        self.written: list[DataFrame] = []

    def _kept(self, table: DataFrame) -> DataFrame:
        self.written.append(materialize(table))
        return self.written[-1]

    def close(self) -> None:
        """Delete what was written for this run, once all that reads it has been written out itself."""
        release(*self.written)
        self.written.clear()

    @cached_property
    def rules(self) -> DataFrame:
        return rules.builtin_rules(self.books.sparkSession)

    @cached_property
    def lines(self) -> DataFrame:
        return self._kept(lines.split_lines(self.books))

    @cached_property
    def headings(self) -> DataFrame:
        return self._kept(rules.heading_candidates(self.lines, self.rules))

    @cached_property
    def unsplit(self) -> DataFrame:
        return chapters.body_chars(chapters.unsplit_chapters(self.books, self.lines, self.headings), self.lines)

    @cached_property
    def chapters(self) -> DataFrame:
        return self._kept(chapters.number_chapters(chapters.split_long(self._kept(self.unsplit), self.lines)))

    @cached_property
    def volumes(self) -> DataFrame:
        return chapters.volumes(self.headings)

    @cached_property
    def heading_starts(self) -> DataFrame:
        return watermark.heading_starts(self.chapters, self.volumes)

    @cached_property
    def watermarks(self) -> DataFrame:
        return self._kept(watermark.watermarks(self.lines, self.rules, self.heading_starts))

    @cached_property
    def cleaning(self) -> DataFrame:
        return self._kept(cleaning.cleaning_annotations(self.lines, self.config))

    @cached_property
    def merged(self) -> DataFrame:
        return self._kept(watermark.merge_auto_into_cleaning(self.cleaning, self.watermarks))

    @cached_property
    def paragraphs(self) -> DataFrame:
        return chapters.materialize_paragraphs(self.lines, self.chapters, self.merged)
