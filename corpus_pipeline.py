"""Five curation stages over the documents, each written and reread as the next one's input.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A null
or empty text is `und` and goes in the first stage; a table without rows passes through all of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, langid, lines, simhash
from quillspark.llm.common import bound_batches, shared_dir
from quillspark.llm.queries import encode_digests


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; prototypes are learned from the labelled rows of docs."""
    bound_batches(spark)
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier line within two edits; documents left without any but blank lines go."""
    return lines.drop_repeated(docs, k=2, min_chars=32)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by similarities of 0.8 or more in five-word shingles."""
    bound_batches(spark)
    return simhash.keep_one(docs, width=5, radius=20, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item and no edited copy of one."""
    bound_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with number of tokens and digests of ids and of the decoded bytes."""
    bound_batches(spark)
    return encode_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Learned prototypes, edit distances, SimHash, alignment and BPE are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
