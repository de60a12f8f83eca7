"""What several of these operators share: written intermediate tables, components, and the splitting of large buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.tables import materialize, release, shared_dir  # noqa: F401 - the operators take these from here

stash = materialize

#: Of the texts that go to a Python worker at once. Spark's own limits are 10,000 rows and 64 MB, which the JVM and the worker hold a few times over.
ARROW_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session end at ARROW_BYTES, also after the call, since a plan asks for it when it runs; a limit that was set before stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ARROW_BYTES)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile gives its shuffle files back as soon as it is written, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_kept: dict[object, object] = {}


def per_worker(key: object, make: Callable[[], object]) -> object:
    """What make gives, kept by a Python worker for its next tasks: only the last key's, so that what the stages of a pipeline keep does not add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def merge_links(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Let label hold the smallest index that each position reaches, once the links i-j are added."""
    while len(i):
        low = np.minimum(label[i], label[j])
        apart = label[i] != label[j]
        if not apart.any():
            break
        i, j, low = i[apart], j[apart], low[apart]
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the columns a and b of long ids: component is the smallest id reachable.

    Alternates large-star and small-star steps until the edges stay as they are. Every round is a few
    aggregations with map-side combining and equi-joins, and is written out. Nulls and loops are ignored;
    nodes without an edge have no row; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    now = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    now, before = stash(now.distinct()), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        old = now
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stash(small.union(low).distinct())
        release(old, large)
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)


def spread_buckets(df: DataFrame, limit: int, weight: Column | None = None) -> DataFrame:
    """Split buckets of over `limit` rows, or of a sum of weights over it, into pairs of tiles.

    df has the columns bucket and salt (a hash of what makes the row). A bucket of s tiles becomes
    s * (s + 1) / 2 groups (bucket, lo, hi): a row of tile t goes to each group that names t, so that every
    pair of rows meets in exactly one group where the two tiles differ, and in (t, t) where they don't.
    """
    sizes = df.groupBy("bucket").agg((F.count("*") if weight is None else F.sum(weight)).alias("count")).where(F.col("count") > limit)
    sizes = sizes.select("bucket", F.ceil(F.col("count") / limit).cast("int").alias("tiles"))
    tiled = df.join(sizes, "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod("salt", F.col("tiles").cast("bigint")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = tiled.withColumn("other", other)
    return tiled.select(
        *df.columns, "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")
    )


def hash_bound(n: int, bound: int) -> float:
    """The share of rows to draw so that about `bound` of n are drawn."""
    return 1.0 if n <= bound else bound / n


def is_training(doc_id) -> F.Column:
    """Whether labels of this document may be learned from: crc32 of the id as text is no multiple of five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(True))
