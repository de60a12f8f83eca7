"""Where a model or a search service takes part: requests go out in batches, and what was answered is kept in a log.

A service is a function from a list of requests to a list of replies. The log, a Parquet table in a shared folder, is keyed by a
hash of service and request, so that a rerun asks nothing that has been answered.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Service = Callable[[list[str]], list[str | None]]
LOG = "key string, request string, reply string, error string, attempts int"


def say_nothing(requests: list[str]) -> list[str | None]:
    """The service where none is set up: no request has a reply."""
    return [None] * len(requests)


def asked(service: Service, requests: list[str], attempts: int, wait: float) -> tuple[list[str | None], str | None, int]:
    """The replies to a batch, what went wrong at last, and how often it was tried; the time between tries doubles."""
    error = None
    for n in range(1, attempts + 1):
        try:
            replies = list(service(requests))
            if len(replies) != len(requests):
                raise ValueError(f"{len(replies)} replies to {len(requests)} requests")
            return replies, None, n
        except Exception as e:  # whatever a service raises is tried again, and told in the log
            error = f"{type(e).__name__}: {e}"
            if n < attempts:
                time.sleep(wait * 2 ** (n - 1))
    return [None] * len(requests), error, attempts


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log at a path; empty where nothing has been written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LOG).parquet(path) if there else spark.createDataFrame([], LOG)


def answered(log: DataFrame) -> DataFrame:
    """(key, reply) of the requests in a log that have a reply, one row each."""
    return log.where("reply is not null").groupBy("key").agg(F.min("reply").alias("reply"))


def ask(
    requests: DataFrame, log: str, service: Service = say_nothing, name: str = "model", *, batch: int = 20, attempts: int = 3, wait: float = 1.0, waves: int = 1, tasks: int | None = None
) -> DataFrame:
    """requests (request, ...) with `reply`, which is null where the service gave none.

    Equal requests are asked once, `batch` at a time, by `tasks` tasks side by side; a batch that fails is tried `attempts` times. Replies
    are added to the log after each of `waves` shares of the requests, which is what a lost run can lose; what failed is told there too,
    and asked again by the next run. A task that is lost asks its own part again. Null requests are not asked. A column
    `reply` that requests has gives way.
    """
    spark = requests.sparkSession
    key = F.sha2(F.concat(F.lit(name), F.lit("\n"), F.col("request")), 256)
    new = requests.where("request is not null").groupBy(key.alias("key")).agg(F.min("request").alias("request"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                replies, error, n = asked(service, list(part["request"]), attempts, wait)
                yield pd.DataFrame({"key": part["key"].array, "request": part["request"].array, "reply": replies, "error": error, "attempts": n})

    for wave in range(waves if service is not say_nothing else 0):
        share = new.where(F.pmod(F.crc32("key"), F.lit(waves)) == wave)
        left = share.join(answered(read_log(spark, log)), "key", "left_anti")
        left = left.repartition(tasks, "key") if tasks else left
        left.mapInPandas(each, LOG).write.mode("append").parquet(log)
    replies = answered(read_log(spark, log)).withColumnsRenamed({"key": "__key", "reply": "__reply"})
    own = [F.col("row")[c].alias(c) for c in requests.columns if c != "reply"]
    rows = requests.select(F.struct(*requests.columns).alias("row"), key.alias("key"))
    return rows.join(replies, F.col("key") == F.col("__key"), "left").select(*own, F.col("__reply").alias("reply"))
