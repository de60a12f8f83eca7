"""Intermediate tables that several operators read: written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder in local mode; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
    return _own["dir"]


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back, which cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.written_to = path
    return read


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote, once all that reads them has been written out itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
