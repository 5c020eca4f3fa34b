"""Shared scratch space: the folder that the cluster names in ``spark.checkpoint.dir``.

Iterative and multi-pass operators cut lineage by writing Parquet there and
reading it back, so that the loss of an executor costs one stage at most.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only on one machine where none is configured (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"overlapse-{os.getuid()}")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_dir(spark: SparkSession) -> str:
    """Where this application's tables lie."""
    return f"{base_dir(spark)}/overlapse/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    # long columns that don't repeat are stored as packed differences
    writer = df.write.option("compression", "zstd").option("parquet.writer.version", "v2")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def built_on(df: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``df``, of which ``remove`` deletes the written ``tables`` that it reads; ``df`` may be one of them."""
    out = df.select("*")
    out.scratch_tables = tables
    return out


def remove(df: DataFrame, partition: str = "") -> None:
    """Delete a table that ``materialise`` wrote, or a partition of it, once nothing reads it any more."""
    for table in getattr(df, "scratch_tables", ()):
        remove(table)
    path = getattr(df, "scratch_path", None)
    if path:
        _delete(df.sparkSession, f"{path}/{partition}" if partition else path)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application, those too that results still read: to be called at its end."""
    _delete(spark, scratch_dir(spark))


def release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of plans that are gone; to be called once a step's result is written.

    It takes two rounds: what the first one finds unreachable still holds the shuffles until the second.
    """
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.2)
