"""Tables and folders that driver and executors share, in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder under /tmp on a local master only."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or spark.conf.get("tessella.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[\d*]+(,\d+)?\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that its executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("tessella.shared.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own for a table, a stream or a log. Who owns the shared folder clears it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df, written as Parquet to the shared folder (partitioned by columns) and read again: it is computed once however often it
    is read, its lineage ends there, and Spark knows its size."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
