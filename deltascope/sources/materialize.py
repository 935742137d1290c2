"""Intermediate results that several later plans read.

They are written as parquet to the shared folder the cluster names in
`spark.checkpoint.dir`. Unlike a cached frame, such a table outlives a lost executor, and
its size is known from its files: a join against it is broadcast by the optimizer exactly
when it is small enough (`spark.sql.autoBroadcastJoinThreshold`).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: tempfile.TemporaryDirectory | None = None


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.TemporaryDirectory(prefix="deltascope-")
        atexit.register(_local_folder.cleanup)
    return _local_folder.name


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under one subfolder per application."""
    return f"{shared_folder(spark)}/deltascope-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def release(table: DataFrame) -> None:
    """Delete a table that `materialize` wrote. Nothing that is still to be computed may read it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
