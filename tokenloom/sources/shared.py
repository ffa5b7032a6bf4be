"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder under /tmp, on a local master only.

    On a cluster each executor would write that folder on its own disk, so there the setting is required.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
    return "file:///tmp/tokenloom-shared"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tokenloom-{what}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's JVM ends; its tables are of no use to other sessions."""
    fs, p = _at(spark, path)
    fs.deleteOnExit(p)


def discard(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def checkpointed(df: DataFrame, what: str = "step") -> DataFrame:
    """df written to the shared folder as Parquet and read back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
