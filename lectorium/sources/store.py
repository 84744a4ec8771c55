"""Places that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without one gets a folder of its own, any other an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{LOCAL}/{spark.sparkContext.applicationId}"


def at(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows of df written to the shared folder and read back, so that what made them runs once."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
