"""Helpers shared by the training-data operators: tables, the shared scratch folder, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SCRATCH = "/tmp/checkpoints"
SLICE_BYTES = 2 << 20
_KEPT: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it.

    Where spark.checkpoint.dir is unset, a local session gets a folder of its own and any other session an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"{LOCAL_SCRATCH}/{context.applicationId}"
    return named


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """The rows of df written to the shared folder and read back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of stored() that later stored tables have replaced; what a result still reads must stay."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions as the session sets them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def kept_one(key: tuple, make: Callable):
    """The one large table that a Python worker keeps from task to task; another's takes its place, so they don't add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text, so that long texts don't pile up in memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    for a, b in zip(starts, np.r_[starts[1:], len(group)], strict=True):
        yield batch.slice(int(a), int(b - a))


def by_slice(function: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text"):
    """function over the slices of every batch, for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, column):
                yield function(piece)

    return run


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def of(arrow: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of that schema."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in arrow)], schema=arrow)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, and more columns of docs; nothing else is read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
