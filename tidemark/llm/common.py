"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shared_folder

# Bytes of text handed to a Python worker at once; bounds its memory whatever the rows' length.
BATCH_BYTES = "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of this session by bytes, as texts may be very long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def tidy() -> None:
    """Give free memory back to the system; a Python worker lives on, idle, beside the next stage's workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts lineage, survives lost executors, and tells the planner the true
    size, so that it broadcasts the frame only below its own size threshold.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` has that name, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, even if others differ only in dots or case."""
    return F.col(f"`{name}`")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(column(df, name).cast(T.StringType()), F.lit(""))
