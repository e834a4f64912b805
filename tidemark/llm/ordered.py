"""Ranges of a key as groups that also hold the row that follows them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions

ACCURACY = 10_000


def with_bucket(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Add ``_bucket``, which ascends with ``key``; null keys come first, in a bucket of their own.

    Bounds are approximate quantiles, so buckets hold about as many rows each
    unless a key repeats.  At most ``buckets`` numbers come to the driver.
    """
    from pyspark.ml.feature import Bucketizer  # here, as Python workers import this module too

    shares = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.percentile_approx(key, shares, ACCURACY)).first()[0] if shares else None
    bounds = sorted({float(x) for x in found or []})
    value = F.lit(0.0)
    if bounds:
        rows = rows.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(0.0)))
        rows = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_key", outputCol="_bucket").transform(rows)
        value = F.col("_bucket")
    return rows.withColumn("_bucket", F.when(F.col(key).isNull(), -1).otherwise(value.cast("int"))).drop("_key")


def with_followers(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """Rows dealt by bucket and sorted by (bucket, ``_ahead``, key, tie) within partitions.

    Each bucket ends with a copy of the row after its last one (``_ahead`` = 1),
    which for the last bucket is the first row of all.  Rows equal in key and
    tie are interchangeable.
    """
    parts = shuffle_partitions(rows.sparkSession)
    placed = with_bucket(rows, key, min(4 * parts, 2000))
    # One row per bucket: at most 2001, so one task can order them.
    firsts = placed.groupBy("_bucket").agg(F.min(F.struct(key, tie)).alias("_first"))
    everything = Window.partitionBy(F.lit(0)).orderBy("_bucket")
    after = firsts.select(
        F.col("_bucket").alias("_to"),
        F.coalesce(F.lead("_first").over(everything), F.first("_first").over(everything)).alias("_next"))
    after = after.select("_to", F.col(f"_next.{key}").alias("_key"), F.col(f"_next.{tie}").alias("_tie"))
    ahead = (
        rows.join(F.broadcast(after), F.col(key).eqNullSafe(F.col("_key")) & (F.col(tie) == F.col("_tie")))
        .dropDuplicates(["_to"]).drop("_key", "_tie").withColumnRenamed("_to", "_bucket"))
    both = placed.withColumn("_ahead", F.lit(0)).unionByName(ahead.withColumn("_ahead", F.lit(1)))
    return both.repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_ahead", key, tie)
