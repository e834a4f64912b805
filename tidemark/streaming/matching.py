"""Forecasts and actual values matched while both still arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_matches(
    actuals: DataFrame, forecasts: DataFrame, keys: list[str] | None = None, delay: str = "1 hour", ahead: str = "1 day",
) -> DataFrame:
    """Each bin with the newest forecast made of it, once both streams have gone past it: ``keys, ts, value, made_at, forecast``.

    ``actuals`` are a stream of ``keys, ts, value``, one row per bin, and
    ``forecasts`` one of ``keys, ts, made_at, forecast``.  A bin is closed when
    actual times are ``delay`` beyond it and forecast times ``delay`` and
    ``ahead``, the farthest that a forecast looks; then a bin without a forecast
    comes with NULL.  State holds the newest forecast of each open bin and the
    bins themselves, so it is bounded by the open bins, not by the forecasts
    made.  Later rows of a closed bin are dropped and counted by Spark.
    Of forecasts made at the same time the larger one counts.
    """
    keys = keys or []
    # a forecast's bin lies up to ``ahead`` beyond the time it was made
    late = f"{delay} {ahead}"
    newest = (
        forecasts.dropna(subset=["forecast"]).withWatermark("ts", late).groupBy("ts", *keys)
        .agg(F.max(F.struct("made_at", "forecast")).alias("_f"))
        .select(F.col("ts").alias("_ts"), *[F.col(k).alias(f"_{k}") for k in keys], "_f"))
    # keys may be NULL, and an equality that Spark can hash keeps the state apart by bin
    same = F.col("ts") == F.col("_ts")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    bins = actuals.select(*keys, "ts", "value").withWatermark("ts", delay)
    return bins.join(newest, same, "left_outer").select(
        *keys, "ts", "value", F.col("_f.made_at").alias("made_at"), F.col("_f.forecast").alias("forecast"))
