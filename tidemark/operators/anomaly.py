"""Anomaly scores of binned series and of records, from medians and MADs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.ordering import in_blocks, per_group, with_position
from tidemark.functions.quantiles import medians, scalar_mad
from tidemark.functions.rolling import rolling_median
from tidemark.operators import series as S
from tidemark.operators.records import guarded_limit
from tidemark.schema import MAD_FLOOR, Z_SCALE
from tidemark.session import checkpointed

# ---- fixed values -----------------------------------------------------------
LOCAL_MIN_WINDOW = 20
DEVIATION_WINDOW = 11
MODEL_WEIGHT = 0.4
VALUE_WEIGHT = 0.6
MIN_BLEND_ROWS = 5
LOCAL_BUFFER_HOURS = 1
# ---- end of fixed values ----------------------------------------------------


def two_sided(z: Column, k: float) -> Column:
    return F.coalesce(F.abs(z) > k, F.lit(False))


def mad_by(df: DataFrame, keys: list[str], value: str, center: str = "median", spread: str = "mad") -> DataFrame:
    """Median and median absolute deviation per group, for groups of any size."""
    df = checkpointed(df.select(*keys, value))
    middle = checkpointed(medians(df, keys, value, center).drop("n"))
    dev = per_group(df.select(*keys, value), middle, keys).withColumn(
        "_dev", F.abs(F.col(value) - F.col(center)))
    return per_group(middle, medians(dev, keys, "_dev", spread).drop("n"), keys)


def global_mad(
    series: DataFrame, profile: DataFrame, k: float = 3.0, keys: list[str] | None = None
) -> DataFrame:
    """z-score of each bin against the weekly profile of its slot, two-sided."""
    scored = S.attach_profile(series, profile, keys)
    z = C.robust_z(F.col("value"), F.col("expected"), F.col("mad"))
    return scored.withColumn("z", z).withColumn("is_anomaly", two_sided(F.col("z"), k))


def record_mad(trips: DataFrame, metric: str, k: float = 3.0, guard: int | None = None) -> DataFrame:
    """z-score of raw records against the median and MAD of the whole selection.

    ``guard`` refuses selections beyond that many rows, as an interactive request
    does; without it any size is scored.
    """
    rows = guarded_limit(trips, metric, guard) if guard else trips.dropna(subset=[metric])
    median, mad = scalar_mad(rows, metric)
    z = C.robust_z(F.col(metric).cast("double"), F.lit(median).cast("double"), F.lit(mad).cast("double"))
    return rows.withColumn("z", z).withColumn("is_anomaly", two_sided(F.col("z"), k))


def intraday_mad(
    series: DataFrame, first: str, last: str, k: float = 3.5, keys: list[str] | None = None
) -> DataFrame:
    """z-score against median and MAD of the same weekday (Monday=0) and time of day.

    Statistics use the whole series; only the days asked for are returned.  A
    slot with zero MAD scores NULL.
    """
    profile = S.weekly_profile(series, keys, monday_first=True, floor=None)
    days = F.to_date("ts").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    scored = S.attach_profile(series.filter(days), profile, keys, monday_first=True)
    z = C.robust_z(F.col("value"), F.col("expected"), F.col("mad"), zero_mad="null")
    return scored.withColumn("z", z).withColumn("is_anomaly", two_sided(F.col("z"), k))


def local_mad(
    series: DataFrame, start: str, end: str, k: float = 3.0, keys: list[str] | None = None
) -> DataFrame:
    """z-score against a centered rolling median and MAD, two-sided.

    The window is a tenth of the bins in the range plus an hour on each side,
    at least 20.
    """
    keys = keys or []
    low, high = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    hour = F.make_dt_interval(hours=F.lit(LOCAL_BUFFER_HOURS))
    placed = with_position(
        series.select(*keys, "ts", "value").filter(F.col("ts").between(low - hour, high + hour)), keys
    ).withColumn("_w", F.greatest(F.lit(LOCAL_MIN_WINDOW), F.floor(F.col("_n") / 10)))
    centred = rolling_median(checkpointed(placed), keys, "value", "expected")
    spread = centred.withColumn("_dev", F.abs(F.col("value") - F.col("expected")))
    rolled = rolling_median(checkpointed(spread), keys, "_dev", "mad").drop("_dev", "_w", "_pos", "_n")
    z = C.robust_z(F.col("value"), F.col("expected"), F.col("mad"))
    return (
        rolled.filter(F.col("ts").between(low, high))
        .withColumn("z", z)
        .withColumn("is_anomaly", two_sided(F.col("z"), k))
    )


def local_deviation(series: DataFrame, keys: list[str] | None = None, width: int = DEVIATION_WINDOW) -> DataFrame:
    """Add ``dev`` from the centered rolling median and ``scale``, its series median size.

    Also adds ``n_rows`` of the series.
    """
    keys, half = keys or [], width // 2
    placed = with_position(series, keys)
    block = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(-half, half)
    rows = (
        in_blocks(placed, half, half)
        .withColumn("dev", F.col("value") - F.percentile("value", 0.5).over(block))
        .filter("_own").drop("_block", "_own", "_pos")
        .withColumnRenamed("_n", "n_rows")
    )
    rows = checkpointed(rows)
    scale = medians(rows.withColumn("_size", F.abs("dev")), keys, "_size", "scale").drop("n")
    return per_group(rows, scale, keys).withColumn("scale", F.greatest("scale", F.lit(MAD_FLOOR)))


def blend_score(series: DataFrame, k: float, model_z: str = "z", keys: list[str] | None = None) -> DataFrame:
    """Blend a model's z-score with the local deviation, flagging high values only.

    Series of fewer than five rows keep the model's score.
    """
    rows = local_deviation(series, keys)
    value_z = C.clip_lower(F.lit(Z_SCALE) * F.col("dev") / F.col("scale"))
    blended = MODEL_WEIGHT * C.clip_lower(F.col(model_z)) + VALUE_WEIGHT * value_z
    score = F.when(F.col("n_rows") < MIN_BLEND_ROWS, F.col(model_z)).otherwise(blended)
    return (
        rows.withColumn("score", score)
        .withColumn("is_anomaly", F.coalesce(F.col("score") > k, F.lit(False)))
        .drop("dev", "scale", "n_rows")
    )


def series_robust_z(scored: DataFrame, score: str, keys: list[str] | None = None, name: str = "z") -> DataFrame:
    """z-score of a model score against its own series' median and MAD."""
    keys, scored = keys or [], checkpointed(scored)
    stats = mad_by(scored, keys, score, "_center", "_spread")
    z = C.robust_z(F.col(score), F.col("_center"), F.col("_spread"))
    return per_group(scored, stats, keys).withColumn(name, z).drop("_center", "_spread")
