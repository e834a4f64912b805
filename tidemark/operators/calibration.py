"""Forecast errors, conformal widths and prediction bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.ordering import lagged, per_group
from tidemark.functions.quantiles import quantiles
from tidemark.schema import canonical

# ---- fixed values -----------------------------------------------------------
# Band level -> calibrated width column; quantile pair of sample paths.
LEVEL_WIDTHS = {"none": None, "90": "width_90", "95": "width_95"}
SAMPLE_QUANTILES = {"90": (0.05, 0.95), "95": (0.025, 0.975)}
# ---- end of fixed values ----------------------------------------------------


def level_of(level) -> str:
    """A known band level; anything unknown means 95."""
    level = canonical(str(level))
    return level if level in LEVEL_WIDTHS else "95"


def forecast_metrics(
    df: DataFrame, keys: list[str] | None = None, actual: str = "actual",
    forecast: str = "forecast", ts: str = "ts",
) -> DataFrame:
    """WAPE %, MAPE %, MAE, RMSE and MASE per group over rows with both values.

    MASE divides by the mean absolute change between consecutive kept rows.
    A measure whose divisor is zero or missing is NULL.
    """
    keys = keys or []
    y, p = F.col(actual).cast("double"), F.col(forecast).cast("double")
    kept = df.select(*keys, ts, y.alias("_y"), p.alias("_p")).filter(
        F.col("_y").isNotNull() & F.col("_p").isNotNull() & ~F.isnan("_y") & ~F.isnan("_p"))
    rows = lagged(kept, keys, "_y", {"_prev": 1}, ts)
    err = F.abs(F.col("_y") - F.col("_p"))
    size = F.abs(F.col("_y"))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(err).alias("_err"), F.sum(size).alias("_size"),
        F.avg(F.when(F.col("_y") != 0, err / F.when(size != 0, size))).alias("_ape"),
        F.avg(err).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(F.col("_y") - F.col("_prev"))).alias("_naive"),
    )
    return sums.select(
        *keys, "n",
        (F.col("_err") / F.when(F.col("_size") != 0, F.col("_size")) * 100).alias("wape_pct"),
        (F.col("_ape") * 100).alias("mape_pct"), "mae", "rmse",
        (F.col("mae") / F.when(F.col("_naive") != 0, F.col("_naive"))).alias("mase"),
    )


def conformal_widths(
    df: DataFrame, keys: list[str] | None = None, actual: str = "actual", forecast: str = "forecast"
) -> DataFrame:
    """0.90 and 0.95 quantiles of the absolute residual per group."""
    rows = df.withColumn("_res", F.abs(F.col(actual) - F.col(forecast)))
    return quantiles(rows, keys or [], "_res", {"width_90": 0.90, "width_95": 0.95})


def cqr_q(
    df: DataFrame, level="95", keys: list[str] | None = None,
    actual: str = "actual", lower: str = "lower", upper: str = "upper",
) -> DataFrame:
    """Conformal correction of a quantile band: quantile of its overshoot."""
    prob = 0.90 if str(level) == "90" else 0.95
    over = F.greatest(F.col(lower) - F.col(actual), F.col(actual) - F.col(upper))
    known = F.col(actual).isNotNull() & F.col(lower).isNotNull() & F.col(upper).isNotNull()
    return quantiles(df.withColumn("_e", F.when(known, over)), keys or [], "_e", {"q": prob})


def cqr_adjust(lower: Column, upper: Column, q: Column) -> tuple[Column, Column]:
    """Widen a band by ``q``, the lower side not below zero."""
    return C.clip_lower(lower - q), upper + q


def band(
    df: DataFrame, widths: DataFrame, level="95", keys: list[str] | None = None,
    forecast: str = "forecast", local_scale: str | None = None, non_negative: bool = True,
) -> DataFrame:
    """Add ``lower``, ``upper`` and ``half_width`` from calibrated widths.

    With ``local_scale`` the width varies in proportion while its mean over the
    group is kept.  Level ``none`` leaves the frame without a band.
    """
    keys = keys or []
    column = LEVEL_WIDTHS[level_of(level)]
    if column is None:
        return df
    with_width = per_group(df, widths.select(*keys, F.col(column).alias("_w")), keys)
    half = F.col("_w")
    if local_scale:
        means = df.groupBy(*keys).agg(F.avg(local_scale).alias("_mean"))
        with_width = per_group(with_width, means, keys)
        mean = F.when(F.col("_mean") != 0, F.col("_mean")).otherwise(F.lit(1.0))
        half = half * (F.col(local_scale) / mean)
    lower = F.col(forecast) - F.col("half_width")
    return with_width.withColumn("half_width", half).withColumns({
        "lower": C.clip_lower(lower) if non_negative else lower,
        "upper": F.col(forecast) + F.col("half_width"),
    }).drop("_w", "_mean")


def mean_half_width(banded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return banded.groupBy(*(keys or [])).agg(F.avg("half_width").alias("mean_half_width"))


def sample_band(paths: DataFrame, level="95", keys: list[str] | None = None, value: str = "sample") -> DataFrame:
    """Median and outer quantiles of sample paths per step: ``lower, median, upper``."""
    keys, level = keys or [], level_of(level)
    probs = {"median": 0.5}
    if level != "none":
        probs |= dict(zip(("lower", "upper"), SAMPLE_QUANTILES[level]))
    return quantiles(paths, keys, value, probs).drop("n")


def compare_tags(
    scores: DataFrame, measures: list[str] | None = None, by: str = "resolution", tags: list[str] | None = None
) -> DataFrame:
    """Median measure per ``by`` value and tag: a row for each, or the named ``tags`` side by side."""
    measures = measures or ["wape_pct", "mase"]
    if tags is None:
        return median_by(scores, [by, "tag"], measures)
    chosen = scores.filter(F.col("tag").isin(tags))
    return chosen.groupBy(by).pivot("tag", tags).agg(*[F.median(m).alias(m) for m in measures])


def median_by(scores: DataFrame, by: list[str], measures: list[str] | None = None) -> DataFrame:
    """Median of each measure per group of series, ignoring missing scores."""
    measures = measures or ["wape_pct", "mase"]
    return scores.groupBy(*by).agg(*[F.median(m).alias(m) for m in measures])
