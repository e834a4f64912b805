"""Lag-based forecasts: boosted trees, updates on residuals, recursive and rolling use."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C
from tidemark.functions.joins import join_on
from tidemark.functions.ordering import lagged, per_group, with_position
from tidemark.functions.quantiles import quantiles, scalar_quantiles
from tidemark.operators import calibration as Cal
from tidemark.operators import series as S
from tidemark.operators.boosting import (
    ENSEMBLE, UNITS, Boosting, Ensemble, binned, cuts_of, fit_models, grown, predicted, predicted_each, stopping_round)
from tidemark.schema import SERIES_KEYS, lag_count, resolution_seconds, season_bins, time_feature_names
from tidemark.session import checkpointed, stored_lookup

# ---- fixed values -----------------------------------------------------------
MIN_EXTRA_ROWS, MIN_TRAIN, MIN_HOLDOUT, TRAIN_SHARE = 500, 100, 50, 0.8
ONLINE_EXTRA_ROWS, ONLINE_MIN_ROWS, ONLINE_SHARE = 60, 40, 0.9
ROUNDS, MINUTE_ROUNDS, PATIENCE = 500, 400, 40
FRESH_ROUNDS, UPDATE_ROUNDS = 300, 60
STEP_SIZE, TREE_DEPTH, MIN_LEAF, ROW_SHARE, BINS = 0.05, 8, 20, 0.8, 127
ANNUAL_ROUNDS, ANNUAL_DEPTH = 400, 5
ANNUAL_LAGS = [364, 365, 371]
ANNUAL_FAR, ANNUAL_NEAR, ANNUAL_CALIBRATION = 395, 365, 120
FAILED_SCORE = 1e6
LIVE_BINS = 180
# ---- end of fixed values ----------------------------------------------------

# A search's first rung of rounds; each later one has twice as many.
FIRST_RUNG = 25


@dataclass
class Forecaster:
    """An ensemble of trees, its features and band widths.

    A model of several series (``keys``) also has ``levels``: a row per series
    with its mean level, by which values are scaled, and its own band widths.
    """

    features: list[str]
    lags: int
    resolution: str
    ensemble: Ensemble = field(default_factory=Ensemble)
    widths: dict[str, float] = field(default_factory=dict)
    keys: list[str] = field(default_factory=list)
    levels: DataFrame | None = None

    def scaled(self, df: DataFrame) -> DataFrame:
        """Values and lags in units of the series' level, kept as ``_level``."""
        if self.levels is None:
            return df
        rows = join_on(df, stored_lookup(self.levels).select(*self.keys, "_level"), self.keys)
        names = [c for c in df.columns if c == "value" or c.startswith("lag_")]
        return rows.withColumns({c: F.col(c) / F.col("_level") for c in names})

    def transform(self, df: DataFrame, name: str = "forecast") -> DataFrame:
        """Add the forecast: one pass over the ensemble's node arrays, however many trees it has."""
        made = predicted(F.array(*[F.col(f).cast("double") for f in self.features]), self.ensemble)
        out = self.scaled(df).withColumn(name, made)
        if self.levels is None:
            return out
        scaled = [c for c in df.columns if c == "value" or c.startswith("lag_")]
        return out.withColumns({c: F.col(c) * F.col("_level") for c in [*scaled, name]}).drop("_level")

    def trees(self) -> int:
        return len(self.ensemble.roots)

    def save(self, path: str, spark: SparkSession) -> None:
        """Store the ensemble and its settings under one folder."""
        if self.levels is not None:
            self.levels.write.mode("overwrite").parquet(f"{path}/levels")
        meta = {"features": self.features, "lags": self.lags, "resolution": self.resolution,
                "widths": self.widths, "keys": self.keys}
        row = {"meta": json.dumps(meta), **self.ensemble.as_row()}
        schema = f"meta string, {ENSEMBLE}"
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "Forecaster":
        row = spark.read.parquet(f"{path}/model").first()
        meta = json.loads(row["meta"])
        levels = spark.read.parquet(f"{path}/levels") if meta["keys"] else None
        return cls(meta["features"], meta["lags"], meta["resolution"], Ensemble.of_row(row), meta["widths"], meta["keys"], levels)


def _alike(features: list[str]) -> dict[str, str]:
    """Lags hold one series' values shifted, so they share the cuts of the first."""
    return {f: "lag_1" for f in features if re.fullmatch(r"lag_[0-9]+", f)}


def _fit_gbt(rows: DataFrame, features: list[str], label: str, rounds: int, depth: int, seed: int,
             check: DataFrame | None = None, min_leaf: int = MIN_LEAF, step: float = STEP_SIZE) -> Ensemble:
    """Boosted trees of one model; with ``check`` they end at the round with the least error of those rows, and stop
    ``PATIENCE`` rounds after it.  ``rows`` hold their time as ``ts`` or ``day``."""
    how = Boosting(rounds, depth, step, min_leaf, ROW_SHARE, BINS, PATIENCE, seed)
    keep = [*features, label, _row_id(rows).alias("_id")]
    parts = rows.select(*keep, F.lit("train").alias("part"))
    if check is not None:
        parts = parts.unionByName(check.select(*keep, F.lit("holdout").alias("part")))
    return Ensemble.of_row(fit_models(parts, [], features, label, how, _alike(features)).first())


def _row_id(rows: DataFrame, keys: list[str] | None = None) -> Column:
    """A number for a row, by its series and time."""
    return F.xxhash64(*(keys or []), *[c for c in [*SERIES_KEYS, "vendorid", "ts", "day"] if c in rows.columns and c not in (keys or [])])


def _widths(rows: DataFrame, label: str, forecast: str) -> dict[str, float]:
    residual = rows.select(F.abs(F.col(label) - F.col(forecast)).alias("_res"))
    found = scalar_quantiles(residual, "_res", {"width_90": 0.90, "width_95": 0.95})
    return {k: found[k] for k in ("width_90", "width_95")}


def training_rows(series: DataFrame, resolution: str, keys: list[str] | None = None,
                  share: float = TRAIN_SHARE, lags: int | None = None) -> DataFrame:
    """Lag rows of long enough series, split in time into ``train`` and ``holdout``.

    The cut is a share of the whole series, so early rows that only feed lags
    count towards it.
    """
    n = lags or lag_count(resolution)
    rows = S.lag_features(series, n, keys, resolution)
    cut = F.floor(F.lit(share) * F.col("_n"))
    big = (F.col("_n") >= n + MIN_EXTRA_ROWS) & (cut - n >= MIN_TRAIN) & (F.col("_n") - cut >= MIN_HOLDOUT)
    return rows.filter(big).withColumn("part", F.when(F.col("_pos") < cut, "train").otherwise("holdout"))


def fit_forecaster(
    series: DataFrame, resolution: str, rounds: int | None = None, depth: int = TREE_DEPTH,
    keys: list[str] | None = None, lags: int | None = None, seed: int = 42, step: float = STEP_SIZE,
) -> Forecaster | None:
    """Train on the first 80 % of each series; choose the rounds and calibrate on the rest.

    With ``keys`` one model learns all series, each in units of its mean level
    over its training rows, and each series gets band widths of its own.
    Returns None when no series is long enough.
    """
    n, keys = lags or lag_count(resolution), keys or []
    if rounds is None:
        rounds = MINUTE_ROUNDS if resolution_seconds(resolution) < 3600 else ROUNDS
    features = S.feature_names(resolution, n)
    rows = checkpointed(training_rows(series, resolution, keys, lags=n))
    if rows.isEmpty():
        return None
    model = Forecaster(features, n, resolution, keys=keys)
    if keys:
        level = F.avg(F.abs("value")).alias("_level")
        levels = rows.filter("part = 'train'").groupBy(*keys).agg(level)
        model.levels = checkpointed(levels.withColumn("_level", F.when(F.col("_level") > 0, F.col("_level")).otherwise(1.0)))
    learn, check = (model.scaled(rows.filter(F.col("part") == p)) for p in ("train", "holdout"))
    model.ensemble = _fit_gbt(learn, features, "value", rounds, depth, seed, check, step=step)
    scored = checkpointed(model.transform(rows.filter("part = 'holdout'")))
    model.widths = _widths(scored, "value", "forecast")
    if keys:
        model.levels = checkpointed(join_on(model.levels, holdout_widths(scored, keys).drop("n"), keys))
    return model


@dataclass
class UpdateOutcome:
    """What one model update did."""

    status: str
    n_train: int
    wape: float | None = None
    mae: float | None = None
    trees: int = 0
    incremental: bool = False
    model: Forecaster | None = None


def update_forecaster(
    previous: Forecaster | None, series: DataFrame, resolution: str, mode: str = "finetune",
    update_rounds: int = UPDATE_ROUNDS, fresh_rounds: int = FRESH_ROUNDS, depth: int = TREE_DEPTH,
    lags: int | None = None, seed: int = 42,
) -> UpdateOutcome:
    """Update on the current series buffer: add trees fitted to what is left unexplained.

    ``train`` mode, or no previous model, fits afresh.  The last tenth of the
    rows measures the result and calibrates the band.
    """
    n = lags or (previous.lags if previous else lag_count(resolution))
    features = S.feature_names(resolution, n)
    bins = series.count()
    if bins < n + ONLINE_EXTRA_ROWS:
        return UpdateOutcome("warmup", bins)
    rows = checkpointed(S.lag_features(series, n, None, resolution))
    count = rows.count()
    if count < ONLINE_MIN_ROWS:
        return UpdateOutcome("warmup", count)
    cut = max(1, int(count * ONLINE_SHARE))
    learn, check = rows.filter(F.col("_pos") - n < cut), rows.filter(F.col("_pos") - n >= cut)
    incremental = mode == "finetune" and previous is not None
    model = Forecaster(features, n, resolution, previous.ensemble if incremental else Ensemble())
    target = learn.withColumn("_left", F.col("value"))
    if incremental:
        target = checkpointed(model.transform(learn, "_prior").withColumn("_left", F.col("value") - F.col("_prior")))
    rounds = update_rounds if incremental else fresh_rounds
    model.ensemble = model.ensemble.plus(_fit_gbt(target, features, "_left", rounds, depth, seed))
    scored = checkpointed(model.transform(check if count > cut else learn))
    model.widths = _widths(scored, "value", "forecast")
    measured = Cal.forecast_metrics(scored, actual="value").first() if count > cut else None
    return UpdateOutcome(
        "ok", cut, measured["wape_pct"] if measured else None, measured["mae"] if measured else None,
        model.trees(), incremental, model)


UPDATED = f"{ENSEMBLE}, status string, n_train long, wape double, mae double, width_90 double, width_95 double, detail string"


def updated_here(previous: Ensemble | None, values: np.ndarray, calendar: np.ndarray, ids: np.ndarray, lags: int,
                 mode: str, update: Boosting, fresh: Boosting) -> dict:
    """What :func:`update_forecaster` does, for a series of bounded length that lies in one place, by its time.

    ``calendar`` holds the calendar features and ``ids`` a number for each bin.
    """
    out = {"status": "warmup", "n_train": len(values), "detail": ""}
    if len(values) < lags + ONLINE_EXTRA_ROWS:
        return out
    past = np.lib.stride_tricks.sliding_window_view(values, lags + 1)
    x, y, ids = np.hstack([past[:, -2::-1], calendar[lags:]]), past[:, -1], ids[lags:]
    if len(y) < ONLINE_MIN_ROWS:
        return {**out, "n_train": len(y)}
    cut = max(1, int(len(y) * ONLINE_SHARE))
    before = previous if mode == "finetune" and previous is not None else None
    how = update if before else fresh
    left = y[:cut] - before.predict(x[:cut]) if before else y[:cut]
    shared = cuts_of(x[:cut, 0], how.bins)
    cuts = [shared if i < lags else cuts_of(x[:cut, i], how.bins) for i in range(x.shape[1])]
    base = float(np.mean(left))
    unit = max(float(np.max(np.abs(left))) + abs(base), 1e-300) / UNITS
    order = np.argsort(ids[:cut], kind="stable")
    made, _ = grown(binned(x[:cut], cuts)[order], left[order], np.ones(cut, bool), ids[:cut][order], base, unit, cuts, how)
    model = before.plus(made) if before else made
    checked = slice(cut, None) if len(y) > cut else slice(None, cut)
    error = np.abs(y[checked] - model.predict(x[checked]))
    out = {**out, "status": "ok", "n_train": cut, "model": model,
           **{f"width_{q}": float(np.quantile(error, q / 100)) for q in (90, 95)}}
    if len(y) > cut:
        size = float(np.sum(np.abs(y[checked])))
        out |= {"mae": float(np.mean(error)), "wape": 100 * float(np.sum(error)) / size if size > 0 else None}
    return out


def update_in_turn(bins: DataFrame, states: DataFrame, keys: list[str], windows: list[str], resolution: str, mode: str,
                   update: Boosting, fresh: Boosting, lags: int | None = None, max_bins: int = 4000) -> DataFrame:
    """Update the model of every series by several windows, one after another, all series in one pass.

    ``bins`` hold ``keys, ts, value, window``; ``windows`` are the names to
    learn, in order, and a window's series is the newest ``max_bins`` bins of it
    and of what sorts before it, so a series is bounded by ``max_bins`` and the
    windows' bins.  ``states`` hold ``keys`` and the columns of an ensemble.
    Gives ``keys``, ``window`` and the columns of ``UPDATED`` per series and
    window.  A series whose update fails says so in ``detail`` and keeps its model.
    """
    n = lags or lag_count(resolution)
    names = time_feature_names(resolution)
    calendar = dict(zip(["wd", "hour", "minute", "second"], C.time_features("ts")))
    rows = bins.dropna(subset=["value"]).select(
        *keys, "ts", "window", F.col("value").cast("double").alias("value"), F.xxhash64("ts").alias("_id"),
        *[calendar[c].cast("double").alias(f"_{c}") for c in names])
    schema = T.StructType([bins.schema[k] for k in keys] + list(T.StructType.fromDDL(f"window string, {UPDATED}")))

    def learn(series: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("ts")
        where = series["window"].to_numpy()
        values, ids = series["value"].to_numpy(np.float64), series["_id"].to_numpy(np.int64)
        parts = series[[f"_{c}" for c in names]].to_numpy(np.float64)
        model = Ensemble.of_row(state.iloc[0]) if len(state) else None
        out = []
        for window in windows if len(series) else []:
            seen = np.flatnonzero(where <= window)[-max_bins:]
            try:
                found = updated_here(model, values[seen], parts[seen], ids[seen], n, mode, update, fresh)
            except Exception as error:  # one series must not stop the others
                found = {"status": "error", "detail": f"{type(error).__name__}: {error}"[:300]}
            model = found.pop("model", model)
            kept = (model or Ensemble()).as_row() if window == windows[-1] else Ensemble().as_row()
            out.append({**{k: series[k].iloc[0] for k in keys}, "window": window, **kept, **found})
        return pd.DataFrame(out, columns=schema.names)

    return rows.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInPandas(learn, schema)


def rows_in_range(
    series: DataFrame, lags: int, resolution: str, start: str, end: str, keys: list[str] | None = None
) -> DataFrame:
    """Lag rows of an inclusive range; the lags of its first bins are the newest bins before it, however old."""
    low, high = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    present = series.dropna(subset=["value"])
    before = S.keep_newest(present.filter(F.col("ts") < low), lags, keys)
    inside = present.filter(F.col("ts").between(low, high))
    rows = S.lag_features(before.unionByName(inside), lags, keys, resolution)
    return rows.filter(F.col("ts") >= low)


def forecast_one_step(
    series: DataFrame, model: Forecaster, start: str, end: str, level="95", keys: list[str] | None = None
) -> DataFrame:
    """One-step forecasts over a range from true lags, with band and outside flag."""
    rows = rows_in_range(series, model.lags, model.resolution, start, end, keys)
    scored = model.transform(rows).select(*(keys or []), "ts", F.col("value").alias("actual"), "forecast")
    return banded(scored, model, level)


def banded(scored: DataFrame, model: Forecaster | dict[str, float], level="95") -> DataFrame:
    """Symmetric band around ``forecast``, not below zero, of the model's or each series' own width."""
    column = Cal.LEVEL_WIDTHS[Cal.level_of(level)]
    if column is None:
        return scored
    if isinstance(model, Forecaster) and model.levels is not None:
        own = stored_lookup(model.levels).select(*model.keys, F.col(column).alias("half_width"))
        out = join_on(scored, own, model.keys)
    else:
        widths = model.widths if isinstance(model, Forecaster) else model
        out = scored.withColumn("half_width", F.lit(float(widths[column])))
    return with_band(out)


def with_band(rows: DataFrame) -> DataFrame:
    """Bounds of rows that have a ``forecast`` and a ``half_width``, and the flag of actual values beyond them."""
    w = F.col("half_width")
    out = rows.withColumns({"lower": C.clip_lower(F.col("forecast") - w), "upper": F.col("forecast") + w})
    return out.withColumn("outside", C.outside_band()) if "actual" in rows.columns else out


def calendar_ahead(now: str | dt.datetime, resolution: str, horizon: int) -> np.ndarray:
    """The calendar features of each of the next ``horizon`` bins after ``now``, a row each."""
    at = dt.datetime.fromisoformat(now) if isinstance(now, str) else now
    step = dt.timedelta(seconds=resolution_seconds(resolution))
    times = [at + (i + 1) * step for i in range(horizon)]
    parts = {"wd": [t.isoweekday() % 7 for t in times], "hour": [t.hour for t in times], "minute": [t.minute for t in times]}
    return np.array([parts[n] for n in time_feature_names(resolution)], np.float64).T


def steps_ahead(lags: np.ndarray, ensemble: Ensemble, calendar: np.ndarray) -> np.ndarray:
    """Forecasts of all steps for a batch of series, each step fed back as the newest lag; ``lags`` are newest first."""
    ring, out = np.array(lags, np.float64), np.empty((len(lags), len(calendar)))
    for i, at in enumerate(calendar):
        out[:, i] = ensemble.predict(np.hstack([ring, np.broadcast_to(at, (len(ring), len(at)))]))
        ring = np.hstack([out[:, i:i + 1], ring[:, :-1]])
    return out


def forecast_recursive(
    history: DataFrame, model: Forecaster, now: str, horizon: int, keys: list[str] | None = None,
) -> DataFrame:
    """Feed each forecast back as the newest lag: ``keys, step, ts, forecast``.

    Starts from the newest bins of each series, however old.  A series is one
    row; batches of series run through all steps at once, so neither the plan
    nor the jobs grow with the horizon.  Series with fewer bins than lags are
    left out.
    """
    keys = keys or []
    n, width = model.lags, resolution_seconds(model.resolution)
    at = F.lit(now).cast("timestamp_ntz")
    recent = S.keep_newest(history.dropna(subset=["value"]).filter(F.col("ts") <= at), n, keys)
    # as many bins per series as the model has lags
    newest = F.sort_array(F.collect_list(F.struct("ts", "value")), asc=False)
    state = recent.withColumn("_g", F.lit(0)).groupBy("_g", *keys).agg(newest.alias("_w")).filter(F.size("_w") >= n)
    level = F.lit(1.0)
    if model.levels is not None:
        state = join_on(state, stored_lookup(model.levels).select(*model.keys, "_level"), model.keys)
        level = F.col("_level")
    state = state.select(*keys, level.alias("_level"), F.transform(
        F.slice("_w", 1, n), lambda x: x["value"].cast("double") / level).alias("_lags"))
    calendar, ensemble = calendar_ahead(now, model.resolution, horizon), model.ensemble

    @F.arrow_udf("array<double>")
    def ahead(lags: pa.Array) -> pa.Array:
        rows = lags.flatten().to_numpy(zero_copy_only=False).reshape(len(lags), n)
        return pa.array(list(steps_ahead(rows, ensemble, calendar)), pa.list_(pa.float64()))

    steps = state.withColumn("_out", ahead("_lags")).select(*keys, "_level", F.posexplode("_out").alias("_p", "_f"))
    after = F.make_dt_interval(secs=((F.col("_p") + 1) * width).cast("decimal(18,6)"))
    return steps.select(*keys, (F.col("_p") + 1).alias("step"), (at + after).alias("ts"), (F.col("_f") * F.col("_level")).alias("forecast"))


def seasonal_naive(
    series: DataFrame, resolution: str, keys: list[str] | None = None, season: int | None = None
) -> DataFrame:
    """The value one season earlier as ``forecast``."""
    rows = lagged(series, keys or [], "value", {"forecast": season or season_bins(resolution)})
    return rows.drop("_pos", "_n")


def seasonal_ahead(season: int) -> Callable[[Column, Column], Column]:
    """Forecaster for :func:`rolling_forecast`: repeat the last season of the context."""
    def forecast(context: Column, horizon: Column) -> Column:
        size = F.size(context)
        back = F.least(F.lit(season), size)
        return F.transform(F.sequence(F.lit(0), horizon - 1), lambda i: F.get(context, size - back + i % back))

    return forecast


def rolling_forecast(
    series: DataFrame, forecaster: Callable[[Column, Column], Column], context: int = 512,
    horizon: int = 24, keys: list[str] | None = None, windows: DataFrame | None = None,
) -> DataFrame:
    """Forecast every horizon from the actual values before it, all origins in parallel.

    ``forecaster`` maps (context array, number of steps) to an array column; a
    pandas UDF over arrays works as well.  Give ``windows`` to choose origins,
    else the ``val`` part is covered from its start, last horizon cut short.
    """
    keys = keys or []
    if windows is None:
        train = F.count_if(F.col("split") == "train").alias("_val")
        starts = series.dropna(subset=["value"]).withColumn("_g", F.lit(0)).groupBy("_g", *keys).agg(train)
        marked = per_group(series.withColumn("_g", F.lit(0)), starts, ["_g", *keys]).drop("_g")
        windows = S.fixed_windows(marked, context, horizon, horizon, None, keys, F.col("_val"), partial=True)
    made = windows.withColumn("_f", forecaster(F.col("context"), F.size("target")))
    cells = F.posexplode(F.arrays_zip(F.col("target_ts").alias("ts"), F.col("target").alias("actual"),
                                      F.col("_f").alias("forecast")))
    return made.select(*keys, "origin", cells.alias("step", "_c")).select(
        *keys, "origin", (F.col("step") + 1).alias("step"),
        F.col("_c.ts").alias("ts"), F.col("_c.actual").alias("actual"), F.col("_c.forecast").alias("forecast"))


def score_by_series(forecasts: DataFrame, tag: str, keys: list[str] | None = None) -> DataFrame:
    """Errors per series over its concatenated windows, labelled with a model tag."""
    return Cal.forecast_metrics(forecasts, keys or SERIES_KEYS).withColumn("tag", F.lit(tag))


def residual_paths(
    forecasts: DataFrame, residuals: DataFrame, samples: int = 100, seed: int = 42,
    keys: list[str] | None = None,
) -> DataFrame:
    """Sample paths: each forecast plus ``samples`` hashed draws of past residuals.

    ``residuals`` holds ``keys, i, residual`` with i from 0 per group, and each
    forecast row carries ``origin`` and ``step``.
    """
    keys = keys or []
    sizes = residuals.withColumn("_g", F.lit(0)).groupBy("_g", *keys).agg(F.count(F.lit(1)).alias("_size"))
    sized = per_group(forecasts.withColumn("_g", F.lit(0)), sizes, ["_g", *keys]).drop("_g")
    drawn = sized.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn(
        "i", F.pmod(F.xxhash64("origin", "step", "path", F.lit(seed)), F.col("_size")))
    joined = per_group(drawn, residuals.select(*keys, "i", "residual"), [*keys, "i"])
    return joined.withColumn("sample", F.col("forecast") + F.col("residual")).drop("_size", "i", "residual")


# -- live matching ------------------------------------------------------------

def match_forecasts(actuals: DataFrame, forecasts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The newest stored forecast of each bin next to its actual value.

    ``forecasts`` holds ``keys, ts, made_at, forecast``.
    """
    keys = keys or []
    newest = S.latest_per_key(forecasts.select(*keys, "ts", "made_at", "forecast"), [*keys, "ts"], "made_at")
    return actuals.join(newest, [*keys, "ts"], "inner")


def lagged_wape(matched: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Error of frozen forecasts as a fraction (not percent) of the actual total."""
    size = F.sum(F.abs("value"))
    error = F.sum(F.abs(F.col("value") - F.col("forecast")))
    return matched.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), (error / F.when(size > 0, size)).alias("wape_frac"))


def live_forecast(
    history: DataFrame, model: Forecaster, now: str, horizon: int, past: DataFrame | None = None,
    show_bins: int = LIVE_BINS, keys: list[str] | None = None,
) -> DataFrame:
    """Rows of a live panel by ``kind``: recent actuals, the forecast ahead starting
    at the last actual, and past forecasts of the bins shown."""
    keys = keys or []
    at = F.lit(now).cast("timestamp_ntz")
    seen = history.dropna(subset=["value"]).filter(F.col("ts") <= at)
    tail = checkpointed(S.keep_newest(seen, show_bins, keys).select(*keys, "ts", "value"))
    last = S.keep_newest(tail, 1, keys).select(*keys, "ts", "value")
    ahead = forecast_recursive(seen, model, now, horizon, keys).select(*keys, "ts", F.col("forecast").alias("value"))
    parts = {"actual": tail, "forecast": last.unionByName(ahead)}
    if past is not None:
        matched = match_forecasts(tail, past, keys)
        parts["forecast_past"] = matched.select(*keys, "ts", F.col("forecast").alias("value"))
    out = None
    for kind, rows in parts.items():
        rows = rows.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


# -- annual model -------------------------------------------------------------

ANNUAL_FEATURES = [*[f"lag_{n}d" for n in ANNUAL_LAGS], "trailing_mean",
                   "weekday", "month", "day_of_month", "weekend", "holiday"]


def annual_features(clean: DataFrame, targets: DataFrame | None = None,
                    first_year: int = 2014, last_year: int = 2019) -> DataFrame:
    """Year-ago lags, their trailing mean and calendar flags per day.

    All past values come from ``clean``; ``targets`` adds days to describe.
    """
    base = clean.select("day", "value", F.lit(True).alias("is_clean"))
    if targets is not None:
        extra = targets.select("day").join(clean.select("day"), "day", "left_anti")
        base = base.unionByName(extra.select("day", F.lit(None).cast("double").alias("value"),
                                             F.lit(False).alias("is_clean")))
    lags = S.calendar_lag(base, ANNUAL_LAGS)
    full = S.trailing_mean(lags, ANNUAL_FAR, ANNUAL_NEAR)
    return full.join(base.select("day", "is_clean"), "day").select(
        "*", *C.calendar_features("day", first_year, last_year))


def annual_anomaly(
    clean: DataFrame, new: DataFrame, alpha: float = 0.5, calibration: int = ANNUAL_CALIBRATION,
    rounds: int = ANNUAL_ROUNDS, depth: int = ANNUAL_DEPTH, seed: int = 42,
    first_year: int = 2014, last_year: int = 2019,
) -> DataFrame:
    """Flag days of ``new`` that differ from a year-over-year model of ``clean``.

    The allowed difference is the 1 - alpha quantile of the error on the last
    ``calibration`` days, by a model that has not seen them.
    """
    rows = checkpointed(annual_features(clean, new, first_year, last_year))
    span = clean.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    first_usable = F.date_add(F.lit(span["a"]), ANNUAL_FAR)
    cut = F.date_sub(F.lit(span["b"]), calibration)
    learn = rows.filter(F.col("is_clean") & (F.col("day") >= first_usable)).dropna(subset=ANNUAL_FEATURES)

    # the model of all days and the one that has not seen the last, in one pass
    both = learn.withColumn("_model", F.explode(F.array(F.lit("all"), F.lit("early")))).filter(
        (F.col("_model") == "all") | (F.col("day") <= cut))
    how = Boosting(rounds, depth, STEP_SIZE, MIN_LEAF, ROW_SHARE, BINS, PATIENCE, seed)
    marked = both.select("_model", *ANNUAL_FEATURES, "value", F.xxhash64("day").alias("_id"), F.lit("train").alias("part"))
    # two rows
    made = {r["_model"]: Forecaster(ANNUAL_FEATURES, 0, "1d", Ensemble.of_row(r))
            for r in fit_models(marked, ["_model"], ANNUAL_FEATURES, "value", how).collect()}
    check = made["early"].transform(learn.filter(F.col("day") > cut))
    q = scalar_quantiles(check.select(F.abs(F.col("value") - F.col("forecast")).alias("_res")),
                         "_res", {"q": 1 - alpha})["q"]
    known = rows.drop("value").dropna(subset=ANNUAL_FEATURES).join(new.select("day", "value"), "day")
    scored = made["all"].transform(known)
    return scored.select("day", "value", "forecast", F.lit(q).alias("q"),
                         (F.abs(F.col("value") - F.col("forecast")) > F.lit(q)).alias("is_anomaly"))


# -- search -------------------------------------------------------------------

def checked_setting(setting: dict) -> Boosting:
    """A trial's way to grow; raises what a setting that cannot be used gives."""
    names = {f.name for f in fields(Boosting)} - {"bins"}
    if set(setting) - names:
        raise TypeError(f"unknown settings: {sorted(set(setting) - names)}")
    how = Boosting(**{"rounds": ROUNDS, "depth": TREE_DEPTH, "step": STEP_SIZE, "min_leaf": MIN_LEAF, "row_share": ROW_SHARE,
                      "bins": BINS, "patience": PATIENCE, **setting})
    whole = (how.rounds, how.depth, how.min_leaf, how.patience, how.seed)
    if not all(isinstance(x, int) for x in whole) or min(how.rounds, how.depth, how.min_leaf) < 1:
        raise ValueError("rounds, depth and min_leaf are whole numbers of at least 1")
    if not 0 < how.step <= 1 or not 0 < how.row_share <= 1:
        raise ValueError("step and row_share are above 0 and at most 1")
    return how


@dataclass
class Trial:
    """A setting in a race: what it has learnt so far and its holdout errors by round."""

    place: int
    setting: dict
    how: Boosting
    parts: list[Ensemble] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    levels: int = 0

    def ensemble(self, rounds: int) -> Ensemble:
        """The trees of the first rounds, over the rungs they were learnt in."""
        out = Ensemble()
        for part in self.parts:
            if rounds <= 0:
                break
            out, rounds = out.plus(part.first(rounds)), rounds - len(part.roots)
        return out

    def over(self) -> bool:
        return len(self.errors) >= self.how.rounds or bool(self.errors) and stopping_round(self.errors, self.how.patience)[1]


def race(rows: DataFrame, features: list[str], trials: list[Trial], first: int = FIRST_RUNG) -> list[Trial]:
    """Successive halving: all trials learn a rung of rounds in one pass, the worse half stops, the others go on to twice
    as many from where they are.  Trials that are through stay in the race by their best error.

    ``rows`` hold the features, ``value``, ``part`` and ``_id``; each trial learns them, so the grid should be small.
    """
    racing, rung = list(trials), first
    while True:
        going = [t for t in racing if not t.over()]
        if going:
            ways = {(t.place,): replace(t.how, rounds=min(rung, t.how.rounds) - len(t.errors), seed=t.how.seed + len(t.errors),
                                        patience=rung) for t in going if min(rung, t.how.rounds) > len(t.errors)}
            copies = rows.withColumn("_trial", F.explode(F.array(*[F.lit(p) for p, in ways])))
            learnt = {t.place: t.ensemble(len(t.errors)) for t in going if t.errors}
            x = F.array(*[F.col(f).cast("double") for f in features])
            left = checkpointed(copies.withColumn("_left", F.col("value") - predicted_each(F.col("_trial"), x, learnt)))
            # one row per trial
            for r in fit_models(left, ["_trial"], features, "_left", ways, _alike(features), whole=True).collect():
                t = next(t for t in going if t.place == r["_trial"])
                t.parts.append(Ensemble.of_row(r))
                t.errors += list(r["errors"])
                t.levels += r["trees"] * t.how.depth
        if all(t.over() for t in racing):
            break
        racing = sorted(racing, key=lambda t: min(t.errors))[:max(1, (len(racing) + 1) // 2)]
        rung *= 2
    return trials


def time_ordered_search(
    series: DataFrame, resolution: str, grid: list[dict], lags: int | None = None, first: int = FIRST_RUNG,
) -> list[tuple[float, dict, str]]:
    """Holdout WAPE per setting, best first; a failed or non-finite trial scores 1e6 and says why.

    Settings are fields of :class:`Boosting`; they race by :func:`race`, so the
    error of one that was stopped early is that of the rounds it had.  Raises
    when no trial succeeded.
    """
    n = lags or lag_count(resolution)
    rows = training_rows(series, resolution, lags=n)
    rows = checkpointed(rows.withColumn("_id", _row_id(rows)))
    features, trials, failed = S.feature_names(resolution, n), [], []
    for i, setting in enumerate(grid):
        try:
            trials.append(Trial(i, setting, checked_setting(setting)))
        except (TypeError, ValueError) as error:
            failed.append((FAILED_SCORE, setting, f"{type(error).__name__}: {error}"))
    if trials and rows.isEmpty():
        failed += [(FAILED_SCORE, t.setting, "the series is too short") for t in trials]
        trials = []
    found = []
    held = rows.filter("part = 'holdout'")
    for t in race(rows, features, trials, first) if trials else []:
        best = t.ensemble(stopping_round(t.errors, len(t.errors))[0])
        scored = Forecaster(features, n, resolution, best).transform(held)
        score = Cal.forecast_metrics(scored, actual="value").first()["wape_pct"]
        good = score is not None and math.isfinite(score)
        found.append((score, t.setting, "") if good else (FAILED_SCORE, t.setting, f"score {score}"))
    found = sorted([*found, *failed], key=lambda t: t[0])
    if grid and all(error for *_, error in found):
        raise ValueError(f"no setting could be scored: {found[0][2]}")
    return found


def holdout_widths(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Band widths per series from scored holdout rows."""
    rows = scored.withColumn("_res", F.abs(F.col("value") - F.col("forecast")))
    return quantiles(rows, keys, "_res", {"width_90": 0.90, "width_95": 0.95})


def latest_forecasts(forecasts: DataFrame, max_bins: int = 1000, keys: list[str] | None = None) -> DataFrame:
    """The newest forecast per bin, kept for the newest ``max_bins`` bins of a series."""
    keys = keys or []
    newest = S.latest_per_key(forecasts, [*keys, "ts"], "made_at")
    return S.keep_newest(newest, max_bins, keys)


def index_residuals(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Residuals numbered from 0 per series, for :func:`residual_paths`."""
    rows = scored.select(*(keys or []), "ts", (F.col("actual") - F.col("forecast")).alias("residual"))
    return with_position(rows.dropna(subset=["residual"]), keys or []).select(
        *(keys or []), F.col("_pos").alias("i"), "residual")
