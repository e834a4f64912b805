"""Requests over trip tables: one description, one registry per kind of answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import anomaly as A
from tidemark.operators import calibration as Cal
from tidemark.operators import forecast as Fc
from tidemark.operators import forest, kernel, neighbors, registry
from tidemark.operators import records as R
from tidemark.operators import series as S
from tidemark.schema import (
    COUNT_METRIC, SERIES_KEYS, VALUE_METRICS, canonical, lag_count, resolution_seconds, season_bins,
)
from tidemark.session import checkpointed


@dataclass
class Request:
    """A metric of one vendor at one resolution over an inclusive time range.

    ``history`` is the training table; ``period`` bins at second, minute, hour
    or day instead of the resolution where a model allows it.
    """

    metric: str
    resolution: str
    start: str
    end: str
    vendor: str = "all"
    how: str = "mean"
    k: float = 3.0
    level: str = "95"
    period: str | None = None
    history: DataFrame | None = None
    options: dict = field(default_factory=dict)


class UnknownModel(ValueError):
    """A model name that is not registered."""


class UnknownMetric(ValueError):
    """A metric that the mode cannot score."""


def _bins(trips: DataFrame, request: Request, resolution: str | None = None, how: str | None = None) -> DataFrame:
    return S.bin_series(trips, request.metric, resolution or request.resolution, how or request.how, request.vendor)


def _range(trips: DataFrame, request: Request) -> DataFrame:
    return R.time_range(trips, request.start, request.end)


def _period_resolution(request: Request) -> str:
    if request.period is None:
        return request.resolution
    return {"second": "1s", "minute": "1m", "hour": "1h", "day": "1d"}[request.period]


def chart(trips: DataFrame, request: Request) -> DataFrame:
    """The binned median series of the range."""
    return _bins(_range(trips, request), request, how="median")


def record_scores(trips: DataFrame, request: Request) -> DataFrame:
    """Scored raw records; the option ``guard`` refuses more rows than an interactive request may return."""
    metric = canonical(request.metric)
    if metric == COUNT_METRIC:
        raise UnknownMetric(f"{request.metric} counts records and has no value of its own to score")
    rows = R.vendor_filter(_range(trips, request), request.vendor)
    return A.record_mad(rows, metric, request.k, request.options.get("guard"))


def mad(trips: DataFrame, request: Request) -> DataFrame:
    """Against the weekly profile of the training table."""
    profile = request.options.get("profile")
    if profile is None:
        profile = S.weekly_profile(_bins(request.history, request))
    bins = _bins(_range(trips, request), request, _period_resolution(request))
    return A.global_mad(bins, profile, request.k)


def local_mad(trips: DataFrame, request: Request) -> DataFrame:
    """Against a rolling median, with an hour of context on each side."""
    low, high = (F.lit(t).cast("timestamp_ntz") for t in (request.start, request.end))
    hour = F.make_dt_interval(hours=F.lit(A.LOCAL_BUFFER_HOURS))
    rows = R.time_range(trips, low - hour, high + hour)
    return A.local_mad(_bins(rows, request, _period_resolution(request)), request.start, request.end, request.k)


def isolation(trips: DataFrame, request: Request) -> DataFrame:
    """Isolation forest trained on the training table's series."""
    return forest.score_series_forest(
        checkpointed(_bins(request.history, request)), _bins(_range(trips, request), request),
        request.resolution, request.k, **request.options)


def one_class(trips: DataFrame, request: Request) -> DataFrame:
    """Kernel novelty; offered from hourly bins upwards."""
    if resolution_seconds(request.resolution) < 3600:
        raise UnknownModel("no kernel model below hourly resolution")
    return kernel.score_series_kernel(
        checkpointed(_bins(request.history, request)), _bins(_range(trips, request), request),
        request.resolution, request.k, **request.options)


def density(trips: DataFrame, request: Request) -> DataFrame:
    """Density noise within the range."""
    return neighbors.dbscan_noise(_bins(_range(trips, request), request), request.k)


def _both_tables(trips: DataFrame, request: Request) -> DataFrame:
    """Binned training and new trips up to the end of the range.

    The tables are united before binning, so a bin on their border is whole.
    How far back a number of bins reaches is not known, as bins may be missing.
    """
    rows = R.union_trips(request.history, trips) if request.history is not None else trips
    return checkpointed(_bins(rows.filter(F.col(R.PICKUP) <= F.lit(request.end).cast("timestamp_ntz")), request))


def boosted(trips: DataFrame, request: Request) -> DataFrame:
    """One-step boosted-tree forecast with its conformal band.

    The option ``models`` is a table of registered models: the series' own
    serves the request and nothing is trained.  Else the option ``model`` is a
    forecaster, and without either one is trained on the history.
    """
    options = dict(request.options)
    model, models = options.pop("model", None), options.pop("models", None)
    if model is None and models is not None:
        model = registry.forecaster(models, canonical(request.metric), request.resolution, canonical(request.vendor))
        if model is None:
            raise UnknownModel(f"no model of {request.metric}, {request.resolution}, {request.vendor}")
    if model is None:
        model = Fc.fit_forecaster(checkpointed(_bins(request.history, request)), request.resolution, **options)
    if model is None:
        raise UnknownModel("the training series is too short")
    series = _both_tables(trips, request)
    return Fc.forecast_one_step(series, model, request.start, request.end, request.level)


def kernel_regression(trips: DataFrame, request: Request) -> DataFrame:
    """One-step RBF regression with its conformal band."""
    n = lag_count(request.resolution)
    rows = checkpointed(Fc.training_rows(
        checkpointed(_bins(request.history, request)), request.resolution))
    features = S.feature_names(request.resolution, n)
    model = kernel.KernelRegressor.fit(rows.filter("part = 'train'"), features, **request.options)
    held = model.transform(rows.filter("part = 'holdout'"))
    widths = Cal.conformal_widths(held, actual="value").first().asDict()
    inside = Fc.rows_in_range(_both_tables(trips, request), n, request.resolution, request.start, request.end)
    scored = model.transform(inside).select("ts", F.col("value").alias("actual"), "forecast")
    return Fc.banded(scored, widths, request.level)


def naive(trips: DataFrame, request: Request) -> DataFrame:
    """Last season repeated every 24 bins, from the newest 512 bins before the range."""
    series = _both_tables(trips, request)
    split = S.context_and_horizon(series, request.start, request.end, request.resolution, 512)
    marked = split.withColumn("split", F.when(F.col("role") == "context", "train").otherwise("val"))
    return Fc.rolling_forecast(marked, Fc.seasonal_ahead(season_bins(request.resolution)))


ANOMALY_MODELS: dict[str, Callable[[DataFrame, Request], DataFrame]] = {
    "mad": mad, "local_mad": local_mad, "if": isolation, "svm": one_class, "dbscan": density,
}
FORECAST_MODELS: dict[str, Callable[[DataFrame, Request], DataFrame]] = {
    "lgbm": boosted, "xgboost": boosted, "svr": kernel_regression, "naive": naive,
}
MODES = {"chart": {"": chart}, "raw": {"": record_scores}, "anomaly": ANOMALY_MODELS, "forecast": FORECAST_MODELS}


def forecast_all(
    trips: DataFrame, models: DataFrame, start: str, end: str, how: str = "mean", level: str = "95",
    history: DataFrame | None = None,
) -> DataFrame:
    """Forecasts of every registered series over a range: the tables are binned once and nothing is trained."""
    models = checkpointed(models)
    # a few names each
    names = models.agg(*[F.sort_array(F.collect_set(k)).alias(k) for k in SERIES_KEYS]).first()
    rows = R.union_trips(history, trips) if history is not None else trips
    rows = rows.filter(F.col(R.PICKUP) <= F.lit(end).cast("timestamp_ntz"))
    metrics = [m for m in names["metric"] if m != COUNT_METRIC]
    series = S.long_series(rows, names["resolution"], names["vendor"], metrics or VALUE_METRICS[:1], how)
    return registry.score_registered(series, models, start, end, level)


def answer(trips: DataFrame, request: Request, mode: str, model: str = "") -> DataFrame:
    """Dispatch a request by mode and model name."""
    table = MODES.get(mode)
    if table is None:
        raise UnknownModel(f"unknown mode: {mode}")
    name = "" if mode in ("chart", "raw") else canonical(model)
    if name not in table:
        raise UnknownModel(f"unknown model: {model}")
    return table[name](trips, request)
