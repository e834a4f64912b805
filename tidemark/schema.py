"""Fixed schemas and lookup values shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
# Raw and derived columns of a trip record, in table order.
TRIP_COLUMNS = {
    "vendorid": "string",
    "tpep_pickup_datetime": "timestamp_ntz",
    "tpep_dropoff_datetime": "timestamp_ntz",
    "passenger_count": "bigint",
    "trip_distance": "double",
    "fare_amount": "double",
    "tip_amount": "double",
    "tolls_amount": "double",
    "total_amount": "double",
    "pulocationid": "bigint",
    "dolocationid": "bigint",
    "trip_duration_minutes": "double",
    "trip_speed_mph": "double",
    "price_per_distance": "double",
    "hourly_trip_volume": "int",
    "hourly_avg_speed": "double",
}
AUDIT_COLUMNS = {
    "added_by": "bigint",
    "added_at": "timestamp_ntz",
    "is_deleted": "boolean",
    "deleted_by": "bigint",
    "deleted_at": "timestamp_ntz",
}

# The count metric and the eleven numeric metrics.
COUNT_METRIC = "trip_count"
VALUE_METRICS = [
    "passenger_count", "trip_distance", "fare_amount", "tip_amount",
    "tolls_amount", "total_amount", "trip_duration_minutes", "trip_speed_mph",
    "price_per_distance", "hourly_trip_volume", "hourly_avg_speed",
]
METRICS = [COUNT_METRIC, *VALUE_METRICS]

# Names used in older data files for the same things.
ALIASES = {
    "sefer": "trip_count", "hepsi": "all", "zaman": "ts", "deger": "value",
    "wd": "wd", "saat": "hour", "dakika": "minute", "saniye": "second",
    "bek": "expected", "beklenen": "expected", "z_skoru": "z",
    "tahmin": "prediction", "gercek_deger": "actual", "coz": "resolution",
    "metrik": "metric", "yok": "none", "sure_dk": "trip_duration_minutes",
    "hiz_mph": "trip_speed_mph", "mad_lokal": "local_mad",
}

# Resolution code -> bin width in seconds.
RESOLUTION_SECONDS = {
    "1s": 1, "3s": 3, "5s": 5, "10s": 10, "15s": 15, "30s": 30,
    "1m": 60, "3m": 180, "5m": 300, "10m": 600, "15m": 900, "30m": 1800,
    "1h": 3600, "3h": 10800, "1d": 86400,
}
TRAINING_RESOLUTIONS = ["1m", "3m", "5m", "10m", "15m", "30m", "1h", "3h", "1d"]
# Resolution code -> coarse period, and period -> seconds.
RESOLUTION_PERIOD = {
    "1m": "minute", "3m": "minute", "5m": "minute", "10m": "minute",
    "15m": "minute", "30m": "minute", "1h": "hour", "3h": "hour", "1d": "day",
}
PERIOD_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
# Resolution code -> season length in bins.
SEASON_BINS = {
    "1s": 3600, "3s": 1200, "5s": 720, "10s": 360, "15s": 240, "30s": 120,
    "1m": 1440, "3m": 480, "5m": 288, "10m": 144, "15m": 96, "30m": 48,
    "1h": 24, "3h": 8, "1d": 7,
}
VENDORS = ["all", "1", "2"]
ALL_VENDORS = "all"
# Features a record is cleaned on.
CLEAN_FEATURES = [
    "trip_distance", "trip_duration_minutes", "trip_speed_mph",
    "price_per_distance",
]
PAGE_SIZES = [25, 50, 100]
GUARD_ROWS = 30_000
# Robust z-score constant and the smallest usable spread.
Z_SCALE = 0.6745
MAD_FLOOR = 1e-9
# Isolation forest defaults.
TREES = 100
TREE_ROWS = 256
STREAM_CONTAMINATION = 0.026
FILE_CONTAMINATION = 0.02
SERIES_CONTAMINATION = 0.05
MIN_FOREST_ROWS = 20
# Lags of the forecasters below an hour, below a day, and else.
MINUTE_LAGS, HOUR_LAGS, DAY_LAGS = 60, 48, 14
# Columns that are never a metric.
NO_METRICS = [
    "id", "vendorid", "pulocationid", "dolocationid",
    "tpep_pickup_datetime", "tpep_dropoff_datetime", "sure_dk", "hiz_mph",
]
# ---- end of fixed values ----------------------------------------------------

SERIES_KEYS = ["metric", "resolution", "vendor"]


def struct_of(columns: dict[str, str]) -> T.StructType:
    """A nullable StructType from a name -> type-name mapping."""
    return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns.items()))


def canonical(name: str) -> str:
    """The library's name for a possibly aliased one."""
    return ALIASES.get(name, name)


def resolution_seconds(resolution: str) -> int:
    return RESOLUTION_SECONDS.get(resolution, 3600)


def resolution_period(resolution: str) -> str:
    return RESOLUTION_PERIOD.get(resolution, "hour")


def season_bins(resolution: str) -> int:
    return SEASON_BINS.get(resolution, 24)


def lag_count(resolution: str) -> int:
    """Lags used by the forecasters."""
    width = resolution_seconds(resolution)
    return MINUTE_LAGS if width < 3600 else HOUR_LAGS if width < 86400 else DAY_LAGS


def time_feature_names(resolution: str) -> list[str]:
    """Calendar features that vary at a resolution."""
    width = resolution_seconds(resolution)
    names = ["wd", "hour", "minute"]
    return names[: 1 if width >= 86400 else 2 if width >= 3600 else 3]


def resolution_lookup(resolution: Column, table: dict, default) -> Column:
    """Map a resolution column through one of the tables above."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), resolution), F.lit(default))
