"""Whole preparation jobs: files to engineered tables, tables to long series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import records as R
from tidemark.operators import series as S
from tidemark.schema import TRAINING_RESOLUTIONS, VENDORS, resolution_period
from tidemark.session import checkpointed
from tidemark.sources import readers, sinks


def prepare_trips(
    spark: SparkSession, source: str, target: str, months: str | None = None, clean: bool = True
) -> None:
    """Read monthly files, engineer them and store the table by pickup date."""
    trips = R.engineer_trips(readers.scan_trips(spark, source, months), clean)
    sinks.write_trips(trips, target)


def export_series(
    trips: DataFrame, target: str, resolutions: list[str] | None = None,
    vendors: list[str] | None = None, test_days: int = 120,
) -> None:
    """Store every metric x resolution x vendor series with its split label."""
    series = checkpointed(S.long_series(trips, resolutions or TRAINING_RESOLUTIONS, vendors or VENDORS))
    sinks.write_series(S.with_split(series, test_days), target)


def profiles(trips: DataFrame, resolutions: list[str] | None = None) -> DataFrame:
    """Weekly profiles of the mean series of every metric, resolution and vendor.

    Resolutions between a minute, an hour and a day are means of the next finer
    of these, so wide bins weigh their finer bins equally.
    """
    wanted = resolutions or TRAINING_RESOLUTIONS
    keys = ["metric", "resolution", "vendor"]
    base = {"minute": "1m", "hour": "1h", "day": "1d"}
    needed = sorted({base[resolution_period(r)] for r in wanted})
    fine = checkpointed(S.long_series(trips, needed, VENDORS, how="mean").select(*keys, "ts", "value"))
    out = None
    for r in wanted:
        rows = fine.filter(fine["resolution"] == base[resolution_period(r)]).drop("resolution")
        if r not in base.values():
            rows = S.resample_mean(rows, r, ["metric", "vendor"])
        profile = S.weekly_profile(rows, ["metric", "vendor"])
        profile = profile.selectExpr("metric", f"'{r}' AS resolution", "vendor", "wd", "tb", "expected", "mad")
        out = profile if out is None else out.unionByName(profile)
    return out

