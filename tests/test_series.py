import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import series as S

T0 = dt.datetime(2024, 1, 1)


def trips(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vendorid string, tpep_pickup_datetime timestamp_ntz, fare_amount double")


def test_bins_keep_null_bins_and_are_exact(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    df = trips(spark, [(1, "1", at(0), 1.0), (2, "2", at(59), 4.0), (3, "1", at(60), None), (4, "3", at(180), 2.0), (5, "1", at(10), None)])
    got = {r["ts"].hour: r["value"] for r in S.bin_series(df, "fare_amount", "1h").collect()}
    assert got == {0: 2.5, 1: None, 3: 2.0}
    assert {r["ts"].hour: r["value"] for r in S.bin_series(df, "sefer", "1h").collect()} == {0: 3.0, 1: 1.0, 3: 1.0}
    assert {r["ts"].hour: r["value"] for r in S.bin_series(df, "fare_amount", "1h", "mean", vendor="1").collect()} == {0: 1.0, 1: None}
    with pytest.raises(ValueError):
        S.bin_series(df, "fare_amount", "1h", "mode")
    assert S.bin_series(trips(spark, []), "fare_amount", "1h").count() == 0


def test_long_series_total_includes_other_vendors(spark):
    df = trips(spark, [(1, "1", T0, 1.0), (2, "2", T0, 3.0), (3, "9", T0, 100.0)])
    got = {r["series_id"]: r["value"] for r in S.long_series(df, ["1h", "1d"], metrics=["fare_amount"]).collect()}
    assert got["fare_amount__1h__all"] == 3.0 and got["trip_count__1d__all"] == 3.0
    assert got["fare_amount__1d__2"] == 3.0 and not any(k.endswith("__9") for k in got)
    assert len(got) == 12


@pytest.mark.parametrize("block_records", [0, 40, 50_000])
def test_long_series_is_exact_however_work_is_dealt_out(spark, block_records):
    rng = np.random.default_rng(5)
    n, names = 900, ["1m", "3m", "5m", "1h", "1d"]
    minutes = np.where(rng.random(n) < 0.4, rng.integers(0, 20, n), rng.integers(0, 3 * 1440, n))
    fares = np.round(rng.lognormal(2, 1, n), 2)
    fares[::17], fares[5], fares[6], fares[7] = np.nan, np.inf, -np.inf, -3.5
    frame = pd.DataFrame({"vendorid": rng.choice(["1", "2", "7", None], n), "at": [T0 + dt.timedelta(seconds=int(m) * 60 + 11) for m in minutes],
                          "fare": fares})
    rows = [(i, v, t.to_pydatetime(), None if i % 34 == 0 else float(f)) for i, (v, t, f) in enumerate(frame.itertuples(index=False))]
    # a record without a time keeps a bin of its own
    df = trips(spark, rows + [(n, "1", None, 4.0)])
    want, middle = {}, lambda low, high: low if low == high else low + (high - low) * 0.5
    for name in names:
        floor = frame["at"].dt.floor(name.replace("m", "min"))
        for vendor in ("all", "1", "2"):
            part = frame if vendor == "all" else frame[frame["vendorid"] == vendor]
            for ts, values in part.groupby(floor)["fare"]:
                want[f"trip_count__{name}__{vendor}", ts] = float(len(values))
                kept = np.sort(values.dropna())
                if len(kept):
                    want[f"fare_amount__{name}__{vendor}", ts] = middle(float(kept[(len(kept) - 1) // 2]), float(kept[len(kept) // 2]))
    got = S.long_series(df, names, metrics=["fare_amount"], block_records=block_records).collect()
    timeless = [r for r in got if r["ts"] is None]
    assert sorted({(r["metric"], r["vendor"], r["value"]) for r in timeless}) == [
        ("fare_amount", "1", 4.0), ("fare_amount", "all", 4.0), ("trip_count", "1", 1.0), ("trip_count", "all", 1.0)]
    assert len(timeless) == 4 * len(names)
    timed = {(r["series_id"], pd.Timestamp(r["ts"])): r["value"] for r in got if r["ts"]}
    want = {k: v for k, v in want.items() if not np.isnan(v)}
    assert timed == want and len(got) == len(want) + len(timeless)


def test_samples_of_runs_bound_ranks_and_leave_few_values():
    rng = np.random.default_rng(8)
    for values in (rng.lognormal(2, 1, 60_000), rng.integers(1, 7, 60_000).astype(float), np.r_[-np.inf, np.zeros(59_998), np.inf]):
        runs = [np.sort(x) for x in np.split(values, np.sort(rng.integers(1, 60_000, 20)))]
        runs = [r for r in runs if len(r)]
        whole, n = np.sort(values), len(values)
        for low, high in ((0, 0), ((n - 1) // 2, n // 2), (n - 1, n - 1)):
            a, b = S.rank_bounds([(len(r), r[S.sample_places(len(r))]) for r in runs], low, high)
            assert a <= whole[low] and whole[high] <= b
            step = sum(-(-len(r) // (S.RUN_SAMPLES - 1)) for r in runs)
            assert np.count_nonzero((values > a) & (values < b)) <= 4 * step


def test_long_series_without_rows_vendors_or_nested_widths(spark):
    df = trips(spark, [(1, "1", T0, 1.0), (2, "2", T0, 3.0), (3, "9", T0, 100.0), (4, None, T0, None)])
    only = lambda vendors, **more: {r["series_id"]: r["value"] for r in S.long_series(
        df, ["3m", "5m"], vendors, ["fare_amount"], **more).collect()}
    assert only(["all"]) == {"trip_count__3m__all": 4.0, "trip_count__5m__all": 4.0, "fare_amount__3m__all": 3.0, "fare_amount__5m__all": 3.0}
    assert only(["2"]) == {"trip_count__3m__2": 1.0, "trip_count__5m__2": 1.0, "fare_amount__3m__2": 3.0, "fare_amount__5m__2": 3.0}
    assert only(["2"], how="mean") == only(["2"])
    assert S.nest_widths([180, 300, 900, 3600])[:4] == [180, 900, 3600, 8 * 3600] and S.nest_widths([180, 300])[:3] == [180, 900, 7200]
    assert S.long_series(trips(spark, []), ["1h", "1d"], metrics=["fare_amount"]).count() == 0


def test_weekly_profile_and_floor(spark, series_of):
    weeks = pd.DataFrame({"ts": [T0 + dt.timedelta(weeks=w, hours=h) for w in range(5) for h in (0, 1)],
                          "value": [1.0, 5.0, 2.0, 5.0, 3.0, 5.0, 4.0, 5.0, 100.0, 5.0]})
    df = spark.createDataFrame(weeks, "ts timestamp_ntz, value double")
    got = {r["tb"]: (r["wd"], r["expected"], r["mad"]) for r in S.weekly_profile(df).collect()}
    assert got == {0: (1, 3.0, 1.0), 3600: (1, 5.0, 1e-9)}
    day = S.weekly_profile(series_of([1, 2, 3], step="1D"), monday_first=True, floor=None)
    assert {(r["wd"], r["tb"], r["mad"]) for r in day.collect()} == {(0, 0, 0.0), (1, 0, 0.0), (2, 0, 0.0)}


def test_lags_skip_null_bins(spark, series_of):
    got = S.lag_features(series_of([1, None, 2, 3, 4]), 2, resolution="1h").orderBy("ts").collect()
    assert [(r["value"], r["lag_1"], r["lag_2"]) for r in got] == [(3.0, 2.0, 1.0), (4.0, 3.0, 2.0)]
    assert [(r["wd"], r["hour"]) for r in got] == [(1, 3), (1, 4)]
    assert S.lag_features(series_of([1.0]), 2).count() == 0


def test_daily_gap_filling_matches_pandas(spark):
    days = pd.date_range("2020-02-25", periods=12)
    values = pd.Series([np.nan, np.nan, 3, np.nan, np.nan, 9, 1, np.nan, 5, np.nan, np.nan, np.nan], days)
    rows = [(d.date(), float(v)) for d, v in values.items() if v == v]
    df = spark.createDataFrame(rows, "day date, value double")
    filled = S.interpolate_linear(S.fill_calendar(df, first="2020-02-25", last="2020-03-07")).orderBy("day").toPandas()
    np.testing.assert_allclose(filled["value"], values.interpolate().bfill().ffill())


def test_calendar_lag_and_trailing_mean(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(500) if i != 10]
    df = spark.createDataFrame(rows, "day date, value double")
    got = {r["day"]: r for r in S.calendar_lag(df, [364, 365]).collect()}
    day = dt.date(2020, 1, 1) + dt.timedelta(days=375)
    assert got[day]["lag_364d"] == 11.0 and got[day]["lag_365d"] is None and len(got) == 499
    mean = {r["day"]: r["trailing_mean"] for r in S.trailing_mean(df).collect()}
    assert mean[day] == np.mean([i for i in range(0, 11) if i != 10])
    assert mean[dt.date(2020, 1, 2)] is None


def test_context_needs_enough_bins(spark, series_of):
    df = series_of(range(30))
    got = S.context_and_horizon(df, "2024-01-01 20:00:00", "2024-01-01 22:00:00", "1h", 10)
    assert {(r["role"], int(r["value"])) for r in got.collect()} == {("context", i) for i in range(10, 20)} | {("horizon", i) for i in (20, 21, 22)}
    assert S.context_and_horizon(df, "2024-01-01 07:00:00", "2024-01-01 09:00:00", "1h", 10).count() == 0


def test_rolling_origins_need_full_context(spark, series_of):
    df = series_of(range(20)).withColumn("split", F.when(F.col("value") < 5, "train").otherwise("val"))
    assert sorted(r["origin"] for r in S.rolling_origins(df, 8, 3).collect()) == [8, 11, 14, 17]
    assert sorted(r["origin"] for r in S.rolling_origins(df, 4, 3, cap=2).collect()) == [5, 17]


def test_latest_per_key_and_sampling(spark):
    df = spark.createDataFrame([("a", 1, 9.0), ("a", 3, 1.0), ("b", 2, 5.0)], "k string, v int, x double")
    assert sorted(r[:] for r in S.latest_per_key(df, ["k"], "v").collect()) == [("a", 3, 1.0), ("b", 2, 5.0)]
    ids = spark.range(5000)
    first = {r[0] for r in S.sample_rows(ids, 100).collect()}
    assert len(first) == 100 and first == {r[0] for r in S.sample_rows(ids.repartition(13), 100).collect()}
    assert S.sample_rows(ids, 5000).count() == 5000


def test_split_reports(spark, series_of):
    df = series_of(range(24 * 10), series_id="s", metric="m", resolution="1h", vendor="all")
    marked = S.with_split(df, 3)
    assert marked.filter("split = 'val'").agg(F.min("ts")).first()[0] == dt.datetime(2024, 1, 7)
    assert {r["split"]: (r["n_rows"], r["n_series"]) for r in S.split_report(marked).collect()} == {"train": (144, 1), "val": (96, 1)}
    assert S.length_report(df).first()[:] == ("1h", 1, 240, 240.0, 240)
    assert S.split_report(marked.limit(0)).count() == 0
