import datetime as dt

import holidays_rule  # noqa: F401  (local helper)
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark import schema


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def trip(spark, rows):
    return spark.createDataFrame(
        rows, "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, trip_distance double, total_amount double")


def test_derived_measures_and_their_modes(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0, 900000)
    rows = [(t0, dt.datetime(2024, 1, 1, 10, 30, 1, 500000), 10.0, 30.0), (t0, t0, 5.0, 7.0),
            (t0, dt.datetime(2024, 1, 1, 9, 0, 0, 0), 0.0, 4.0), (t0, t0 + dt.timedelta(hours=1), None, 4.0)]
    base = trip(spark, rows).withColumn("trip_duration_minutes", C.trip_duration_minutes())
    out = base.select("trip_duration_minutes", C.trip_speed_mph().alias("s"), C.trip_speed_mph("eps").alias("se"),
                      C.price_per_distance().alias("p"), C.price_per_distance("eps").alias("pe")).collect()
    assert out[0]["trip_duration_minutes"] == 30.0 and out[0]["s"] == 20.0 and out[0]["p"] == 3.0
    assert out[1][:] == (0.0, None, 5000.0, 1.4, 1.4)
    assert out[2]["trip_duration_minutes"] == -60.0 and out[2]["p"] is None and out[2]["pe"] == 4000.0
    assert out[3]["s"] is None and out[3]["p"] is None


def test_bins_for_every_resolution(spark):
    at = dt.datetime(2023, 12, 31, 23, 59, 59, 999999)
    for name, width in schema.RESOLUTION_SECONDS.items():
        got = one(spark, b=C.bin_to(ntz(str(at)), name))["b"]
        since = int((at - dt.datetime(1970, 1, 1)).total_seconds())
        assert got == dt.datetime(1970, 1, 1) + dt.timedelta(seconds=since // width * width), name
    edge = ntz("2024-01-01 03:00:00")
    assert one(spark, b=C.bin_to(edge, "3h"))["b"] == dt.datetime(2024, 1, 1, 3)


def test_calendar_parts(spark):
    sunday = ntz("2024-01-07 05:06:07")
    row = one(spark, wd=C.weekday_sunday0(sunday), tb=C.seconds_of_day(sunday), name=C.day_name(sunday),
              m=C.trunc_minute(sunday), h=C.trunc_hour(sunday), d=C.trunc_day(sunday))
    assert row[:] == (0, 5 * 3600 + 6 * 60 + 7, "Sunday", dt.datetime(2024, 1, 7, 5, 6), dt.datetime(2024, 1, 7, 5), dt.datetime(2024, 1, 7))
    assert one(spark, a=C.seconds_from(F.lit("01:02:03"), True), b=C.seconds_from(F.lit(77), False))[:] == (3723, 77)


def test_holidays_by_rule(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2014-01-01', DATE'2020-12-31')) AS day")
    got = {r["day"] for r in days.filter(C.is_us_holiday("day")).collect()}
    for text in ("2014-01-01", "2015-07-03", "2015-07-04", "2016-12-26", "2016-12-25", "2017-01-02", "2018-11-22",
                 "2019-05-27", "2019-10-14", "2014-09-01", "2016-01-18", "2016-02-15", "2017-11-10"):
        assert dt.date.fromisoformat(text) in got, text
    assert all(d.year < 2020 for d in got)
    assert got == holidays_rule.expected(range(2014, 2020))


def test_coercion(spark):
    texts = [" 3.9 ", "", None, "x", "-2.7", "1e3", "NaN"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(C.coerce_float("t").alias("f"), C.coerce_int("t").alias("i")).collect()
    assert [r["i"] for r in rows] == [3, None, None, None, -2, 1000, None]
    assert [r["f"] for r in rows[:6]] == [3.9, None, None, None, -2.7, 1000.0]
    times = ["2017-01-01T10:05", "2017-01-01 10:05:59", "2017-01-01", "no", "", "2017-13-01 10:05"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(C.parse_pickup("t")).collect()]
    assert got == [dt.datetime(2017, 1, 1, 10, 5)] * 2 + [None] * 4


def test_scores_and_display(spark):
    row = one(spark, z=C.robust_z(F.lit(5.0), F.lit(3.0), F.lit(2.0)), zf=C.robust_z(F.lit(4.0), F.lit(3.0), F.lit(0.0)),
              zn=C.robust_z(F.lit(4.0), F.lit(3.0), F.lit(0.0), "null"), c=C.clip_lower(F.lit(-1.0)),
              f=C.finite_or_zero(F.lit(float("inf"))), g=C.finite_or_zero(F.lit(None)), d=C.display_fixed(F.lit(2.5)),
              n=C.display_number(F.lit(None).cast("double")), s=C.series_id(F.lit("a"), F.lit("1h"), F.lit("all")))
    assert row["z"] == 0.6745 and row["zf"] == 0.6745 / 1e-9 and row["zn"] is None
    assert row[3:] == (0.0, 0.0, 0.0, "2.50", "", "a__1h__all")
    band = spark.createDataFrame([(1.0, 0.0, 2.0), (3.0, 0.0, 2.0), (None, 0.0, 2.0), (float("nan"), 0.0, 2.0)], "actual double, lower double, upper double")
    assert [r[0] for r in band.select(C.outside_band()).collect()] == [False, True, False, False]


def test_lookups(spark):
    assert schema.canonical("sefer") == "trip_count" and schema.canonical("total_amount") == "total_amount"
    assert schema.resolution_seconds("?") == 3600 and schema.resolution_period("10s") == "hour"
    assert [schema.lag_count(r) for r in ("1m", "1h", "1d")] == [60, 48, 14]
    assert schema.time_feature_names("1m") == ["wd", "hour", "minute"] and schema.time_feature_names("1d") == ["wd"]
    got = one(spark, a=schema.resolution_lookup(F.lit("3h"), schema.SEASON_BINS, 24), b=schema.resolution_lookup(F.lit("x"), schema.SEASON_BINS, 24))
    assert got[:] == (8, 24)


def test_bins_of_any_width_are_consecutive(spark):
    hours = spark.range(24 * 14).select(F.timestamp_seconds(F.col("id") * 3600 + 1_700_000_000 - 1_700_000_000 % 3600).cast("timestamp_ntz").alias("ts"))
    for width in (5 * 3600, 48 * 3600, 7 * 86400):
        rows = hours.select("ts", C.bin_floor("ts", width).alias("b"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"),
                            F.unix_seconds(C.bin_floor("ts", width).cast("timestamp")).alias("t")).collect()
        assert all(r["t"] == r["s"] - r["s"] % width for r in rows)
