import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import records as R
from tidemark.sources import readers, sinks

T0 = dt.datetime(2024, 1, 1, 8)


def trips(spark, rows):
    schema = ("id bigint, vendorid string, tpep_pickup_datetime timestamp_ntz, trip_duration_minutes double, "
              "trip_distance double, total_amount double, trip_speed_mph double")
    return spark.createDataFrame(rows, schema)


def plain(spark, n=5):
    return trips(spark, [(i, str(i % 3 + 1), T0 + dt.timedelta(minutes=30 * i), 10.0, 2.0, 9.0, 12.0) for i in range(n)])


def test_ranges_and_vendor(spark):
    df = plain(spark)
    assert R.time_range(df, "2024-01-01 08:30:00", "2024-01-01 09:00:00").count() == 2
    assert R.hour_range(df, "2024-01-01 08:00:00").count() == 2
    assert R.vendor_filter(df, "hepsi").count() == 5 and R.vendor_filter(df, 1).count() == 2


def test_sanity_filter_drops_nulls_and_negatives(spark):
    rows = [(1, "1", T0, 0.0, 1.0, 1.0, 1.0), (2, "1", T0, 5.0, -1.0, 1.0, 1.0), (3, "1", T0, 5.0, 1.0, -1.0, 1.0),
            (4, "1", T0, None, 1.0, 1.0, 1.0), (5, "1", T0, 5.0, 0.0, 0.0, None)]
    assert [r["id"] for r in R.sanity_filter(trips(spark, rows)).collect()] == [5]


def test_range_filters_pass_null_and_ignore_bad_bounds(spark):
    df = trips(spark, [(1, "1", T0, 5.0, 1.0, 1.0, None), (2, "1", T0, 5.0, 9.0, 1.0, 3.0), (3, "1", T0, 5.0, 1.0, 1.0, 30.0)])
    got = R.range_filters(df, {"trip_speed_mph": ("x", "10"), "trip_distance": (None, 5)})
    assert [r["id"] for r in got.collect()] == [1]
    assert R.range_filters(df, {"trip_distance": (None, 5)}, selected=["trip_speed_mph"]).count() == 3
    assert R.range_filters(df, {}).count() == 3


def test_paging(spark):
    df = plain(spark, 60)
    got = R.page(df, 2, 25).orderBy("row_index").collect()
    assert [r["row_index"] for r in got] == list(range(26, 51))
    assert [r["id"] for r in got] == list(range(34, 9, -1))
    assert R.page(df, 1, 7).count() == 50


def test_guarded_limit(spark):
    assert R.guarded_limit(plain(spark), "trip_distance", 5).count() == 5
    with pytest.raises(R.TooManyRows):
        R.guarded_limit(plain(spark), "trip_distance", 4)


def test_metric_columns(spark):
    df = plain(spark).withColumn("pulocationid", F.lit(1))
    assert R.metric_columns(df) == ["trip_count", "trip_duration_minutes", "trip_distance", "total_amount", "trip_speed_mph"]


def test_mad_clean_is_sequential(spark):
    rows = [(i, "1", T0, 10.0 + i % 3, 2.0, 9.0, 12.0 + i % 2) for i in range(20)]
    rows += [(100, "1", T0, 10.0, 2.0, 9.0, 500.0), (101, "1", T0, 900.0, 2.0, 9.0, 12.0), (102, "1", T0, 10.0, 2.0, 9.0, None)]
    kept = R.mad_clean(trips(spark, rows), ["trip_speed_mph", "trip_duration_minutes"])
    assert sorted(r["id"] for r in kept.collect()) == list(range(20))
    assert R.mad_clean(trips(spark, []), ["trip_speed_mph"]).count() == 0


def test_constant_column_keeps_its_value(spark):
    rows = [(i, "1", T0, 10.0, 2.0, 9.0, 12.0) for i in range(5)] + [(9, "1", T0, 10.0, 2.0, 9.0, 12.1)]
    assert R.mad_clean(trips(spark, rows), ["trip_speed_mph"]).count() == 5


def test_hourly_stats(spark):
    df = plain(spark).withColumn("trip_speed_mph", F.when(F.col("id") != 1, F.col("id").cast("double")))
    got = {r["id"]: (r["hourly_trip_volume"], r["hourly_avg_speed"]) for r in R.attach_hourly_stats(df).collect()}
    assert got == {0: (2, 0.0), 1: (2, 0.0), 2: (2, 2.5), 3: (2, 2.5), 4: (1, 4.0)}


def entry_frames(spark):
    kinds = readers.entry_schema()
    rows = [(1, 7, T0, False, None, None), (2, 7, T0 + dt.timedelta(hours=1), True, 8, T0 + dt.timedelta(days=1)),
            (3, None, T0, False, None, None)]
    base = spark.createDataFrame(rows, "id bigint, added_by bigint, added_at timestamp_ntz, is_deleted boolean, deleted_by bigint, deleted_at timestamp_ntz")
    entries = readers.align_schema(
        base.withColumns({"tpep_pickup_datetime": F.col("added_at"), "vendorid": F.when(F.col("id") == 1, "2"), "fare_amount": F.when(F.col("id") == 1, 3.5)}), kinds)
    users = spark.createDataFrame([(7, "ada"), (8, "bob"), (9, "cy")], "id bigint, username string")
    return entries, users


def test_audit_trail(spark):
    entries, users = entry_frames(spark)
    log = R.activity_log(entries, users)
    assert sorted((r["entry_id"], r["action"], r["user"]) for r in log.collect()) == [
        (1, "added", "ada"), (2, "added", "ada"), (2, "deleted", "bob"), (3, "added", "—")]
    summary = {r["entry_id"]: r["summary"] for r in log.filter("action = 'added'").collect()}
    assert summary[1] == "#1 · 2024-01-01 08:00 · vendor 2 · fare 3.5"
    assert summary[3] == "#3 · 2024-01-01 08:00 · vendor — · fare —"
    assert R.activity_log(entries, users, "deleted", 8).count() == 1
    totals = {r["username"]: r[2:] for r in R.user_activity_summary(users, entries).collect()}
    assert totals["ada"] == (2, 1, 0, T0 + dt.timedelta(hours=1)) and totals["bob"] == (0, 0, 1, None)
    assert [r["username"] for r in R.users_with_entries(users, entries).collect()] == ["ada"]
    gone = R.soft_delete(entries, spark.createDataFrame([(1,), (2,)], "id bigint"), 9, "2024-02-01 00:00:00")
    assert {r["id"]: r["deleted_by"] for r in gone.collect()} == {1: 9, 2: 8, 3: None}


def test_hour_context_counts_itself_and_falls_back(spark):
    entries, _ = entry_frames(spark)
    new = entries.withColumns({"trip_distance": F.lit(10.0), "trip_duration_minutes": F.lit(30.0), "total_amount": F.lit(0.0)})
    got = {r["id"]: r for r in R.hour_context(new, plain(spark), entries).collect()}
    assert got[1]["hourly_trip_volume"] == 2 + 2 + 1 and got[1]["hourly_avg_speed"] == 12.0
    assert got[2]["hourly_trip_volume"] == 2 + 0 + 1 and got[1]["price_per_distance"] is None
    assert {r["id"]: r["hourly_avg_speed"] for r in R.hour_context(new, plain(spark, 0), entries, False).collect()}[1] == 20.0


def test_insert_ignore_keeps_existing_and_one_per_key(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string")
    old = spark.createDataFrame([(1, "z"), (None, "y")], "k int, v string")
    assert [r[:] for r in sinks.insert_ignore(new, old, ["k"]).collect()] == [(2, "b")]


def test_union_with_provenance(spark):
    entries, users = entry_frames(spark)
    got = R.union_with_provenance(plain(spark), entries, users)
    assert sorted((r["id"], r["source"], r["added_by_name"]) for r in got.filter("source = 'manual'").collect()) == [(1, "manual", "ada"), (3, "manual", None)]
    assert R.provenance_filter(got, "raw").count() == 5 and R.provenance_filter(got, "all", 7).count() == 1


def test_guard_counts_rows_with_the_metric_only(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("m"))
    assert R.guarded_limit(df, "m", 500).count() == 500
    with pytest.raises(R.TooManyRows):
        R.guarded_limit(df, "m", 499)


def test_pages_after_a_row_equal_numbered_pages(spark):
    df = spark.range(60).select("id", F.timestamp_seconds(F.floor(F.col("id") / 4)).cast("timestamp_ntz").alias(R.PICKUP))
    last, seen = None, []
    while rows := R.page_after(df, last, 25).collect():
        seen += [r["id"] for r in rows]
        last = (rows[-1][R.PICKUP], rows[-1]["id"])
    assert seen == [r["id"] for r in df.orderBy(F.desc(R.PICKUP), "id").collect()]
