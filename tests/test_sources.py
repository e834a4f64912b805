import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.plans import preparation
from tidemark.sources import readers, sinks

SCHEMA = {"id": "bigint", "vendorid": "string", "tpep_pickup_datetime": "timestamp_ntz", "passenger_count": "bigint", "trip_distance": "double"}


def test_month_range():
    assert readers.month_range("2015-11:2016-02") == ["2015-11", "2015-12", "2016-01", "2016-02"]
    assert readers.month_range("2016-02:2015-11") == []


def test_csv_with_bom_blanks_and_bad_cells(spark, tmp_path):
    text = "﻿ID,VendorID,tpep_pickup_datetime,passenger_count,trip_distance,unknown\n" \
           "1,2,2017-01-01T10:05,3.0,1.5,x\n2,,2017-01-01 10:06:30,,bad,y\n3,1,never,1,1,z\n4,1,,1,1,z\n"
    (tmp_path / "in.csv").write_text(text, encoding="utf-8")
    rows = readers.read_entries_csv(spark, str(tmp_path / "in.csv"), SCHEMA).orderBy("id").collect()
    assert [r[:] for r in rows] == [
        (1, "2", dt.datetime(2017, 1, 1, 10, 5), 3, 1.5), (2, None, dt.datetime(2017, 1, 1, 10, 6), None, None)]


def test_scan_unites_files_of_different_schemas(spark, tmp_path):
    a = spark.sql("SELECT 1L AS VendorID, TIMESTAMP_NTZ'2015-01-05 00:00:00' AS tpep_pickup_datetime, 2.0D AS passenger_count, 1 AS junk")
    b = spark.sql("SELECT 'x' AS vendorid, TIMESTAMP_NTZ'2015-02-05 00:00:00' AS tpep_pickup_datetime, 3L AS passenger_count, 1.5D AS trip_distance")
    for name, df in (("t_2015-01.parquet", a), ("t_2015-02.parquet", b)):
        df.coalesce(1).toPandas().to_parquet(tmp_path / name, coerce_timestamps="us")
    rows = readers.scan_trips(spark, str(tmp_path)).orderBy("tpep_pickup_datetime").collect()
    assert [(r["vendorid"], r["passenger_count"], r["trip_distance"]) for r in rows] == [("1", 2, None), ("x", 3, 1.5)]
    assert readers.scan_trips(spark, str(tmp_path), "2015-02:2015-02").count() == 1
    assert readers.scan_trips(spark, str(tmp_path / "t_2015-01.parquet")).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.scan_trips(spark, str(tmp_path), "2019-01:2019-02")


def test_footers_of_many_files_are_read_by_tasks(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = dt.datetime(2015, 1, 5)
    kinds = [{"VendorID": 1, "passenger_count": 2.0}, {"vendorid": "x", "passenger_count": 3}, {"vendorid": "y", "passenger_count": 4, "junk": True}]
    (tmp_path / "below").mkdir()
    for i in range(150):
        row = {**kinds[i % 3], "tpep_pickup_datetime": at, "id": i}
        pq.write_table(pa.Table.from_pylist([row]), tmp_path / ("below" if i % 2 else "") / f"t {i:03d}.parquet")
    files = readers._parquet_files(spark, str(tmp_path))
    found = readers.footers(spark, files)
    assert found.rdd.getNumPartitions() == 3
    assert sorted(r["n"] for r in found.groupBy("footer").agg(F.count(F.lit(1)).alias("n")).collect()) == [50, 50, 50]
    parts = readers._by_schema(spark, files)
    assert len(parts) == 3 and all(len(p.inputFiles()) == 50 for p in parts)
    want = [(i, str(list(kinds[i % 3].values())[0]), int(kinds[i % 3]["passenger_count"])) for i in range(150)]

    def rows():
        return [(r["id"], r["vendorid"], r["passenger_count"]) for r in readers.scan_trips(spark, str(tmp_path), schema=SCHEMA).orderBy("id").collect()]

    assert rows() == want
    # what tasks cannot reach, Spark reads
    closed = found.withColumn("footer", F.when(~F.col("file").endswith("7.parquet"), F.col("footer")))
    monkeypatch.setattr(readers, "footers", lambda *a: closed)
    assert rows() == want
    assert readers._footer(str(tmp_path / "none.parquet")) is None and readers._footer("odd://a/b") is None


def test_load_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3)
    assert sinks.load_table(df, path, "if_empty") and not sinks.load_table(df, path, "if_empty")
    sinks.load_table(df, path, "keep")
    assert spark.read.parquet(path).count() == 6
    sinks.load_table(df, path)
    assert spark.read.parquet(path).count() == 3


def test_csv_export_writes_blanks_and_minutes(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ'2024-01-01 10:05:33' AS t, CAST(NULL AS DOUBLE) AS v")
    sinks.write_csv(df, str(tmp_path / "out"), ["id", "t", "v"])
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text.splitlines() == ["id,t,v", "1,2024-01-01 10:05,"]


def test_prepare_and_export(spark, tmp_path):
    raw = readers.events_as_trips(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    raw.coalesce(1).toPandas().to_parquet(tmp_path / "raw_2024-01.parquet", coerce_timestamps="us")
    preparation.prepare_trips(spark, str(tmp_path / "raw_2024-01.parquet"), str(tmp_path / "trips"), clean=False)
    trips = spark.read.parquet(str(tmp_path / "trips"))
    assert trips.select("pickup_date").distinct().count() == 30
    assert trips.filter("trip_duration_minutes <= 0").count() == 0
    preparation.export_series(trips, str(tmp_path / "series"), ["1h", "1d"], test_days=8)
    stored = spark.read.parquet(str(tmp_path / "series"))
    assert {r[0] for r in stored.select("split").distinct().collect()} == {"train", "val"}
    cut = stored.filter("split = 'val'").agg(F.min("ts")).first()[0]
    assert cut >= dt.datetime(2024, 1, 22)


def test_own_layout_is_read_back(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 5)), (2, dt.datetime(2024, 1, 2, 5))]
    df = readers.align_schema(
        spark.createDataFrame(rows, "passenger_count bigint, tpep_pickup_datetime timestamp_ntz"), readers.TRIP_COLUMNS)
    sinks.write_trips(df, str(tmp_path / "trips"))
    back = readers.scan_trips(spark, str(tmp_path / "trips"))
    assert sorted(r["passenger_count"] for r in back.collect()) == [1, 2] and back.columns == df.columns
