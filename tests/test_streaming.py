import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast as Fc
from tidemark.operators import series as S
from tidemark.operators.boosting import Boosting, Ensemble
from tidemark.sources import readers
from tidemark.streaming import matching, pipeline, sources

COLUMNS = {"id": "bigint", "vendorid": "string", "tpep_pickup_datetime": "timestamp_ntz", "trip_distance": "double",
           "trip_duration_minutes": "double", "trip_speed_mph": "double", "price_per_distance": "double", "total_amount": "double"}


def day_rows(spark, day, ids, hour=None):
    rng = np.random.default_rng(day)
    rows = []
    for i in ids:
        at = dt.datetime(2024, 1, day, int(rng.integers(0, 24)) if hour is None else hour, int(rng.integers(0, 60)))
        d, m = float(rng.normal(5, 1)), float(rng.normal(20, 2))
        rows.append((i, "1", at, d, m, d / m * 60, 3.0 + float(rng.normal(0, 0.1)), 3 * d))
    return readers.align_schema(spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in COLUMNS.items())), COLUMNS)


def files(spark, folder):
    """Three days, an out-of-order file within a day, then a late file."""
    parts = [day_rows(spark, 1, range(0, 80)), day_rows(spark, 2, range(100, 180)), day_rows(spark, 2, range(200, 220), hour=1),
             day_rows(spark, 4, range(300, 340)), day_rows(spark, 1, range(900, 907), hour=3)]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/part_{i}")
        import time

        time.sleep(1.1)  # file order follows modification time
    return parts


def drain(stream, folder):
    query = (stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/offsets")
             .outputMode("append").trigger(availableNow=True).start(f"{folder}/out"))
    query.awaitTermination()
    return query


def test_stream_matches_batch_and_counts_late_rows(spark, tmp_path):
    parts = files(spark, str(tmp_path / "in"))
    stream = sources.read_trip_stream(spark, str(tmp_path / "in"), COLUMNS, 1)
    query = drain(sources.stream_bin_series(stream, "total_amount", "1h", "30 minutes"), str(tmp_path))
    got = {r["ts"]: r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    on_time = parts[0].unionByName(parts[1]).unionByName(parts[2])
    want = {r["ts"]: r["value"] for r in S.bin_series(on_time, "total_amount", "1h", "mean").collect()}
    # the out-of-order file falls behind day 2's newest time, so its bin keeps the rows that were on time
    for ts, value in got.items():
        if ts.date() == dt.date(2024, 1, 1):
            assert abs(value - want[ts]) < 1e-9
    assert sources.late_rows(query) > 0
    assert sources.query_status(query)["running"] is False


def test_pipeline_cleans_blocks_and_reports(spark, tmp_path):
    files(spark, str(tmp_path / "in"))
    settings = pipeline.Settings(metrics=("trip_count", "total_amount"), trees=20, contamination=0.05, lags=4,
                                 fresh_rounds=2, update_rounds=2, depth=2, models=("boosted", "broken"))

    def broken(pipe, metric, series, block):
        raise RuntimeError("no model here")

    updaters = {"boosted": pipeline.boosted_updates, "broken": broken}
    pipe = pipeline.BlockPipeline(spark, str(tmp_path / "state"), settings, updaters)
    pipe.run(sources.read_trip_stream(spark, str(tmp_path / "in"), COLUMNS, 1))
    rows = pipe.telemetry().collect()
    assert sorted({r["window_index"] for r in rows}) == [0, 1, 2] and len(rows) == 12
    by_window = {r["window_index"]: r for r in rows if r["model_name"] == "boosted" and r["metric"] == "trip_count"}
    # blocks are whole days: the out-of-order file is in day 2, the late one was dropped and counted
    assert [by_window[i]["n_raw"] for i in range(3)] == [80, 100, 40]
    assert pipe.late().agg(F.sum("n_late")).first()[0] == 7
    assert {r["status"] for r in rows if r["model_name"] == "broken"} == {"error"}
    assert all("no model here" in r["detail"] for r in rows if r["model_name"] == "broken")
    assert pipe.cleaned().count() == sum(by_window[i]["n_clean"] for i in range(3))
    bins = pipe.series("trip_count")
    assert bins.agg(F.sum("value")).first()[0] == pipe.cleaned().count()
    # a new pipeline over the same folder carries on: nothing is processed twice
    again = pipeline.BlockPipeline(spark, str(tmp_path / "state"), settings, updaters)
    again.run(sources.read_trip_stream(spark, str(tmp_path / "in"), COLUMNS, 1))
    assert again.telemetry().count() == 12


def test_reprocessing_a_block_replaces_it(spark, tmp_path):
    settings = pipeline.Settings(metrics=("trip_count",), trees=20, lags=2, models=())
    pipe = pipeline.BlockPipeline(spark, str(tmp_path), settings)
    rows = day_rows(spark, 1, range(60)).withColumn("block", F.lit("2024-01-01T00-00"))
    for _ in range(2):
        pipe.accumulate(rows)
    assert pipe.cleaned().count() == 60 and pipe.series("trip_count").agg(F.sum("value")).first()[0] == 60


def test_max_windows_and_prewarm(spark, tmp_path):
    history = day_rows(spark, 1, range(60)).unionByName(day_rows(spark, 2, range(100, 160))).unionByName(day_rows(spark, 3, range(200, 260)))
    settings = pipeline.Settings(metrics=("trip_count",), trees=20, lags=2, fresh_rounds=2, update_rounds=2, depth=2)
    pipe = pipeline.BlockPipeline(spark, str(tmp_path), settings)
    pipe.prewarm(history, "2024-01-03", 5)
    assert pipe.progress() == ("", 0) and pipe.series("trip_count").count() <= 48
    row = pipe.retrain(history, "2024-01-03").first()
    assert row["n_raw"] == 60 and row["window_index"] == 0 and pipe.progress() == ("2024-01-03T00-00", 1)
    assert pipe.retrain(history, "2024-02-01").count() == 0


def test_stream_queries_run_the_default_settings(monkeypatch):
    from checks import queries

    used = []

    class Recorded:
        def __init__(self, spark, folder, settings=None, updaters=None):
            used.append(settings or pipeline.Settings())
            raise InterruptedError

    monkeypatch.setattr(queries.pipeline, "BlockPipeline", Recorded)
    monkeypatch.setattr(queries, "scratch", lambda spark, name: name)
    for name in ("stream_telemetry", "stream_prewarm"):
        with pytest.raises(InterruptedError):
            queries.QUERIES[name](None, "")
    assert used == [pipeline.Settings()] * 2 and used[0].lags is None and used[0].update_every == {}


def test_updates_in_turn_equal_updates_one_by_one(spark, series_of):
    rng = np.random.default_rng(2)
    values = 50 + 9 * np.sin(np.arange(260) * 2 * np.pi / 24) + rng.normal(0, 1, 260)
    series = series_of(values)
    bins = series.select(F.lit("m").alias("metric"), "ts", "value", F.date_format("ts", "yyyy-MM-dd").alias("window"))
    short = bins.limit(30).withColumn("metric", F.lit("short"))
    names = ["2024-01-08", "2024-01-09", "2024-01-11"]
    ways = [Boosting(r, 3, Fc.STEP_SIZE, Fc.MIN_LEAF, Fc.ROW_SHARE, Fc.BINS, Fc.PATIENCE, 42) for r in (5, 9)]
    none = spark.createDataFrame([], f"metric string, {Fc.UPDATED}")
    got = {(r["metric"], r["window"]): r for r in Fc.update_in_turn(
        bins.unionByName(short), none, ["metric"], names, "1h", "finetune", *ways, 24, 200).collect()}
    assert len(got) == 6 and {got["short", n]["status"] for n in names} == {"warmup"}
    model = None
    for name in names:
        window = S.keep_newest(series.filter(F.date_format("ts", "yyyy-MM-dd") <= name), 200)
        one = Fc.update_forecaster(model, window, "1h", "finetune", 5, 9, 3, 24)
        r, model = got["m", name], one.model
        assert (r["status"], r["n_train"]) == (one.status, one.n_train)
        assert r["wape"] == pytest.approx(one.wape) and r["mae"] == pytest.approx(one.mae)
    last = Ensemble.of_row(got["m", names[-1]])
    assert len(last.roots) == 9 + 5 + 5 == model.trees()
    x = np.vstack([values[-25:-1][::-1]])
    assert last.predict(np.hstack([x, [[3, 7]]])) == pytest.approx(model.ensemble.predict(np.hstack([x, [[3, 7]]])))


def test_the_log_adds_up_more_than_a_hundred_batches_and_restarts(spark, tmp_path):
    log = sources.StreamLog(spark, str(tmp_path))
    for batch in range(150):
        log.add("q", batch, 10, batch % 2, 5)
    log.add("q", 149, 30, 4, 6)  # the last batch again, from the start
    log.add("q", 3, 99, 99, 99)  # an old report
    log.save()
    again = sources.StreamLog(spark, str(tmp_path))
    assert again.totals() == {"q": {"batch": 149, "batches": 150, "input_rows": 1520, "late_rows": 78, "milliseconds": 751}}
    again.add("q", 150, 1, 1, 1)
    assert again.totals()["q"]["late_rows"] == 79


def test_stream_medians_are_near_the_middle_and_wait_for_late_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = rng.lognormal(2, 1, 20_000)
    base = pd.Timestamp("2024-01-01")
    times = base + pd.to_timedelta(rng.integers(0, 3600, len(values)), unit="s")
    rows = pd.DataFrame({"tpep_pickup_datetime": times, "vendorid": "1", "total_amount": values})
    odd = pd.DataFrame({"tpep_pickup_datetime": [base + pd.Timedelta(hours=h) for h in (1, 1, 1, 2, 9)], "vendorid": "1",
                        "total_amount": [4.0, 8.0, 2.0, None, 1.0]})
    columns = {"tpep_pickup_datetime": "timestamp_ntz", "vendorid": "string", "total_amount": "double"}
    ddl = ", ".join(f"{n} {k}" for n, k in columns.items())
    for i, part in enumerate([rows[:12_000], rows[12_000:], odd]):
        part = part.astype({"total_amount": object}).where(part.notna(), None)
        spark.createDataFrame([(t.to_pydatetime(), v, x) for t, v, x in part.itertuples(index=False)], ddl).write.parquet(str(tmp_path / "in" / str(i)))
    stream = sources.read_trip_stream(spark, str(tmp_path / "in"), columns, 1)
    query = (sources.stream_bin_medians(stream, "total_amount", "1h", "2 hours", ["vendorid"]).writeStream.format("parquet")
             .option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination()
    got = {r["ts"].hour: (r["n"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {0, 1} and got[1] == (3, 4.0) and got[0][0] == len(values)
    assert abs((values < got[0][1]).mean() - 0.5) < 0.01


def test_stream_matching_equals_the_batch_form(spark, tmp_path):
    """Out-of-order slices, repeated forecasts, NULL keys and values, bins without a forecast, forecasts without a bin."""
    hour = dt.timedelta(hours=1)
    start = dt.datetime(2024, 1, 1)
    actuals = [(k, start + i * hour, None if i % 11 == 5 else float(i)) for i in range(96) for k in ("x", None)]
    forecasts = [(k, start + (i + h) * hour, start + i * hour, float(1000 * i + h)) for i in range(96) for h in range(1, 7)
                 for k in ("x", None) if (i + h) % 10 != 4]
    forecasts += [("x", start + 8 * hour, start + 7 * hour, None), ("lone", start + 9 * hour, start, 1.0)]
    schemas = {"a": "k string, ts timestamp_ntz, value double", "f": "k string, ts timestamp_ntz, made_at timestamp_ntz, forecast double"}
    for name, rows, at in (("a", actuals, 1), ("f", forecasts, 2)):
        for s in range(4):
            # the last two hours of a day come first
            part = [r for r in rows if (r[at] - start) // dt.timedelta(days=1) == s]
            part = sorted(part, key=lambda r: ((r[at].hour < 22), r[at]))
            spark.createDataFrame(part, schemas[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}/{s}")

    def stream(name):
        rows = spark.readStream.schema(schemas[name]).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
        return rows.parquet(f"{tmp_path}/{name}").withColumn("ts", F.col("ts").cast("timestamp"))

    drain(matching.stream_matches(stream("a"), stream("f"), ["k"], "2 hours", "6 hours"), str(tmp_path))
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {(r["k"], r["ts"]): (r["value"], r["forecast"]) for r in got.collect()}
    a, f = (spark.createDataFrame(rows, schemas[n]) for n, rows in (("a", actuals), ("f", forecasts)))
    batch = {(r["k"], r["ts"]): r["forecast"] for r in Fc.match_forecasts(
        a.fillna("-", "k"), f.dropna(subset=["forecast"]).fillna("-", "k"), ["k"]).collect()}
    closed = start + 93 * hour
    want = {(k, ts): (v, batch.get((k or "-", ts))) for k, ts, v in actuals if ts <= closed}
    assert got == want
    assert sum(v is None for _, v in got.values()) > 18


class _State:
    """A state in memory that counts its elements."""

    def __init__(self):
        self.rows = []

    exists = lambda self: bool(self.rows)
    clear = lambda self: self.rows.clear()
    appendValue = lambda self, row: self.rows.append(row)
    get = lambda self: self.rows[0] if isinstance(self.rows, tuple) else iter(self.rows)


class _Handle:
    def __init__(self):
        self.lists, self.value = {}, _State()
        self.value.update = lambda row: setattr(self.value, "rows", (row,))

    def getListState(self, name, kind):
        return self.lists.setdefault(name, _State())

    getValueState = lambda self, name, kind: self.value
    registerTimer = lambda self, at: None


def test_count_windows_of_a_stream_come_in_packs():
    """Neither state elements nor output frames grow with single rows or windows."""
    from types import SimpleNamespace

    from tidemark.streaming.windows import CountWindows

    n, size, step = 20_000, 100, 40
    rng, base = np.random.default_rng(6), pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"id": rng.permutation(n), "ts": base + pd.to_timedelta(np.sort(rng.integers(0, n, n)), unit="s"), "x": rng.random(n)})
    rows.loc[::9, "x"] = np.nan
    made = CountWindows(["k"], ["id", "ts", "x"], None, size, step, ("ts", "id"))
    made.init(_Handle())
    frames, marks = [], [base - pd.Timedelta(days=1), base + pd.Timedelta(seconds=n // 2), base + pd.Timedelta(days=9)]
    for mark, part in zip(marks, (rows[:0], rows, None)):
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark.value / 1e6)
        frames += list(made.handleInputRows(("a",), [part], times) if part is not None else made.handleExpiredTimer(("a",), times, None))
        if part is not None and len(part):
            late = part["ts"] <= mark
    assert sum(len(s.rows) for s in made.handle.lists.values()) <= 4 and len(frames) <= 8
    got = pd.concat(frames, ignore_index=True)
    kept = rows[~late].sort_values(["ts", "id"]).reset_index(drop=True)
    want = pd.concat([kept[i * step:i * step + size].assign(window_index=i) for i in range((len(kept) - size) // step + 1)], ignore_index=True)
    pd.testing.assert_frame_equal(got[["id", "ts", "x", "window_index"]], want, check_dtype=False)
    assert set(got["k"]) == {"a"}
