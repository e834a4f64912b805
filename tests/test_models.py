import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomaly as A
from tidemark.operators import boosting
from tidemark.operators import calibration as Cal
from tidemark.operators import forecast as Fc
from tidemark.operators import forest, kernel, neighbors
from tidemark.operators import series as S
from tidemark.plans import requests


def spiky(n=400, at=(150, 300), seed=0):
    rng = np.random.default_rng(seed)
    hours = np.arange(n)
    values = 100 + 20 * np.sin(hours * 2 * np.pi / 24) + rng.normal(0, 1, n)
    for i in at:
        values[i] *= 10
    return values


def test_every_detector_finds_planted_spikes(spark, series_of):
    df, train = series_of(spiky()), series_of(spiky(at=(), seed=1))
    spikes = {df.toPandas().sort_values("ts")["ts"].iloc[i] for i in (150, 300)}
    found = {
        "global": A.global_mad(df, S.weekly_profile(train), 6.0),
        "local": A.local_mad(df, "2024-01-01 00:00:00", "2024-02-01 00:00:00", 8.0),
        "forest": forest.score_series_forest(train, df, "1h", 3.0, trees=40),
        "kernel": kernel.score_series_kernel(train, df, "1h", 3.0),
        "density": neighbors.dbscan_noise(df, 3.0),
    }
    for name, out in found.items():
        flagged = {pd.Timestamp(r["ts"]) for r in out.filter("is_anomaly").collect()}
        assert spikes <= flagged, name


def test_blend_switches_at_five_rows(spark, series_of):
    four = A.blend_score(series_of([1, 1, 9, 1]).withColumn("z", F.lit(2.5)), 2.0)
    assert {r["score"] for r in four.collect()} == {2.5} and four.filter("is_anomaly").count() == 4
    five = A.blend_score(series_of([1, 1, 9, 1, 1]).withColumn("z", F.lit(-2.5)), 2.0).orderBy("ts").collect()
    assert [r["is_anomaly"] for r in five] == [False, False, True, False, False]
    assert five[2]["score"] == pytest.approx(0.6 * 0.6745 * 8 / 1e-9)


def test_unmatched_profile_slot_is_not_flagged(spark, series_of):
    out = A.global_mad(series_of([5, 6]), S.weekly_profile(series_of([5]))).orderBy("ts").collect()
    assert out[1]["z"] is None and out[1]["is_anomaly"] is False


def test_intraday_zero_mad_is_null(spark, series_of):
    assert A.intraday_mad(series_of([5, 5]), "2024-01-01", "2024-01-01").filter("z IS NOT NULL OR is_anomaly").count() == 0


def brute_noise(df):
    x = df[["value", "wd", "hour", "minute"]].to_numpy(float)
    s = x.std(axis=0)
    x = np.where(s > 0, (x - x.mean(axis=0)) / np.where(s > 0, s, 1), 0)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    knn = np.sort(d, axis=1)[:, min(5, len(x) - 1) - 1]
    eps = max(np.percentile(knn, 90), 0.3)
    near = d <= eps * (1 + 1e-9)
    core = near.sum(axis=1) >= max(3, len(x) // 20)
    return knn, eps, ~core & ~near[:, core].any(axis=1)


@pytest.mark.parametrize("step,n", [("30min", 300), ("1D", 40), ("1h", 6)])
def test_density_noise_is_exact(spark, series_of, step, n):
    rng = np.random.default_rng(n)
    df = series_of(rng.lognormal(0, 0.7, n), step=step)
    pdf = df.toPandas().sort_values("ts").reset_index(drop=True)
    pdf["wd"], pdf["hour"], pdf["minute"] = (pdf.ts.dt.dayofweek + 1) % 7, pdf.ts.dt.hour, pdf.ts.dt.minute
    knn, eps, noise = brute_noise(pdf)
    got = neighbors.density_noise(df).toPandas().sort_values("ts")
    np.testing.assert_allclose(got["eps"], eps)
    assert got["is_noise"].tolist() == noise.tolist()
    from tidemark.session import checkpointed
    dist = neighbors.knn_distance(checkpointed(neighbors.prepare(df, [])), []).toPandas().sort_values("ts")
    np.testing.assert_allclose(dist["knn"], knn)


def test_forest_flags_outliers_per_block_at_the_asked_rate(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "a" if i % 3 else "b", *map(float, rng.normal(10, 1, 2))) for i in range(3000)]
    rows += [(9000 + i, "a", 100.0, -50.0) for i in range(5)] + [(9100, "b", None, 1.0), (9200, "c", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id bigint, block string, x double, y double")
    marked = forest.clean_blocks(df, "block", ["x", "y"], 0.02, trees=50)
    stats = {r["block"]: r for r in forest.cleaning_stats(marked, ["block"]).collect()}
    assert marked.filter("id BETWEEN 9000 AND 9004 AND is_anomaly").count() == 5
    assert stats["a"]["anom_rate"] == pytest.approx(0.02, abs=0.005) and stats["b"]["n_unusable"] == 1
    assert stats["c"][1:] == (1, 0, 0, 1, 0.0)
    again = forest.clean_blocks(df.repartition(11), "block", ["x", "y"], 0.02, trees=50)
    assert {r["id"] for r in again.filter("is_anomaly").collect()} == {r["id"] for r in marked.filter("is_anomaly").collect()}
    flagged = forest.flag_file(df, ["x", "y"], 0.02, trees=50)
    assert flagged.count() == len(rows) and flagged.filter("id BETWEEN 9000 AND 9004 AND is_anomaly = 1").count() == 5


def test_metrics_by_hand(spark, series_of):
    df = series_of([2, 4, 0, None, 8]).withColumnRenamed("value", "actual").withColumn("forecast", F.lit(3.0))
    got = Cal.forecast_metrics(df).first()
    assert got["n"] == 4 and got["mae"] == 2.5
    assert got["wape_pct"] == pytest.approx(10 / 14 * 100) and got["mape_pct"] == pytest.approx((0.5 + 0.25 + 0.625) / 3 * 100)
    assert got["mase"] == pytest.approx(2.5 / np.mean([2, 4, 8])) and got["rmse"] == pytest.approx(np.sqrt((1 + 1 + 9 + 25) / 4))
    zero = Cal.forecast_metrics(series_of([0, 0]).withColumnRenamed("value", "actual").withColumn("forecast", F.lit(1.0))).first()
    assert zero["wape_pct"] is None and zero["mape_pct"] is None and zero["mase"] is None
    single = Cal.forecast_metrics(series_of([1]).withColumnRenamed("value", "actual").withColumn("forecast", F.lit(1.0))).first()
    assert single["mase"] is None and single["wape_pct"] == 0.0


def test_band_covers_its_calibration_rows(spark, series_of):
    rng = np.random.default_rng(2)
    df = series_of(rng.normal(50, 10, 300)).withColumnRenamed("value", "actual").withColumn("forecast", F.lit(50.0))
    widths = Cal.conformal_widths(df)
    for level, share in (("90", 0.9), ("95", 0.95)):
        from tidemark.functions.columns import outside_band
        out = Cal.band(df, widths, level).select(outside_band().cast("int").alias("o")).agg(F.avg("o")).first()[0]
        assert 1 - out >= share
    assert "lower" not in Cal.band(df, widths, "yok").columns and Cal.level_of("?") == "95"
    scaled = Cal.band(df.withColumn("s", F.rand(1) + 0.1), widths, "95", local_scale="s")
    assert Cal.mean_half_width(scaled).first()[0] == pytest.approx(widths.first()["width_95"])


def test_forecasters_learn_a_season(spark, series_of, tmp_path):
    df = series_of(spiky(700, at=()))
    model = Fc.fit_forecaster(df, "1h", rounds=12, depth=4, lags=24)
    out = Fc.forecast_one_step(df, model, "2024-01-25 00:00:00", "2024-01-28 00:00:00")
    assert out.count() == 73 and Cal.forecast_metrics(out).first()["wape_pct"] < 10
    model.save(str(tmp_path / "m"), spark)
    loaded = Fc.Forecaster.load(str(tmp_path / "m"), spark)
    assert loaded.widths == model.widths and loaded.trees() == model.trees()
    ahead = Fc.forecast_recursive(df, loaded, "2024-01-28 00:00:00", 8).orderBy("step").collect()
    assert [r["step"] for r in ahead] == list(range(1, 9)) and str(ahead[0]["ts"]) == "2024-01-28 01:00:00"
    same = out.filter("ts = TIMESTAMP_NTZ'2024-01-25 01:00:00'").first()["forecast"]
    first = Fc.forecast_recursive(df.filter("ts <= TIMESTAMP_NTZ'2024-01-25 00:00:00'"), model, "2024-01-25 00:00:00", 1).first()
    assert first["forecast"] == pytest.approx(same)
    assert Fc.forecast_recursive(df.limit(5), model, "2024-01-28 00:00:00", 2).count() == 0


def test_updates_warm_up_then_add_trees(spark, series_of):
    assert Fc.update_forecaster(None, series_of(range(60)), "1h", lags=24).status == "warmup"
    df = series_of(spiky(300, at=()))
    first = Fc.update_forecaster(None, df, "1h", fresh_rounds=3, depth=3, lags=24)
    second = Fc.update_forecaster(first.model, df, "1h", update_rounds=2, depth=3)
    fresh = Fc.update_forecaster(first.model, df, "1h", "train", fresh_rounds=3, depth=3)
    assert (first.status, first.trees, second.trees, second.incremental, fresh.incremental) == ("ok", 3, 5, True, False)
    assert first.n_train == int((300 - 24) * 0.9)


def test_rolling_forecast_equals_the_loop(spark, series_of):
    values = list(range(50))
    df = series_of(values).withColumn("split", F.when(F.col("value") < 30, "train").otherwise("val"))
    got = Fc.rolling_forecast(df, Fc.seasonal_ahead(7), 20, 8).orderBy("ts").collect()
    want, i = [], 30
    while i < 50:
        h = min(8, 50 - i)
        want += [values[i - 7 + s % 7] for s in range(h)]
        i += h
    assert [r["forecast"] for r in got] == want and [r["actual"] for r in got] == values[30:]


def test_search_and_registry(spark, series_of):
    df = series_of(spiky(700, at=()))
    found = Fc.time_ordered_search(df, "1h", [{"rounds": 2, "depth": 2}, {"rounds": "bad"}])
    assert found[0][0] < Fc.FAILED_SCORE and found[1][0] == Fc.FAILED_SCORE
    trips = spark.createDataFrame([], "vendorid string, tpep_pickup_datetime timestamp_ntz, fare_amount double")
    request = requests.Request("fare_amount", "1h", "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    assert requests.answer(trips, request, "chart").count() == 0
    for mode, model in (("anomaly", "lstm"), ("what", ""), ("forecast", "?")):
        with pytest.raises(requests.UnknownModel):
            requests.answer(trips, request, mode, model)


def test_standardize_uses_population_deviation(spark, series_of):
    got = [r["value"] for r in kernel.standardize(series_of([1, 2, 3]), ["value"]).orderBy("ts").collect()]
    assert got == pytest.approx([-1.224744871, 0, 1.224744871])
    assert {r["value"] for r in kernel.standardize(series_of([4, 4]), ["value"]).collect()} == {0.0}


def test_latest_forecast_counts(spark, series_of):
    actual = series_of([10, 20])
    made = spark.sql("""SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 00:00:00', 1, 8.0D), (TIMESTAMP_NTZ'2024-01-01 00:00:00', 2, 9.0D),
      (TIMESTAMP_NTZ'2024-01-01 01:00:00', 1, 22.0D) AS t(ts, made_at, forecast)""")
    assert Fc.lagged_wape(Fc.match_forecasts(actual, made)).first()[:] == (2, 0.1)
    assert Fc.latest_forecasts(made, 1).first()["forecast"] == 22.0


def test_forecasts_of_series_with_gaps_cover_the_range(spark):
    ts = [t for t in pd.date_range("2024-01-01", periods=1600, freq="1h") if t.hour not in (3, 4, 5, 6) and t.day != 17]
    rows = [(t.to_pydatetime(), float(10 + t.hour)) for t in ts]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value double")
    model = Fc.fit_forecaster(df, "1h", rounds=5, depth=3, lags=40)
    start, end = "2024-02-18 00:00:00", "2024-02-20 23:59:59"
    got = {r["ts"] for r in Fc.forecast_one_step(df, model, start, end).collect()}
    assert got == {t.to_pydatetime() for t in ts if start <= str(t) <= end}
    assert Fc.forecast_recursive(df, model, "2024-02-18 00:00:00", 3).count() == 3


def test_one_model_of_series_of_different_scale(spark):
    ts = pd.date_range("2024-01-01", periods=900, freq="1h")
    rng = np.random.default_rng(0)
    rows = [(k, t.to_pydatetime(), scale * float(10 + t.hour + rng.normal(0, 0.5))) for k, scale in (("a", 1.0), ("b", 1000.0)) for t in ts]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    model = Fc.fit_forecaster(df, "1h", rounds=15, depth=4, lags=24, keys=["k"])
    held = Fc.training_rows(df, "1h", ["k"], lags=24).filter("part = 'holdout'")
    scored = Fc.banded(model.transform(held).withColumnRenamed("value", "actual"), model, "90")
    for r in scored.groupBy("k").agg(F.avg((~F.col("outside")).cast("double")).alias("c"), F.avg("half_width").alias("w"),
                                     F.avg("actual").alias("m")).collect():
        assert r["c"] > 0.89 and r["w"] < 0.6 * r["m"]


def test_tags_without_names_come_as_rows(spark):
    scores = spark.range(1500).select(F.lit("1h").alias("resolution"), F.col("id").cast("string").alias("tag"),
                                      F.lit(1.0).alias("wape_pct"), F.lit(2.0).alias("mase"))
    assert Cal.compare_tags(scores).count() == 1500
    assert Cal.compare_tags(scores, tags=["7"]).columns == ["resolution", "7_wape_pct", "7_mase"]


def test_rounds_stop_by_patience(spark, series_of):
    assert (Fc.ROUNDS, Fc.MINUTE_ROUNDS, Fc.FRESH_ROUNDS, Fc.UPDATE_ROUNDS, Fc.ANNUAL_ROUNDS) == (500, 400, 300, 60, 400)
    assert (Fc.STEP_SIZE, Fc.TREE_DEPTH, Fc.ANNUAL_DEPTH, Fc.PATIENCE) == (0.05, 8, 5, 40)
    assert Fc.stopping_round([5, 4, 4.5, 4.6, 1], 2) == (2, True)
    assert Fc.stopping_round([5, 4, 4.5, 3, 3.5], 2) == (4, False)
    df = series_of(spiky(700, at=()))
    rows = Fc.training_rows(df, "1h", lags=24).withColumn("_id", F.xxhash64("ts"))
    features = S.feature_names("1h", 24)
    how = boosting.Boosting(200, 3, 0.3, patience=7)
    made = boosting.fit_models(rows, [], features, "value", how).first()
    assert made["trees"] + 7 == len(made["errors"]) < 200 and min(made["errors"]) == made["errors"][made["trees"] - 1]


def test_forest_scores_follow_each_tree_by_hand_and_features_are_worked_out_once(spark):
    rng = np.random.default_rng(7)
    values = np.round(rng.lognormal(0, 1, (500, 3)), 1)
    values[3, 1], values[4, 2], values[5, 0], values[6, 0] = np.inf, -np.inf, np.nan, 0.0
    trees = [forest._grow(values[10:][rng.choice(490, 64, replace=False)], 6, np.random.default_rng([1, t])) for t in range(12)]
    model = forest.Forest.stacked(list("abc"), pd.DataFrame(
        [("", t, 64, np.array(n, float).ravel().tolist()) for t, n in enumerate(trees)], columns=["group", "tree", "rows", "nodes"]))

    def length(nodes, row):
        node, at = nodes[0], 0
        while node[1] >= 0:
            at = node[3] if row[node[1]] < node[2] else node[4]
            node = nodes[at]
        return node[5]

    want = [np.nan if np.isnan(r).any() else 2 ** (-np.mean([length(n, r) for n in trees]) / forest.average_path(64)) for r in values]
    np.testing.assert_allclose(model.score(values), want, rtol=1e-12)

    def depth(nodes, at=0):
        return 0 if nodes[at][1] < 0 else 1 + max(depth(nodes, nodes[at][3]), depth(nodes, nodes[at][4]))

    assert model.depths() == [depth(n) for n in trees]

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        seen.add(1)
        return float(x)

    rows = spark.range(400).select("id", costly("id").alias("a"))
    assert forest.fit_forest(rows, ["a"], trees=4).arrays is not None
    assert seen.value == 400
