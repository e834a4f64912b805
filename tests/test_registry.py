import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast as Fc
from tidemark.operators import registry
from tidemark.plans import requests
from tidemark.session import checkpointed

START, END = "2024-02-01 00:00:00", "2024-02-04 23:59:59"


@pytest.fixture(scope="module")
def series(spark):
    rng, out = np.random.default_rng(3), None
    for metric, resolution, vendor, level, step in (
            ("a", "1h", "all", 10, 3600), ("a", "1h", "1", 500, 3600), ("b", "30m", "all", 40, 1800), ("short", "1h", "all", 5, 3600)):
        n = 300 if metric == "short" else 40 * 86400 // step
        values = level * (2 + np.sin(np.arange(n) * step / 86400 * 2 * np.pi)) + rng.normal(0, level / 20, n)
        ids = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, value double")
        at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("i") * step).cast("decimal(18,6)"))
        rows = ids.select(F.lit(metric).alias("metric"), F.lit(resolution).alias("resolution"), F.lit(vendor).alias("vendor"),
                          at.alias("ts"), "value")
        out = rows if out is None else out.unionByName(rows)
    return checkpointed(out)


@pytest.fixture(scope="module")
def models(spark, series):
    early = series.filter(F.col("ts") < F.lit(START).cast("timestamp_ntz"))
    return registry.train_models(early, ["1h", "30m"], depth=3, rounds=40)


def sorted_rows(df):
    return sorted(tuple(r) for r in df.select("metric", "resolution", "vendor", "ts", "actual", "forecast", "lower", "upper", "outside").collect())


def test_series_long_enough_have_a_model(models):
    found = {(r["metric"], r["resolution"], r["vendor"]): r for r in models.collect()}
    assert set(found) == {("a", "1h", "all"), ("a", "1h", "1"), ("b", "30m", "all")}
    for r in found.values():
        assert 0 < r["trees"] <= 40 and len(r["roots"]) == r["trees"] and 0 < r["width_90"] <= r["width_95"]


def test_scores_are_those_of_each_model_alone(spark, series, models, monkeypatch):
    whole = sorted_rows(registry.score_registered(series, models, START, END))
    monkeypatch.setattr(registry, "SCORE_ROWS", 17)
    assert sorted_rows(registry.score_registered(series, models, START, END)) == whole
    alone = []
    for metric, resolution, vendor in {r[:3] for r in whole}:
        model = registry.forecaster(models, metric, resolution, vendor)
        own = series.filter((F.col("metric") == metric) & (F.col("resolution") == resolution) & (F.col("vendor") == vendor))
        made = Fc.forecast_one_step(own.select("ts", "value"), model, START, END)
        alone += [(metric, resolution, vendor, r["ts"], r["actual"], r["forecast"], r["lower"], r["upper"], r["outside"])
                  for r in made.collect()]
    assert len(alone) == len(whole) == 24 * 4 * 2 + 48 * 4
    for got, want in zip(whole, sorted(alone)):
        assert got[:4] == want[:4] and got[8] == want[8]
        assert np.allclose(got[4:8], want[4:8])


def test_versions(spark, models, tmp_path):
    path = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        registry.registered(spark, path)
    assert registry.promote(models, path) == 1
    changed = models.filter("metric = 'b'").withColumn("width_95", F.lit(99.0))
    # what a promoter that died leaves behind is not read
    changed.withColumn("width_95", F.lit(-1.0)).write.parquet(f"{path}/_staged-dead")
    assert registry.promote(changed, path) == 2
    now = {(r["metric"], r["vendor"]): (r["version"], r["width_95"]) for r in registry.registered(spark, path).collect()}
    assert now["b", "all"] == (2, 99.0) and now["a", "all"][0] == now["a", "1"][0] == 1 and len(now) == 3
    assert {r["version"] for r in registry.registered(spark, path, 1).collect()} == {1}
    assert registry.versions(spark, path) == [1, 2]


def test_of_two_promoters_the_later_gets_the_next_number(spark, models, tmp_path, monkeypatch):
    path = str(tmp_path / "models")
    registry.promote(models, path)
    real, answers = registry.versions, iter([[], [1], [1]])
    monkeypatch.setattr(registry, "versions", lambda *a: next(answers, None) or real(*a))
    real_first = [registry.promote(models, path)]
    assert real_first == [2] and real(spark, path) == [1, 2]


def test_a_request_joins_its_model_and_trains_nothing(spark, series, models, monkeypatch):
    def no(*a, **k):
        raise AssertionError("trained")

    monkeypatch.setattr(Fc, "fit_forecaster", no)
    trips = series.filter("metric = 'a' and vendor = 'all'").select(
        F.col("ts").alias("tpep_pickup_datetime"), F.lit("1").alias("vendorid"), F.col("value").alias("total_amount"))
    named = models.filter("metric = 'a' and vendor = 'all'").withColumn("metric", F.lit("total_amount"))
    request = requests.Request("total_amount", "1h", START, END, options={"models": named})
    got = requests.answer(trips, request, "forecast", "xgboost").orderBy("ts").collect()
    assert len(got) == 96
    every = requests.forecast_all(trips, named, START, END).orderBy("ts").collect()
    assert np.allclose([r["forecast"] for r in got], [r["forecast"] for r in every])
    with pytest.raises(requests.UnknownModel):
        requests.answer(trips, requests.Request("tip_amount", "1h", START, END, options={"models": named}), "forecast", "xgboost")
