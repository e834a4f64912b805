"""Boosting of many models: against brute force, in one block and in several, and in a race."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as B
from tidemark.operators import forecast as Fc

WAY = B.Boosting(12, 3, 0.3, 5, 0.7, 16, 6)
COLUMNS = ["a", "b", "c"]


def sample(n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    x[:, 2] = rng.integers(0, 4, n)
    return x, np.where(x[:, 0] > 0.3, 5.0, 1.0) + x[:, 2] + rng.normal(0, 0.3, n)


def frame(spark, sizes, holdout=0.25):
    parts = []
    for k, n in sizes.items():
        x, y = sample(n, len(k))
        part = pd.DataFrame(x, columns=COLUMNS).assign(y=y, k=k, _id=np.arange(n) * 7919 + len(k))
        parts.append(part.assign(part=np.where(np.arange(n) < n * (1 - holdout), "train", "holdout")))
    return spark.createDataFrame(pd.concat(parts)).repartition(5)


def slow_split(bins, value, min_leaf):
    best = (1e-6, -1, 0)
    for f in range(bins.shape[1]):
        for b in range(int(bins[:, f].max()) + 1):
            low = bins[:, f] <= b
            if min(low.sum(), (~low).sum()) >= min_leaf:
                gain = value[low].sum() ** 2 / low.sum() + value[~low].sum() ** 2 / (~low).sum() - value.sum() ** 2 / len(value)
                best = max(best, (gain, -f, -b)) if gain > best[0] else best
    return (-best[1], -best[2]) if best[1] <= 0 and best[0] > 1e-6 else (-1, 0)


@pytest.mark.parametrize("seed", range(6))
def test_splits_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    bins, value = rng.integers(0, 7, (90, 4)).astype(np.uint8), rng.integers(-9, 10, 90).astype(float)
    f, b, n, s = (x[0] for x in B.splits(*B.histograms(bins, value, np.zeros(90, int), 1, 7), 5))
    assert (f, b) == slow_split(bins, value, 5)
    low = bins[:, f] <= b
    assert (n, s) == (low.sum(), value[low].sum())


def walked(e, row):
    total = e.base
    for node in e.roots:
        while e.cut[node] < np.inf:
            node = e.left[node] + (row[e.feature[node]] > e.cut[node])
        total += e.value[node]
    return total


def test_predictions_follow_the_nodes_and_trees_add_up():
    x, y = sample(300, 1)
    cuts = [np.unique(np.quantile(x[:, i], np.arange(1, 16) / 16, method="lower")) for i in range(3)]
    train, ids = np.arange(300) < 240, np.arange(300)
    e, errors = B.grown(B.binned(x, cuts), y, train, ids, float(y.mean()), 1e-6, cuts, WAY)
    got = e.predict(x)
    assert got == pytest.approx([walked(e, r) for r in x])
    assert np.mean((got - y)[~train] ** 2) == pytest.approx(min(errors))
    assert e.plus(e).predict(x) == pytest.approx(2 * got) and len(e.first(3).roots) == 3
    assert B.Ensemble.of_row(e.as_row()).predict(x).tolist() == got.tolist()
    assert B.Ensemble(2.0).predict(x).tolist() == [2.0] * 300 and not len(e.predict(x[:0]))
    odd = np.array([[np.nan, np.inf, -np.inf], [1e300, -1e300, 0.0]])
    assert np.isfinite(e.predict(odd)).all()


def test_models_of_many_blocks_equal_those_of_one(spark, monkeypatch):
    rows = frame(spark, {"x": 400, "yy": 700, "zzz": 90})
    ways = {("x",): WAY, ("yy",): B.Boosting(7, 2, 0.5, 9, 1.0, 16, 50), ("zzz",): WAY}
    one = {r["k"]: r for r in B.fit_models(rows, ["k"], COLUMNS, "y", ways).collect()}
    assert B.packed(rows, ["k"], COLUMNS, "y", WAY).count() == 3
    monkeypatch.setattr(B, "BLOCK_ROWS", 150)
    assert B.packed(rows, ["k"], COLUMNS, "y", WAY).count() > 6
    many = {r["k"]: r for r in B.fit_models(rows, ["k"], COLUMNS, "y", ways).collect()}
    assert set(one) == set(many) == {"x", "yy", "zzz"}
    for k, a in one.items():
        b = many[k]
        for c in ("base", "roots", "feature", "cut", "left", "value", "n_train", "n_holdout", "trees"):
            assert a[c] == b[c], (k, c)
        assert b["errors"] == pytest.approx(a["errors"])
        assert 0 < a["trees"] <= ways[k,].rounds and a["errors"][-1] < a["errors"][0]


def test_odd_rows(spark):
    schema = "k string, part string, _id long, a double, y double"
    rows = [("only holdout", "holdout", 1, 1.0, 1.0), ("constant", "train", 1, 1.0, 4.0), ("constant", "train", 2, 2.0, 4.0),
            (None, "train", 3, None, 1.0), (None, "train", 3, 2.0, 3.0), ("no label", "train", 5, 1.0, None)]
    made = {r["k"]: r for r in B.fit_models(spark.createDataFrame(rows, schema), ["k"], ["a"], "y", WAY).collect()}
    assert set(made) == {"constant", None} and made["constant"]["base"] == 4.0 and made[None]["base"] == 2.0
    none = spark.createDataFrame([], schema)
    assert B.fit_models(none, ["k"], ["a"], "y", WAY).count() == 0 and B.fit_models(none, [], ["a"], "y", WAY).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_race_finds_the_winner_of_the_whole_grid(spark, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(900)
    values = 20 + 8 * np.sin(t * 2 * np.pi / 24) + 3 * (t % 168 < 24) + rng.normal(0, 1, len(t))
    series = spark.createDataFrame(pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=900, freq="1h"), "value": values})).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    grid = [{"rounds": 100, "depth": 3, "min_leaf": m, "step": s} for m in (20, 90, 180) for s in (0.005, 0.02, 0.1)]
    rows = Fc.training_rows(series, "1h", lags=24)
    rows = Fc.checkpointed(rows.withColumn("_id", F.xxhash64("ts")))
    features = Fc.S.feature_names("1h", 24)

    def trials():
        return [Fc.Trial(i, g, Fc.checked_setting(g)) for i, g in enumerate(grid)]

    raced = Fc.race(rows, features, trials(), 13)
    whole = Fc.race(rows, features, trials(), 100)
    best = min(whole, key=lambda x: min(x.errors))
    won = min(raced, key=lambda x: min(x.errors))
    assert won.place == best.place
    assert sum(x.levels for x in raced) < sum(x.levels for x in whole) / 2
    found = Fc.time_ordered_search(series, "1h", [*grid, {"depth": 0}, {"speed": 1}], 24, 13)
    assert len(found) == 11 and found[0][0] < Fc.FAILED_SCORE and [f[0] for f in found[-2:]] == [Fc.FAILED_SCORE] * 2
