import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import quantiles as Q


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize("limit", [1_000_000, -1])
def test_matches_numpy_in_both_join_plans(spark, monkeypatch, limit):
    monkeypatch.setattr(Q, "BROADCAST_SLICES", limit)
    rng = np.random.default_rng(1)
    data = {
        "wide": rng.lognormal(0, 4, 500), "signed": rng.normal(0, 1, 401), "ties": rng.integers(0, 3, 300) * 1.0,
        "tight": 100 + rng.random(257) / 1000, "one": np.array([7.5]), "two": np.array([-1.0, 2.0]),
        "zeros": np.array([0.0, -0.0, 0.0, 5.0]), "huge": np.array([1e300, -1e300, 1e-300, -1e-300, 3.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    rows += [("wide", None), ("wide", float("nan")), ("empty", None), (None, 4.0), (None, 6.0)]
    out = {r["k"]: r for r in Q.quantiles(frame(spark, rows), ["k"], "v", {"a": 0.5, "b": 0.9, "c": 0.0, "d": 1.0}).collect()}
    for k, vs in data.items():
        got = out[k]
        assert got["n"] == len(vs)
        for name, p in (("a", 0.5), ("b", 0.9), ("c", 0.0), ("d", 1.0)):
            assert got[name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-300), (k, name)
    assert out["empty"]["n"] == 0 and out["empty"]["a"] is None
    assert out[None]["a"] == 5.0


@pytest.mark.parametrize("limit", [1_000_000, -1])
def test_wide_slices_are_cut_until_they_are_small(spark, monkeypatch, limit):
    monkeypatch.setattr(Q, "BROADCAST_SLICES", limit)
    monkeypatch.setattr(Q, "SLICE_ROWS", 5)
    monkeypatch.setattr(Q, "CELLS", 4)
    rng = np.random.default_rng(4)
    data = {"a": 1000 + rng.random(800) / 10, "b": np.repeat([3.0, 3.0001, 3.0002], [50, 400, 60]), "c": -5 - rng.random(90) / 1000}
    df = frame(spark, [(k, float(v)) for k, vs in data.items() for v in vs])
    out = {r["k"]: r for r in Q.quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.9, "c": 0.03}).collect()}
    for k, vs in data.items():
        want = [np.quantile(vs, p) for p in (0.5, 0.9, 0.03)]
        assert [out[k][x] for x in "abc"] == pytest.approx(want, rel=1e-14)
        alone = Q.scalar_quantiles(frame(spark, [(k, float(v)) for v in vs]), "v", {"a": 0.5, "b": 0.9, "c": 0.03})
        assert [alone[x] for x in "abc"] == pytest.approx(want, rel=1e-14)


def test_hot_group_and_hot_value(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.when(F.col("id") % 2 == 0, 10.0).otherwise(F.rand(3) * 20).alias("v"))
    got = {r["k"]: r["m"] for r in Q.quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == pytest.approx(want)


def test_weights_and_infinities(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (5.0, 4)], "v double, w int")
    assert Q.scalar_quantiles(df, "v", {"m": 0.5}, "w")["m"] == np.median([1, 1, 1, 2, 5, 5, 5, 5])
    inf = spark.createDataFrame([(float("inf"),), (1.0,), (float("-inf"),)], "v double")
    assert Q.scalar_quantiles(inf, "v", {"m": 0.5, "top": 1.0}) == {"n": 3, "m": 1.0, "top": math.inf}


def test_empty_and_mad(spark):
    empty = frame(spark, [])
    assert Q.scalar_quantiles(empty, "v", {"m": 0.5}) == {"n": 0, "m": None}
    assert Q.quantiles(empty, ["k"], "v", {"m": 0.5}).count() == 0
    assert Q.scalar_mad(empty, "v") == (None, None)
    assert Q.scalar_mad(frame(spark, [("a", x) for x in (1.0, 2.0, 3.0, 4.0, 100.0)]), "v") == (3.0, 1.0)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1, max_size=40),
       st.sampled_from([0.0, 0.1, 0.5, 0.95, 1.0]))
def test_any_doubles(spark, values, prob):
    got = Q.scalar_quantiles(frame(spark, [("a", v) for v in values]), "v", {"q": prob})["q"]
    ordered = sorted(values)
    place = (len(values) - 1) * prob
    low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
    want = low if low == high else low + (high - low) * (place - math.floor(place))
    assert got == want or (math.isnan(got) and math.isnan(want))


def test_slice_is_monotone(spark):
    values = [-math.inf, -1e300, -5.0, -1e-320, 0.0, 5e-324, 1e-9, 1.0, 1.0005, 2.0, 1e300, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.orderBy("v").select(Q.value_slice(F.col("v"))).collect()]
    assert got == sorted(got)
