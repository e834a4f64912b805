import numpy as np
import pandas as pd
import pytest

from tidemark.functions.rolling import rolling_median


@pytest.mark.parametrize("block, most", [(1 << 14, 512), (16, 512), (7, 512), (8, 20)])
def test_rolling_medians_equal_pandas(spark, monkeypatch, block, most):
    import tidemark.functions.rolling as rolling

    monkeypatch.setattr(rolling, "MOST_BLOCKS", most)
    rng = np.random.default_rng(0)
    frames = []
    for k, n, w in (("a", 400, 150), ("b", 333, 61), ("c", 30, 20), ("d", 1, 20), ("e", 250, 5), ("f", 200, 400)):
        v = rng.normal(0, 1, n).round(1)
        v[rng.random(n) < 0.05] = np.nan
        frame = pd.DataFrame({"k": k, "_pos": np.arange(n), "_n": n, "_w": w, "v": v})
        frame["want"] = pd.Series(v).rolling(w, center=True, min_periods=1).median().to_numpy()
        frames.append(frame)
    want = pd.concat(frames)
    df = spark.createDataFrame(want.astype(object).where(want.notna(), None).values.tolist(),
                               "k string, _pos long, _n long, _w long, v double, want double")
    got = rolling_median(df, ["k"], "v", "m", block=block).toPandas()
    assert len(got) == len(want)
    pd.testing.assert_series_equal(got["m"], got["want"], check_names=False, rtol=1e-12)
