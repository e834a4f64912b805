import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[*]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def series_of(spark):
    """Hourly (or other) series from a list of values."""
    def make(values, start="2024-01-01 00:00:00", step="1h", **keys):
        import pandas as pd

        ts = pd.date_range(start, periods=len(values), freq=step)
        rows = [(*keys.values(), t.to_pydatetime(), None if v is None else float(v)) for t, v in zip(ts, values)]
        schema = "".join(f"{k} string, " for k in keys) + "ts timestamp_ntz, value double"
        return spark.createDataFrame(rows, schema)

    return make
