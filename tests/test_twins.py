"""A few queries next to their SQL twins on the smallest tables; checks.compare runs them all."""

import os

import pytest

from checks import compare
from checks.queries import QUERIES
from checks.twins import TWINS

SMALL = "/root/testdata/sf0.001"
SOME = ["trip_features", "trips_page", "activity_log", "bin_3h_median", "global_mad", "fixed_windows",
        "calendar_features", "forecast_metrics", "conformal_band", "count_windows"]


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_twin(spark, con, name):
    assert compare.compare(spark, con, SMALL, name).startswith("ok")


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)
