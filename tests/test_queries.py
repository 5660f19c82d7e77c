"""Every query against its SQL; the ordered ones once more with tiny slices."""

import pytest

from suite.compare import connect, difference
from suite.oracle import ORACLE
from suite.queries import QUERIES, Given

SLICED = [
    "classify_status", "sustained_violation", "engineer_features", "deviation_trend", "ffill",
    "chronological_split", "status_episodes", "latest_24_stats", "first_n_per_pump",
    "debounce_anomalies", "debounce_documented", "dq_monotonic", "flow_from_current",
    "baseline_from_curve_test", "rolling_long", "rolling_time", "edge_run", "incremental_status",
]


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, folder, con, name):
    assert difference(QUERIES[name](Given(spark, folder)), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", SLICED)
def test_sliced_machines_give_the_same(spark, folder, con, name):
    """No machine may have more than 100 rows, so all are cut into slices."""
    given = Given(spark, folder, max_rows=100)
    assert difference(QUERIES[name](given), con, ORACLE[name]) == ""


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
