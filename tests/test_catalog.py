"""Every registered query with SQL must equal it at the smallest scale factor; the rest must return rows."""

import compare
import pytest

import __spark_entry__ as entry
from scoreweave import catalog

SF = "/root/testdata/sf0.001"
catalog.load()
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    diff = compare.check(duck, spark, QUERIES[name], ORACLES[name], SF)
    assert diff in ("", "no rows"), diff


@pytest.mark.parametrize("name", ["ridge_leave_one_out", "one_to_one_matching", "map_predictions", "versa", "scoring_run", "logistic_probe", "linear_classifier", "lasso", "ridge_subsampled_search"])
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1
