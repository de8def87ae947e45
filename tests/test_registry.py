"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry_points
import check
from tallyloom.workload.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


def test_every_query_without_sql_is_known():
    without = set(QUERIES) - set(ORACLES)
    assert without == {
        "rf_predict", "rf_accuracy", "batch_score", "gen_banking", "gen_banking_summary", "gen_wide", "gen_retail_sales", "gen_key_value"
    }


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() == 12 and "txn_count" in df.columns


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    problem = check.compare(spark, con, name, sf)
    # Some of the smallest tables may hold no match at all.
    assert problem == "" or problem == "no rows"
