"""Every registered query against its DuckDB oracle SQL on the sf0.001 tables."""

import pytest

import __spark_entry__ as entry
from skucast.plans import catalog
from tests.conftest import SF001
from tools.oracle_check import compare, duck

catalog._ensure_all_modules()
QUERIES = dict(catalog.QUERIES)
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, name, QUERIES[name], ORACLE.get(name), SF001, con)
    if name not in ORACLE:
        assert res["rows"] > 0  # their own tests hold them against plain programs
        return
    assert res["ok"], res


# model fitting (numpy solves, whole boosted ensembles) has no SQL twin; their own tests hold them against plain programs
NO_SQL = {"K06_seasonal_ar_forecast", "K06_seasonal_ar_holdout",
          "K06_arima_forecast", "K06_arima_holdout",
          "K08_gbt_holdout_metrics", "K09_gbt_forecast", "D17_feature_importance"}


def test_every_other_query_has_oracle():
    assert set(QUERIES) - set(ORACLE) == NO_SQL


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "trend" in df.columns
