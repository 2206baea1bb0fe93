"""Physical-plan checks: shuffles, broadcasts, pushdown, no Python in the hot path."""

import re

import pytest

from skucast.operators import features, panel
from skucast.sources.tables import demand_panel
from tests.conftest import SF001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def p(spark):
    spark.catalog.clearCache()  # plans must show the real scans, not a cached relation
    return demand_panel(spark, SF001)


def test_panel_single_shuffle_and_broadcast_dims(p):
    s = plan(p)
    assert s.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in s and s.count("BroadcastHashJoin") == 4


def test_series_windows_share_one_exchange(p):
    df = features.promo_features(features.rolling(features.lags(p)))
    s = plan(df)
    # one exchange on the series key for all lags, rolling stats and promo/price windows
    assert len(re.findall(r"Exchange hashpartitioning\(sku_id#\d+, store_id#\d+, \d+\)", s)) == 1
    assert "PythonUDF" not in s and "ArrowEvalPython" not in s


def test_feature_pipeline_stays_in_jvm(p):
    s = plan(features.build_features(p, encode=False))
    assert "BatchEvalPython" not in s and "ArrowEvalPython" not in s


def test_filters_and_pruning_reach_parquet(spark, p, tmp_path):
    from skucast.sources.readers import cache_panel, read_cached
    cache_panel(p, str(tmp_path), "TEST")
    df = panel.filter_panel(read_cached(spark, str(tmp_path), "TEST", columns=["sku_id", "store_id", "date", "sales"]),
                            store="ASIA", category=None, sku="ECONOMY_1_001")
    s = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(sku_id), EqualTo(sku_id,ECONOMY_1_001)]" in s
    assert "PartitionFilters: [isnotnull(store_id" in s
    assert "ReadSchema: struct<sku_id:string,date:date,sales:double>" in s


def test_densify_and_baselines_need_no_join(p):
    from skucast.operators import forecast
    d = panel.densify(panel.daily_series(p), ["sku_id"])
    s = plan(forecast.baseline_forecasts(d, forecast.MODELS, 14))
    # only the panel's four dimension broadcasts: densify, summary and the five models add no join
    assert "SortMergeJoin" not in s and "ShuffledHashJoin" not in s and "Union" not in s
    assert s.count("BroadcastHashJoin") == 4
    dense = plan(panel.densify(p.select("sku_id", "store_id", "date", "sales"), ["sku_id", "store_id"]))
    assert dense.count("BroadcastHashJoin") == 4 and "SortMergeJoin" not in dense


def test_anomalies_with_forest_single_grouped_map(p):
    from skucast.operators import anomaly
    s = plan(anomaly.detect_anomalies(p.select("sku_id", "store_id", "date", "sales"), with_forest=True))
    assert s.count("FlatMapGroupsInPandas") == 1 and "Join" not in s.split("FlatMapGroupsInPandas")[0]
