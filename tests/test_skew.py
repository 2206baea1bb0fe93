"""A hot SKU holding most rows: grouped operators stay exact (checked against pandas)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skucast.operators import anomaly, forecast, panel
from skucast.sources.tables import demand_panel
from tests.conftest import SF001


@pytest.fixture(scope="module")
def skewed(spark):
    p = demand_panel(spark, SF001).select("sku_id", "store_id", "date", "sales")
    hot = p.where(F.col("sku_id") == "PROMO_1_001")
    # 60 extra stores of the hot SKU with shifted sales: the hot key holds most of the rows
    extra = (hot.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("copy", F.col("copy").cast("string"))
                .select("sku_id", F.concat(F.col("store_id"), F.lit("_"), F.col("copy")).alias("store_id"), "date",
                        (F.col("sales") + F.col("copy").cast("double")).alias("sales")))
    df = p.unionByName(extra).cache()
    share = df.where(F.col("sku_id") == "PROMO_1_001").count() / df.count()
    assert share > 1 / 3
    return df, df.toPandas()


def test_sku_stats_exact_under_skew(skewed):
    df, pdf = skewed
    got = {r.sku_id: r for r in panel.sku_stats(df).collect()}
    for sku, g in pdf.groupby("sku_id"):
        r = got[sku]
        assert r.sku_mean == pytest.approx(g.sales.mean()) and r.sku_std == pytest.approx(g.sales.std())
        assert r.sku_median == pytest.approx(g.sales.median()) and r.sku_max == g.sales.max()


def test_daily_series_and_forecast_under_skew(skewed):
    df, pdf = skewed
    d = panel.daily_series(df)
    want = pdf.groupby(["sku_id", "date"]).sales.sum()
    got = {(r.sku_id, r.date): r.sales for r in d.collect()}
    assert len(got) == len(want) and all(abs(got[k] - v) < 1e-6 for k, v in want.items())
    fc = forecast.baseline_forecast(panel.densify(d), "moving_average", 7)
    assert fc.count() == pdf.sku_id.nunique() * 7


def test_stat_anomaly_by_sku_under_skew(skewed):
    df, pdf = skewed
    flagged = anomaly.stat_anomaly(df, ["sku_id"]).where("sku_id = 'PROMO_1_001'").where("stat_anomaly").count()
    g = pdf[pdf.sku_id == "PROMO_1_001"].sales.to_numpy()
    z = np.abs((g - g.mean()) / (g.std() + 1e-8))
    q1, q3 = np.percentile(g, [25, 75])
    want = int(((z > 3) | (g < q1 - 3 * (q3 - q1)) | (g > q3 + 3 * (q3 - q1))).sum())
    assert flagged == want


def test_a_hot_key_of_distinct_values_spans_tasks(spark):
    """One key of over a third of the rows, nearly all values distinct: exact percentiles, and no range holds the key."""
    from skucast.functions import ranking
    n, shares = 40_000, {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q99": 0.99, "q100": 1.0}
    hot = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 40_009 / 3).alias("v"))
    rest = spark.range(n).select(F.when(F.col("id") % 9 > 0, F.concat(F.lit("k"), F.col("id") % 100)).alias("k"),
                                 F.when(F.col("id") % 5 > 0, (F.col("id") % 37).cast("double")).alias("v"))
    df = hot.unionByName(rest).unionByName(spark.createDataFrame([("null", None)], "k string, v double"))
    got = {r.k: tuple(r)[1:] for r in ranking.grouped_percentiles(df, ["k"], "v", shares).collect()}
    want = df.where("v IS NOT NULL").groupBy("k").agg(F.percentile("v", list(shares.values())).alias("q")).collect()
    assert set(got) == {r.k for r in want} and None in got and "null" not in got
    for r in want:
        assert got[r.k] == pytest.approx(r.q, rel=1e-12)
    counts = df.groupBy("k", "v").count().repartitionByRange(8, "k", "v").withColumn("pid", F.spark_partition_id())
    spread = counts.where("k = 'hot'").groupBy("pid").count().collect()
    assert len(spread) >= 6 and max(r["count"] for r in spread) < n / 3
    joined = ranking.join_by_keys(df.groupBy("k").agg(F.count("v").alias("n")), ranking.grouped_percentiles(df, ["k"], "v", {"m": 0.5}), ["k"])
    assert joined.count() == df.select("k").distinct().count() and joined.where("k IS NULL").first().m is not None
