"""Flagship query: per-series KPIs joined with the latest feature row of every series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skucast.operators.analytics import kpis
from skucast.operators.features import build_features
from skucast.sources.tables import demand_panel

KEYS = ["sku_id", "store_id"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = demand_panel(spark, sf_dir)
    feats = build_features(panel, encode=False)
    latest = (feats.groupBy(*KEYS)
                   .agg(F.max_by(F.struct("date", "lag_1", "lag_7", "roll_mean_7", "roll_mean_28",
                                          "promo_next_7", "price_vs_mean"), "date").alias("last")))
    out = kpis(panel).join(latest, KEYS, "left")
    return out.select(*KEYS, "avg_sales", "peak_sales", "total_sales", "n_days", "cv", "trend_pct", "trend",
                      F.col("last.date").alias("last_date"), F.col("last.lag_1").alias("last_lag_1"),
                      F.col("last.lag_7").alias("last_lag_7"), F.col("last.roll_mean_7").alias("last_roll_mean_7"),
                      F.col("last.roll_mean_28").alias("last_roll_mean_28"),
                      F.col("last.promo_next_7").alias("last_promo_next_7"),
                      F.col("last.price_vs_mean").alias("last_price_vs_mean"))
