"""Planner queries: KPIs, history, seasonality, portfolio, risk bands, insights (survey Q01-Q09, D09-D11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skucast.functions.columns import cv
from skucast.schema import EPS

# Trend thresholds (%), risk cut points on CV, and their labels.
TREND_UP, TREND_DOWN = 2.0, -2.0
RISK_CUTS = (0.3, 0.6)
RISK_LABELS = ("Low", "Medium", "High")
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def kpis(df: DataFrame, keys: Sequence[str] = ("sku_id", "store_id")) -> DataFrame:
    """Per key avg, peak, total, distinct days, CV (ddof 1) and the 7-row vs prior-7-row
    trend % with direction up (> 2) / down (< -2) / flat.

    The "last 7 / previous 7" rows come from a descending row number inside the series window
    (bounded by the series length); the rest is one grouped aggregate."""
    keys = list(keys)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    t = df.withColumn("_rn", rn).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    # previous week = tail(14).head(7): the 7 rows starting min(n, 14) rows from the end
    top = F.least(F.col("_n"), F.lit(14))
    out = t.groupBy(*keys).agg(
        F.avg("sales").alias("avg_sales"),
        F.max("sales").alias("peak_sales"),
        F.sum("sales").alias("total_sales"),
        F.count_distinct("date").alias("n_days"),
        F.stddev_samp("sales").alias("_std"),
        F.avg(F.when(F.col("_rn") <= 7, F.col("sales"))).alias("last7_avg"),
        F.avg(F.when((F.col("_rn") > top - 7) & (F.col("_rn") <= top), F.col("sales"))).alias("prev7_avg"),
    )
    trend = (F.col("last7_avg") - F.col("prev7_avg")) / (F.col("prev7_avg") + F.lit(EPS)) * 100
    return (out.withColumn("cv", cv("_std", "avg_sales"))
               .withColumn("trend_pct", trend)
               .withColumn("trend", F.when(F.col("trend_pct") > TREND_UP, "up")
                                     .when(F.col("trend_pct") < TREND_DOWN, "down").otherwise("flat"))
               .drop("_std"))


def history(df: DataFrame, k: int = 60, keys: Sequence[str] = ("sku_id", "store_id")) -> DataFrame:
    """Q02: last k rows per series with the promo flag (E21 + B15)."""
    from skucast.operators.features import tail_rows
    return tail_rows(df, k, keys).withColumn("is_promo", F.col("promo") == 1).drop("rn_desc")


def seasonality(df: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Mean sales per weekday and per month, on a fixed 7 + 12 bucket dimension; empty
    buckets get 0. The dimension is built per key from the key table (19 rows per key), so the
    right join never multiplies the data."""
    keys = list(keys)
    wd = (df.groupBy(*keys, F.weekday("date").alias("bucket_idx"))
            .agg(F.avg("sales").alias("avg_sales")).withColumn("profile", F.lit("weekday")))
    mo = (df.groupBy(*keys, (F.month("date") - 1).alias("bucket_idx"))
            .agg(F.avg("sales").alias("avg_sales")).withColumn("profile", F.lit("month")))
    stats = wd.unionByName(mo)
    names = F.array(*[F.lit(x) for x in WEEKDAYS])
    mnames = F.array(*[F.lit(x) for x in MONTHS])
    dim = (df.select(*keys).distinct()
             .withColumn("_b", F.explode(F.array(
                 *[F.struct(F.lit("weekday").alias("profile"), F.lit(i).alias("bucket_idx")) for i in range(7)],
                 *[F.struct(F.lit("month").alias("profile"), F.lit(i).alias("bucket_idx")) for i in range(12)])))
             .select(*keys, "_b.profile", "_b.bucket_idx"))
    out = dim.join(stats, keys + ["profile", "bucket_idx"], "left")
    return out.select(
        *keys, "profile", "bucket_idx",
        F.when(F.col("profile") == "weekday", F.element_at(names, F.col("bucket_idx") + 1))
         .otherwise(F.element_at(mnames, F.col("bucket_idx") + 1)).alias("bucket"),
        F.coalesce(F.col("avg_sales"), F.lit(0.0)).alias("avg_sales"))


def portfolio(df: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Per SKU Avg, Total, Std (ddof 1), CV."""
    return (df.groupBy(*keys).agg(F.avg("sales").alias("avg_sales"), F.sum("sales").alias("total_sales"),
                                  F.stddev_samp("sales").alias("std_sales"))
              .withColumn("cv", cv("std_sales", "avg_sales")))


def risk_band(c) -> "F.Column":
    """Right-closed bins (-inf, .3] Low, (.3, .6] Medium, (.6, inf) High; null stays null."""
    lo, hi = RISK_CUTS
    c = F.col(c) if isinstance(c, str) else c
    return (F.when(c.isNull(), None).when(c <= lo, RISK_LABELS[0])
             .when(c <= hi, RISK_LABELS[1]).otherwise(RISK_LABELS[2]))


def risk_bands(df: DataFrame) -> DataFrame:
    """Q05: stock-out risk band from the SKU CV."""
    return portfolio(df).withColumn("risk", risk_band("cv")).select("sku_id", "avg_sales", "std_sales", "cv", "risk")


def top_k(df: DataFrame, metric: str, k: int, asc: bool = False, tie: str = "sku_id") -> DataFrame:
    """k largest (or smallest) rows by ``metric``, ties by ``tie`` (``TakeOrderedAndProject``)."""
    return df.orderBy(F.asc(metric) if asc else F.desc(metric), tie).limit(k)


def insights(df: DataFrame, forecast: DataFrame | None = None, k: int = 2, cv_cut: float = 0.5,
             spike: float = 1.25) -> DataFrame:
    """Q06: top-k sellers by total, first k SKUs (id order) with CV > .5, k slowest by mean; with a
    forecast, a spike row when its mean exceeds 1.25 x the mean sales. Each list is a top-k
    (``TakeOrderedAndProject``) over the per-SKU table; ties are broken by sku_id."""
    s = portfolio(df)
    top = top_k(s, "total_sales", k).select(
        F.lit("high_demand").alias("rule"), "sku_id", F.col("avg_sales").alias("value"))
    risky = s.where(F.col("cv") > cv_cut).orderBy("sku_id").limit(k).select(
        F.lit("stockout_risk").alias("rule"), "sku_id", F.col("cv").alias("value"))
    slow = top_k(s, "avg_sales", k, asc=True).select(
        F.lit("slow_mover").alias("rule"), "sku_id", F.col("avg_sales").alias("value"))
    out = top.unionByName(risky).unionByName(slow)
    if forecast is not None:
        fmean = forecast.select(F.avg("yhat")).scalar()
        smean = df.select(F.avg("sales")).scalar()
        sp = (df.sparkSession.range(1)
                .select(F.lit("demand_spike").alias("rule"), F.lit(None).cast("string").alias("sku_id"),
                        ((fmean / smean - 1) * 100).alias("value"))
                .where(fmean > smean * spike))
        out = out.unionByName(sp)
    return out


def forecast_summary(fc: DataFrame) -> DataFrame:
    """Q07: per SKU average and max forecast and the model used."""
    return fc.groupBy("sku_id").agg(F.avg("yhat").alias("avg_forecast"), F.max("yhat").alias("max_forecast"),
                                    F.max_by("model_used", "h").alias("model_used"))
