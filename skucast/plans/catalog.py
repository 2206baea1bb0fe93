"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator family.

Every query starts from the driver tables (the canonical panel or the events / documents
tables) and runs over them whole. Doubles are rounded at the output edge only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skucast.sources.tables import demand_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column at the output edge."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def panel(spark, sf, reuse: bool = False):
    """The canonical panel. With ``reuse`` it is materialised once to the shared checkpoint folder:
    for queries that read it several times (scalar subqueries, grouped stats joined back, rankings,
    model fitting), reading the written panel costs less than re-deriving it from the fact table
    each time, and the written copy survives executor loss. Single-pass queries stream it."""
    if not reuse:
        return demand_panel(spark, sf)
    from skucast.session import cut_lineage
    return cut_lineage(demand_panel(spark, sf))


# ================================================================= panel, B, C, D
@query("P00_panel")
def q_panel(spark, sf):
    return finish(panel(spark, sf))


@query("B01_B07_normalise")
def q_normalise(spark, sf):
    from skucast.operators.panel import (clean_target, fill_panel, normalise_keys, rename_present,
                                         split_hierarchy, with_defaults)
    raw = (demand_panel(spark, sf, with_hierarchy=False)
           .select(F.col("sku_id").alias("item_id"), "store_id", "date",
                   F.col("sales").cast("string").alias("sales"),
                   F.when(F.col("promo") == 1, 1).alias("snap_event"),
                   F.when(F.col("promo") == 0, F.col("price")).alias("sell_price")))
    df = rename_present(raw, {"item_id": "sku_id", "snap_event": "promo", "sell_price": "price", "absent": "x"})
    df = with_defaults(df, {"category": "General", "promo": 0})
    df = clean_target(df)
    df = normalise_keys(df)
    df = fill_panel(df, 2.0)
    df = split_hierarchy(df)
    return finish(df)


@query("B08_filter_panel")
def q_filter_panel(spark, sf):
    from skucast.operators.panel import filter_panel
    return finish(filter_panel(panel(spark, sf), store="ASIA", category="ECONOMY", sku="All Products"))


@query("B09_filter_or_all")
def q_filter_or_all(spark, sf):
    from skucast.operators.panel import filter_or_all
    p = panel(spark, sf)
    hit = filter_or_all(p, F.col("store_id") == "EUROPE").groupBy("store_id").agg(F.count(F.lit(1)).alias("n"))
    miss = filter_or_all(p, F.col("store_id") == "NOWHERE").groupBy("store_id").agg(F.count(F.lit(1)).alias("n"))
    return hit.withColumn("case", F.lit("hit")).unionByName(miss.withColumn("case", F.lit("miss")))


@query("B10_min_history")
def q_min_history(spark, sf):
    from skucast.operators.panel import min_history
    out = min_history(panel(spark, sf), 400, ["sku_id", "store_id"])
    return out.groupBy("sku_id", "store_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("B11_top_skus")
def q_top_skus(spark, sf):
    from skucast.operators.panel import top_skus
    out = top_skus(panel(spark, sf), 5)
    return finish(out.groupBy("sku_id").agg(F.sum("sales").alias("total_sales"), F.count(F.lit(1)).alias("n_rows")))


@query("B12_list_skus")
def q_list_skus(spark, sf):
    from skucast.operators.panel import list_skus
    return list_skus(panel(spark, sf), category="ECONOMY", store="AFRICA", limit=2)


@query("B15_promo_days")
def q_promo_days(spark, sf):
    from skucast.operators.panel import promo_days
    return finish(promo_days(panel(spark, sf)))


@query("B16_winsorise")
def q_winsorise(spark, sf):
    from skucast.operators.panel import winsorise
    return finish(winsorise(panel(spark, sf), 0.99, ["sku_id"]).select("sku_id", "store_id", "date", "sales"))


@query("B17_first_skus")
def q_first_skus(spark, sf):
    from skucast.operators.panel import first_skus
    return finish(first_skus(panel(spark, sf), 3).select("sku_id", "store_id", "date", "sales"))


@query("C06_holidays")
def q_holidays(spark, sf):
    from skucast.operators.panel import add_holidays
    out = add_holidays(panel(spark, sf, reuse=True))
    return out.groupBy("store_id", "is_holiday").agg(F.count(F.lit(1)).alias("n_rows"),
                                                     F.sum("sales").alias("sales"))


@query("C06_holiday_dim")
def q_holiday_dim(spark, sf):
    from skucast.operators.panel import holiday_dim
    return holiday_dim(panel(spark, sf))


@query("D01_daily_series")
def q_daily(spark, sf):
    from skucast.operators.panel import daily_series
    return finish(daily_series(panel(spark, sf)))


@query("D02_sku_stats")
def q_sku_stats(spark, sf):
    from skucast.operators.panel import sku_stats
    return finish(sku_stats(panel(spark, sf)))


@query("D19_metadata")
def q_metadata(spark, sf):
    from skucast.operators.panel import metadata
    return metadata(panel(spark, sf))


@query("D05_distinct_sorted")
def q_distinct(spark, sf):
    from skucast.operators.panel import distinct_sorted
    p = panel(spark, sf)
    return (distinct_sorted(p, "sku_id").select(F.lit("sku_id").alias("kind"), F.col("sku_id").alias("value"))
            .unionByName(distinct_sorted(p, "store_id").select(F.lit("store_id").alias("kind"),
                                                               F.col("store_id").alias("value")))
            .unionByName(distinct_sorted(p, "category").select(F.lit("category").alias("kind"),
                                                               F.col("category").alias("value"))))


@query("K01_densify")
def q_densify(spark, sf):
    from skucast.operators.panel import densify
    out = densify(panel(spark, sf).select("sku_id", "store_id", "date", "sales"), ["sku_id", "store_id"])
    return finish(out)


# ================================================================= E: features
@query("E01_E03_date_features")
def q_date_features(spark, sf):
    from skucast.operators.features import date_features
    return finish(date_features(panel(spark, sf, reuse=True)).drop("category", "dept_id"))


@query("E04_E07_lags_rolling")
def q_lags_rolling(spark, sf):
    from skucast.operators.features import lags, rolling
    p = panel(spark, sf).select("sku_id", "store_id", "date", "sales")
    return finish(rolling(lags(p)))


@query("E08_E11_promo_price")
def q_promo_price(spark, sf):
    from skucast.operators.features import promo_features
    return finish(promo_features(panel(spark, sf).select("sku_id", "store_id", "date", "promo", "price")))


@query("E12_encode_ids")
def q_encode(spark, sf):
    from skucast.operators.features import encode_ids
    p = panel(spark, sf, reuse=True).select("sku_id", "store_id", "date")
    return encode_ids(p)


@query("E13_E14_log_time_idx")
def q_log_idx(spark, sf):
    from skucast.operators.features import log_target, time_idx
    return finish(time_idx(log_target(panel(spark, sf).select("sku_id", "store_id", "date", "sales"))))


@query("E15_group_stats")
def q_group_stats(spark, sf):
    from skucast.operators.features import group_stats
    return finish(group_stats(panel(spark, sf).select("sku_id", "store_id", "date", "sales")))


@query("E16_zscore")
def q_zscore(spark, sf):
    from skucast.operators.features import zscore_by
    return finish(zscore_by(panel(spark, sf).select("sku_id", "store_id", "date", "price"), "price"))


@query("E17_build_features")
def q_build_features(spark, sf):
    from skucast.operators.features import build_features
    return finish(build_features(panel(spark, sf, reuse=True)).drop("category", "dept_id"))


@query("E20_diffs")
def q_diffs(spark, sf):
    from skucast.operators.features import diffs
    return finish(diffs(panel(spark, sf).select("sku_id", "store_id", "date", "sales")))


@query("E21_tail_rows")
def q_tail(spark, sf):
    from skucast.operators.features import tail_rows
    return finish(tail_rows(panel(spark, sf).select("sku_id", "store_id", "date", "sales"), 7))


@query("E22_split_last")
def q_split_last(spark, sf):
    from skucast.operators.features import split_last
    out = split_last(panel(spark, sf).select("sku_id", "store_id", "date", "sales"), 28)
    return out.groupBy("sku_id", "store_id", "is_test").agg(F.count(F.lit(1)).alias("n_rows"),
                                                            F.min("date").alias("first_date"))


@query("E23_split_fraction")
def q_split_fraction(spark, sf):
    from skucast.operators.features import split_fraction
    p = panel(spark, sf, reuse=True).select("sku_id", "store_id", "date", "sales")
    g = split_fraction(p, 0.8).groupBy("is_train").agg(F.count(F.lit(1)).alias("n_rows"),
                                                       F.max("date").alias("last_date"))
    k = split_fraction(p, 0.8, ["sku_id", "store_id"]).groupBy("is_train").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("date").alias("last_date"))
    return g.withColumn("variant", F.lit("global")).unionByName(k.withColumn("variant", F.lit("per_series")))


@query("E24_split_cutoff")
def q_split_cutoff(spark, sf):
    from skucast.operators.features import split_cutoff, time_idx
    out = split_cutoff(time_idx(panel(spark, sf, reuse=True).select("sku_id", "store_id", "date", "sales")), 14)
    return out.groupBy("sku_id", "store_id", "is_train").agg(F.count(F.lit(1)).alias("n_rows"))


def _ensure_all_modules():
    """Import modules that register further queries."""
    from skucast.plans import catalog_analytics, catalog_models, catalog_sources, catalog_wide  # noqa: F401
    from skucast.plans import oracle
    oracle._load_all()


@query("C01_C02_calendar_price_joins")
def q_calendar_price(spark, sf):
    """C01 + C02 on tables derived from the panel: a calendar (one row per day: ISO week code
    ``year * 100 + week`` and any-promo flag) and a weekly price table (store, SKU, week -> mean
    daily price), joined back onto the daily panel with the calendar promo and weekly price."""
    from skucast.operators.panel import join_calendar, join_prices
    p = panel(spark, sf, reuse=True)
    wk = (F.year("date") * 100 + F.weekofyear("date")).alias("wm_yr_wk")
    cal = p.groupBy("date").agg(F.max("promo").alias("promo")).select("date", wk, "promo")
    prices = (p.select("store_id", F.col("sku_id").alias("item_id"), wk, "price")
               .groupBy("store_id", "item_id", "wm_yr_wk").agg(F.avg("price").alias("sell_price")))
    base = p.select("sku_id", "store_id", "date", "sales")
    out = join_prices(join_calendar(base, cal), cal, prices, 2.0)
    # a mean of <= 7 six-decimal prices is exact at 7-8 decimals: round at 9 so no value sits on a tie
    return finish(out.select("sku_id", "store_id", "date", "sales", "promo", "wm_yr_wk", "price"), 9)
