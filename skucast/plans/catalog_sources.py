"""Registered queries of the file sources and sinks (A, B06, B14, E18, F02, F07, Q08-Q11).

Each writes files derived from the tables below the checkpoint folder, in the layout of its source, and reads
them back through the library's reader."""

from __future__ import annotations

from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skucast.plans.catalog import finish, panel, query
from skucast.schema import M5_ORIGIN
from skucast.session import ensure_checkpoint_dir

KEYS = ["sku_id", "store_id"]


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid4().hex}"


def write_m5(spark: SparkSession, p: DataFrame, path: str) -> None:
    """The panel as a wide matrix, calendar and weekly prices: one column a day of the data, one row a series."""
    first, last = p.agg(F.min("date"), F.max("date")).first()
    n = (last - first).days + 1 if first else 0
    t = p.select(*KEYS, F.datediff("date", F.lit(first)).alias("i"), F.col("sales").cast("int").alias("s"), "price")
    days = t.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("i", "s"))).alias("m"))  # a day a series
    rows = days.select("*", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("a"))
    rows.select(F.concat_ws("_", *KEYS).alias("id"), F.col("sku_id").alias("item_id"), "store_id",
                *[F.col("a")[i].alias(f"d_{i + 1}") for i in range(n)]).write.option("header", True).csv(f"{path}/sales_train_evaluation.csv")
    day = spark.range(n).select(F.date_add(F.lit(M5_ORIGIN).cast("date"), F.col("id").cast("int")).alias("date"),
                                (11101 + F.floor(F.col("id") / 7)).alias("wm_yr_wk"), (F.col("id") % 5 == 0).cast("int").alias("snap_CA"),
                                (F.col("id") % 7 == 0).cast("int").alias("snap_TX"))
    day.write.option("header", True).csv(f"{path}/calendar.csv")
    week = t.groupBy("store_id", F.col("sku_id").alias("item_id"), (11101 + F.floor(F.col("i") / 7)).alias("wm_yr_wk")).agg(
        F.max("price").alias("sell_price"))
    week.write.option("header", True).csv(f"{path}/sell_prices.csv")


@query("A01_A06_load_m5")
def q_load_m5(spark, sf):
    from skucast.sources.readers import load_panel
    path = folder(spark, "m5")
    write_m5(spark, panel(spark, sf), path)
    return finish(load_panel(spark, "M5", path, days=365))


@query("A01_A04_wide_days")
def q_wide_days(spark, sf):
    """The same matrix through the byte-range source: the days of one store, by dates."""
    from skucast.sources.readers import day_to_date
    from skucast.sources.wide_days import read_wide_days
    path = folder(spark, "m5")
    write_m5(spark, panel(spark, sf), path)
    long = read_wide_days(spark, f"{path}/sales_train_evaluation.csv", range_bytes=1 << 16)
    by = long.groupBy("store_id", day_to_date("d").alias("date")).agg(F.sum("sales").alias("sales"), F.count_if(F.col("sales") > 0).alias("n_sold"))
    asia = read_wide_days(spark, f"{path}/sales_train_evaluation.csv", days=30).where("store_id = 'ASIA'")
    return by.join(asia.agg(F.sum("sales").alias("asia_30_days")))


@query("A07_m5_sample")
def q_m5_sample(spark, sf):
    from skucast.sources.readers import load_m5
    path = folder(spark, "m5")
    p = panel(spark, sf)
    p.select("date", "store_id", F.col("sku_id").alias("item_id"), (F.col("sales") - 20).alias("sales"),
             F.when(F.col("promo") == 1, 1).alias("snap_event"), F.when(F.col("promo") == 0, F.col("price")).alias("sell_price")
             ).write.option("header", True).csv(f"{path}/m5_sample.csv")
    return finish(load_m5(spark, path))


def _favorita(spark, sf) -> DataFrame:
    from skucast.sources.readers import load_panel
    path = folder(spark, "favorita")
    parts = F.split("sku_id", "_")
    panel(spark, sf).select(
        "date", F.length("store_id").alias("store_nbr"), (F.length(parts[0]) * 100 + parts[1].cast("int")).alias("item_nbr"),
        (F.col("sales") - 30).alias("unit_sales"), F.when(F.col("promo") == 1, "True").otherwise("False").alias("onpromotion"),
        F.col("category").alias("family")).write.option("header", True).csv(f"{path}/train.csv")
    return load_panel(spark, "Favorita", path)


@query("A08_A09_B06_favorita")
def q_favorita(spark, sf):
    return finish(_favorita(spark, sf).groupBy("sku_id", "store_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sales").alias("sales"), F.sum("promo").alias("promo"), F.max("price").alias("price")))


@query("A10_A11_mapped")
def q_mapped(spark, sf):
    from skucast.sources.readers import load_panel
    path = folder(spark, "uci")
    panel(spark, sf).select("date", "sku_id", F.col("sales").alias("quantity"), F.col("price").alias("unit_price")).write.option(
        "header", True).csv(f"{path}/uci_sample.csv")
    out = load_panel(spark, "UCI", path)
    return finish(out.groupBy("sku_id", "store_id", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("sales").alias("sales"),
                                                                    F.max("price").alias("price"), F.max("promo").alias("promo")))


@query("A12_A14_cache")
def q_cache(spark, sf):
    from skucast.sources.readers import cache_panel, drop_cache, read_cached
    root = folder(spark, "cache")
    for days in (365, 30):
        cache_panel(panel(spark, sf), root, "M5", days)
    dropped = len(drop_cache(spark, root, "favorita"))
    kept = read_cached(spark, root, "m5", 365, ["sku_id", "store_id", "date"])
    return kept.groupBy("store_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sku_id").alias("n_skus"),
                                        F.max("date").alias("last_date")).withColumn("dropped", F.lit(dropped))


@query("A15_A16_Q10_Q11_reports")
def q_reports(spark, sf):
    from skucast.operators.metrics import evaluate
    from skucast.sources.readers import read_reports, report
    from skucast.sources.sinks import write_report
    root, p = folder(spark, "reports"), panel(spark, sf, reuse=True)
    guesses = {"PRICE": F.col("price"), "LESS": F.col("sales") * 0.9}
    for name, guess in guesses.items():
        write_report(evaluate(p.withColumn("p", guess), "sales", "p"), root, "M5", name)
    write_report(evaluate(p.withColumn("p", F.lit(0.0)), "sales", "p"), root, "M5", "LESS_STILL")
    one = report(spark, root, "m5", "less").select("WMAPE").first()[0]
    out = read_reports(spark, root, "M5").where(F.col("model") != "LESS_STILL")
    return finish(out.select("dataset", "model", "MAE", "RMSE", "n_obs", "headline_WMAPE").withColumn("less_WMAPE", F.lit(one)))


@query("A17_A18_registry")
def q_registry(spark, sf):
    from skucast.sources.sinks import best_artifact, write_registry, write_run_log
    root, p = folder(spark, "registry"), panel(spark, sf)
    write_run_log(p.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows")), f"{root}/log")
    entries = p.groupBy("sku_id").agg(F.avg("sales").alias("WMAPE"), F.count(F.lit(1)).alias("n_obs")).select(
        F.lit("M5").alias("dataset"), F.concat(F.lit("model of "), "sku_id").alias("model"), "sku_id", "WMAPE", "n_obs",
        F.concat(F.lit("at "), "sku_id").alias("artifact"))
    write_registry(entries, f"{root}/registry")
    back = spark.read.parquet(f"{root}/registry")
    logged = spark.read.parquet(f"{root}/log").where("logged_at IS NOT NULL").agg(F.sum("n_rows").alias("logged_rows"))
    return finish(back.select("dataset", "model", "sku_id", "WMAPE", "n_obs").join(logged).withColumn(
        "best", F.lit(best_artifact(f"{root}/registry", "M5"))))


@query("A19_forecast_table")
def q_forecast_table(spark, sf):
    from skucast.operators.forecast import MODELS, baseline_forecasts
    from skucast.plans.catalog_models import H, daily_dense
    from skucast.sources.sinks import write_forecast
    path, fc = folder(spark, "forecast"), baseline_forecasts(daily_dense(spark, sf), MODELS, H, gap_free=True)
    write_forecast(fc, path, "OTHER")
    write_forecast(fc, path, "M5")
    back = spark.read.parquet(path).where("dataset = 'M5'")
    return finish(back.select("sku_id", "date", "h", "yhat", "lo", "hi", F.col("model_used").cast("string").alias("model_used")))


@query("B14_E18_feature_matrix")
def q_feature_matrix(spark, sf):
    """The catalogue's columns that a lagged panel has, without nulls: their number, and sums by SKU."""
    from skucast.operators.features import lags
    from skucast.operators.gbt import feature_catalogue
    from skucast.operators.panel import select_features
    t = lags(panel(spark, sf).select(*KEYS, "date", "sales", "promo", "price"))
    names = feature_catalogue(external=["web_trend"])
    m = select_features(t, names, keep=["sku_id"])
    return finish(m.groupBy("sku_id").agg(*[F.round(F.sum(c), 4).alias(c) for c in m.columns[1:]], F.count(F.lit(1)).alias("n")).withColumns(
        {"n_columns": F.lit(len(m.columns) - 1), "n_catalogue": F.lit(len(names))}))


@query("F02_sort_panel")
def q_sort_panel(spark, sf):
    """The whole panel in order: rows, and how many come before their predecessor (within and across partitions)."""
    from skucast.operators.panel import sort_panel
    ordered = sort_panel(panel(spark, sf).select(*KEYS, "date")).select(F.struct(*KEYS, "date").alias("k"), F.spark_partition_id().alias("pid"))

    def scan(batches):
        n = wrong = 0
        first = last = pid = None
        for b in batches:
            for k, pid in zip(b["k"].to_dict("records") if isinstance(b["k"], pd.DataFrame) else b["k"], b["pid"]):
                k = (k["sku_id"], k["store_id"], str(k["date"]))
                wrong += last is not None and k < last
                first, last, n = first or k, k, n + 1
        if n:
            yield pd.DataFrame({"pid": [int(pid)], "n": [n], "wrong": [wrong], "first": ["|".join(first)], "last": ["|".join(last)]})

    parts = ordered.mapInPandas(scan, "pid int, n long, wrong long, first string, last string")
    across = F.lag("last").over(Window.orderBy("pid")) > F.col("first")  # one row a partition
    return parts.select("n", (F.col("wrong") + F.coalesce(across.cast("int"), F.lit(0))).alias("w")).agg(
        F.sum("n").alias("n_rows"), F.sum("w").alias("out_of_order"))


@query("F07_union_all")
def q_union_all(spark, sf):
    from skucast.operators.panel import union_all
    p = panel(spark, sf).select(*KEYS, "sales", "promo")
    both = union_all(p.where("promo = 1"), p.select("promo", "sales", "store_id", "sku_id").where("promo = 0"), p.where("sales > 60"))
    return finish(both.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("sales").alias("sales")))


@query("Q08_datasets")
def q_datasets(spark, sf):
    from skucast.operators.panel import datasets_overview
    return datasets_overview({"M5": panel(spark, sf), "FAVORITA": _favorita(spark, sf)})


@query("Q09_sku_page")
def q_sku_page(spark, sf):
    """The request's category, store and limit."""
    from skucast.operators.panel import sku_page
    return sku_page(panel(spark, sf), "PROMO", "ASIA", 2)
