"""File readers for retail sales sources (survey A01-A14, A16).

All readers declare their schema (no inference over the data): CSV headers are read first to
learn the column names, then the file is scanned with an explicit ``StructType`` so splits are
parallel and types are stable. Wide day matrices are melted with ``unpivot`` after the day
columns are pruned, so the melt never materialises more columns than requested.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skucast.operators.panel import (clean_target, favorita_category, fill_panel, normalise_keys, rename_present,
                                     with_defaults)
from skucast.schema import DEFAULTS, FAVORITA_PRICE_DEFAULT, M5_ORIGIN, M5_PRICE_DEFAULT, MAPPINGS

M5_ID_COLS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
# File names of the supported datasets.
M5_SALES_FILES = ["sales_train_evaluation.csv", "sales_train_validation.csv"]
M5_CALENDAR, M5_PRICES, M5_SAMPLE = "calendar.csv", "sell_prices.csv", "m5_sample.csv"
FAVORITA_TRAIN, FAVORITA_SAMPLE = "train.csv", "favorita_sample.csv"


# ---------------------------------------------------------------- file system helpers
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True)) if fs.exists(p) else False


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line (reads one line, not the file)."""
    first = spark.read.text(path).limit(1).first()
    return [c.strip() for c in first[0].split(",")] if first else []


def read_csv(spark: SparkSession, path: str, types: dict | None = None, default=T.StringType()) -> DataFrame:
    """CSV with header and a declared schema built from the header and ``types`` (name -> type)."""
    cols = csv_header(spark, path)
    types = types or {}
    schema = T.StructType([T.StructField(c, types.get(c, default), True) for c in cols])
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


# ---------------------------------------------------------------- M5
def read_m5_wide(spark: SparkSession, data_dir: str) -> DataFrame:
    """Wide sales matrix, ``sales_train_evaluation.csv`` preferred, ``_validation`` as fallback."""
    for name in M5_SALES_FILES:
        path = f"{data_dir.rstrip('/')}/{name}"
        if path_exists(spark, path):
            cols = csv_header(spark, path)
            types = {c: T.IntegerType() for c in cols if re.fullmatch(r"d_\d+", c)}
            return read_csv(spark, path, types)
    raise FileNotFoundError(f"no M5 sales file in {data_dir}")


def day_columns(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if re.fullmatch(r"d_\d+", c)), key=lambda c: int(c[2:]))


def select_recent_days(df: DataFrame, days: int | None = 365) -> DataFrame:
    """Id columns + the last ``days`` day columns (``n >= max_n - days + 1``)."""
    dcols = day_columns(df)
    if days and dcols:
        max_n = int(dcols[-1][2:])
        dcols = [c for c in dcols if int(c[2:]) >= max_n - days + 1]
    return df.select(*[c for c in df.columns if c in M5_ID_COLS], *dcols)


def melt_days(df: DataFrame) -> DataFrame:
    """Wide -> long with ``d`` and ``sales``."""
    ids = [c for c in df.columns if c in M5_ID_COLS]
    return df.unpivot(ids, day_columns(df), "d", "sales")


def day_to_date(col: str = "d", origin: str = M5_ORIGIN):
    """A04: 'd_N' -> origin + (N - 1) days."""
    return F.date_add(F.to_date(F.lit(origin)), F.substring(F.col(col), 3, 10).cast("int") - 1)


def read_calendar(spark: SparkSession, data_dir: str) -> DataFrame:
    """Calendar with ``promo`` = row-wise max over all ``snap_*`` flags (null -> 0; none -> 0)."""
    path = f"{data_dir.rstrip('/')}/{M5_CALENDAR}"
    cols = csv_header(spark, path)
    snaps = [c for c in cols if c.startswith("snap_")]
    types = {"date": T.DateType(), "wm_yr_wk": T.IntegerType(), **{c: T.IntegerType() for c in snaps}}
    cal = read_csv(spark, path, types)
    promo = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in snaps]) if len(snaps) > 1 else (
        F.coalesce(F.col(snaps[0]), F.lit(0)) if snaps else F.lit(0))
    keep = ["date"] + (["wm_yr_wk"] if "wm_yr_wk" in cols else [])
    return cal.select(*keep, promo.cast("int").alias("promo"))


def read_prices(spark: SparkSession, data_dir: str) -> DataFrame:
    """Weekly prices (store_id, item_id, wm_yr_wk, sell_price)."""
    path = f"{data_dir.rstrip('/')}/{M5_PRICES}"
    return read_csv(spark, path, {"wm_yr_wk": T.IntegerType(), "sell_price": T.DoubleType()})


def read_m5_sample(spark: SparkSession, path: str) -> DataFrame:
    """Sample CSV (date, store_id, item_id, sales, snap_event, sell_price) -> panel columns."""
    df = read_csv(spark, path, {"date": T.DateType(), "sales": T.StringType()})
    df = rename_present(df, MAPPINGS["M5"])
    df = with_defaults(df, {"promo": 0, "price": M5_PRICE_DEFAULT})
    return _finish_panel(df, M5_PRICE_DEFAULT)


def load_m5(spark: SparkSession, data_dir: str, days: int | None = 365) -> DataFrame:
    """A01-A07 + C01/C02: wide -> recent days -> long -> dated panel with calendar promo and weekly
    price (week code from the calendar by date, A-01), hierarchy from the SKU id (A-04).
    Falls back to ``m5_sample.csv`` when the wide file is missing."""
    d = data_dir.rstrip("/")
    if not any(path_exists(spark, f"{d}/{n}") for n in M5_SALES_FILES):
        return read_m5_sample(spark, f"{d}/{M5_SAMPLE}")
    from skucast.operators.panel import join_calendar, join_prices
    long = melt_days(select_recent_days(read_m5_wide(spark, d), days))
    long = long.select(F.col("item_id").alias("sku_id"), "store_id", day_to_date("d").alias("date"), "sales")
    long = clean_target(long)
    if path_exists(spark, f"{d}/{M5_CALENDAR}"):
        cal = read_calendar(spark, d)
        long = join_calendar(long, cal)
        if path_exists(spark, f"{d}/{M5_PRICES}") and "wm_yr_wk" in cal.columns:
            long = join_prices(long, cal, read_prices(spark, d), M5_PRICE_DEFAULT)
    long = with_defaults(long, {"promo": 0, "price": M5_PRICE_DEFAULT})
    return _finish_panel(long.drop("wm_yr_wk"), M5_PRICE_DEFAULT)


# ---------------------------------------------------------------- Favorita / generic
def read_favorita(spark: SparkSession, data_dir: str) -> DataFrame:
    """Typed Favorita file (splits replace chunked reads), negative sales -> 0, category from
    family / class, price 1.0; ``favorita_sample.csv`` fallback."""
    d = data_dir.rstrip("/")
    path = f"{d}/{FAVORITA_TRAIN}" if path_exists(spark, f"{d}/{FAVORITA_TRAIN}") else f"{d}/{FAVORITA_SAMPLE}"
    df = read_csv(spark, path, {"date": T.DateType(), "store_nbr": T.IntegerType(), "item_nbr": T.LongType(),
                                "unit_sales": T.StringType(), "onpromotion": T.StringType()})
    df = favorita_category(df)
    promo = F.when(F.lower(F.col("onpromotion")).isin("true", "1"), 1).otherwise(0) if "onpromotion" in df.columns \
        else F.lit(0)
    df = df.withColumn("promo", promo)
    df = rename_present(df.drop("onpromotion"), {"item_nbr": "sku_id", "store_nbr": "store_id", "unit_sales": "sales"})
    df = with_defaults(df, {"price": FAVORITA_PRICE_DEFAULT})
    return _finish_panel(df, FAVORITA_PRICE_DEFAULT, keep_category=True)


def read_mapped(spark: SparkSession, path: str, mapping: dict, defaults: dict | None = None,
                price_default: float = DEFAULTS["price"]) -> DataFrame:
    """A10: any CSV by a column mapping (source -> canonical) plus defaults (A-05)."""
    df = read_csv(spark, path, {"date": T.DateType()})
    df = rename_present(df, mapping)
    df = with_defaults(df, {**DEFAULTS, **(defaults or {})})
    return _finish_panel(df, price_default, keep_category="category" in df.columns)


def _finish_panel(df: DataFrame, price_default: float, keep_category: bool = False) -> DataFrame:
    """Clean target, normalise keys, fill promo / price; category from the file or the SKU id."""
    df = fill_panel(normalise_keys(clean_target(df)), price_default)
    parts = F.split(F.col("sku_id"), "_")
    cat = F.col("category").cast("string") if keep_category and "category" in df.columns else F.element_at(parts, 1)
    return df.select("sku_id", "store_id", "date", "sales", "promo", "price", cat.alias("category"),
                     F.array_join(F.slice(parts, 1, 2), "_").alias("dept_id"))


LOADERS = {"M5": load_m5, "FAVORITA": read_favorita}


def load_panel(spark: SparkSession, dataset: str, data_dir: str, days: int | None = 365,
               mapping: dict | None = None) -> DataFrame:
    """Dispatch by dataset name; other names use the generic mapped reader on ``{dataset}_sample.csv``."""
    key = dataset.upper()
    if key == "M5":
        return load_m5(spark, data_dir, days)
    if key == "FAVORITA":
        return read_favorita(spark, data_dir)
    return read_mapped(spark, f"{data_dir.rstrip('/')}/{dataset.lower()}_sample.csv", mapping or MAPPINGS.get(key, MAPPINGS["UCI"]))


def prepare_panel(spark: SparkSession, dataset: str, data_dir: str, days: int | None = 365, store: str | None = None,
                  category: str | None = None, sku: str | None = None, top: int | None = None, history: int = 30,
                  mapping: dict | None = None) -> DataFrame:
    """The whole preparation in one call: load, filter, keep the ``top`` SKUs by sales and those with ``history``
    days, add holidays."""
    from skucast.operators.panel import add_holidays, filter_panel, min_history, top_skus
    df = filter_panel(load_panel(spark, dataset, data_dir, days, mapping), store, category, sku)
    df = top_skus(df, top) if top else df
    return add_holidays(min_history(df, history))


# ---------------------------------------------------------------- columnar cache
def cache_panel(df: DataFrame, root: str, dataset: str, days: int | None = None) -> str:
    """Write the panel once as parquet partitioned by store (the M5 key includes ``days``);
    later reads get partition pruning on store and pushdown on the other columns."""
    path = cache_path(root, dataset, days)
    df.write.mode("overwrite").partitionBy("store_id").parquet(path)
    return path


def cache_path(root: str, dataset: str, days: int | None = None) -> str:
    return f"{root.rstrip('/')}/{dataset.upper()}" + (f"_{days}d" if days else "")


def read_cached(spark: SparkSession, root: str, dataset: str, days: int | None = None,
                columns: Sequence[str] | None = None) -> DataFrame | None:
    """Read the cached panel (optionally only ``columns``: pruned at the scan)."""
    path = cache_path(root, dataset, days)
    if not path_exists(spark, path):
        return None
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def drop_cache(spark: SparkSession, root: str, dataset: str | None = None) -> list[str]:
    """Delete cached panels: those of exactly ``dataset`` (any number of days), or all of them. Only folders
    that hold a written panel (a ``_SUCCESS`` mark) are ever removed."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    removed = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        mine = dataset is None or re.fullmatch(re.escape(dataset.upper()) + r"(_\d+d)?", name)
        if mine and st.isDirectory() and path_exists(spark, f"{st.getPath().toString()}/_SUCCESS"):
            fs.delete(st.getPath(), True)
            removed.append(name)
    return removed


# ---------------------------------------------------------------- reports
REPORT_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("MAE", T.DoubleType()), T.StructField("RMSE", T.DoubleType()),
    T.StructField("MAPE", T.DoubleType()), T.StructField("WMAPE", T.DoubleType()),
    T.StructField("SMAPE", T.DoubleType()), T.StructField("avg_WMAPE", T.DoubleType()),
    T.StructField("baseline_WMAPE", T.DoubleType()), T.StructField("improvement_pct", T.DoubleType()),
    T.StructField("n_obs", T.LongType()), T.StructField("n_skus", T.LongType()),
])


def read_reports(spark: SparkSession, report_dir: str, dataset: str | None = None) -> DataFrame:
    """All JSON metric reports side by side; headline WMAPE = avg_WMAPE, else WMAPE.
    Reads flat ``*.json`` files (dataset / model inside) and ``dataset=../model=..`` folders alike."""
    df = spark.read.schema(REPORT_SCHEMA).json(report_dir)
    if dataset:
        df = df.where(F.upper("dataset") == dataset.upper())
    return df.withColumn("headline_WMAPE", F.coalesce("avg_WMAPE", "WMAPE"))


def report(spark: SparkSession, report_dir: str, dataset: str, model: str) -> DataFrame:
    """Q10: one report by dataset and model; ``LookupError`` when there is none."""
    df = read_reports(spark, report_dir, dataset).where(F.upper("model") == model.upper())
    if df.isEmpty():
        raise LookupError(f"no report for {dataset}/{model}")
    return df
