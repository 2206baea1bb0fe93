"""Canonical schemas, keys and defaults."""

from pyspark.sql import types as T

# Series key of the demand panel and the default window partitioning.
KEYS = ["sku_id", "store_id"]

PANEL_COLUMNS = ["sku_id", "store_id", "date", "sales", "promo", "price", "category", "dept_id"]

PANEL_SCHEMA = T.StructType([
    T.StructField("sku_id", T.StringType(), False),
    T.StructField("store_id", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("sales", T.DoubleType(), False),
    T.StructField("promo", T.IntegerType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("dept_id", T.StringType(), True),
])

# Fixed values that must equal the reference's defaults.
DEFAULTS = {
    "sku_id": "SKU_001",
    "store_id": "S1",
    "sales": 0.0,
    "promo": 0,
    "price": 2.0,
    "category": "General",
}
M5_PRICE_DEFAULT = 2.0
FAVORITA_PRICE_DEFAULT = 1.0
M5_ORIGIN = "2011-01-29"  # date of day column d_1

# Column mappings of the generic loaders (source name -> canonical name).
MAPPINGS = {
    "M5": {"item_id": "sku_id", "store_id": "store_id", "sales": "sales", "snap_event": "promo",
           "sell_price": "price"},
    "FAVORITA": {"item_nbr": "sku_id", "store_nbr": "store_id", "unit_sales": "sales", "onpromotion": "promo"},
    "UCI": {"sku_id": "sku_id", "quantity": "sales", "unit_price": "price"},
}

EPS = 1e-8
