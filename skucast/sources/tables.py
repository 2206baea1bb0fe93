"""Driver tables and the canonical demand panel derived from them.

The panel maps the star schema onto a retail sales panel:

* ``sku_id``   = ``p_type || '_' || (p_size % 3 + 1) || '_001'`` (same shape as M5 ids)
* ``store_id`` = region name of the supplier (lineitem -> supplier -> nation -> region)
* ``date``     = ship date, ``sales`` = sum of quantity, ``promo`` = any discount >= 0.08,
  ``price`` = revenue / units (revenue summed in exact integer cents, so the value does
  not depend on summation order), grouped by (sku, store, date).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

PROMO_DISCOUNT = 0.08  # fixed value: discount at or above this marks a promotion day


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sku_dim(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Part -> SKU; ``wide`` makes every part a SKU of its own, so the number of SKUs grows with the data."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    sku = F.concat_ws("_", F.col("p_type"), (F.col("p_size") % 3 + 1).cast("string"),
                      F.lpad(F.col("p_partkey").cast("string"), 9, "0") if wide else F.lit("001"))
    return part.select("p_partkey", sku.alias("sku_id"))


def demand_panel(spark: SparkSession, sf_dir: str, with_hierarchy: bool = True, wide: bool = False) -> DataFrame:
    """Canonical panel ``sku_id, store_id, date, sales, promo, price[, category, dept_id]``.

    Plan: pruned lineitem scan -> joins to the two dimensions -> one hash aggregate on
    (sku, store, date) with map-side partial aggregation, so a hot SKU or store is combined
    before the shuffle.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        F.col("l_shipdate").cast("date").alias("date"))
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    reg = read_table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("store_id"))
    # Each dimension is joined to the fact stream on its own, so Catalyst sizes every dimension
    # scan separately: small ones are broadcast (size-checked), large ones fall back to a
    # shuffle join. A pre-joined dimension would carry a product size estimate and force a
    # sort-merge join that shuffles the whole fact table.
    j = (li.join(sku_dim(spark, sf_dir, wide), li.l_partkey == F.col("p_partkey"))
           .join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
           .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
           .join(reg, F.col("n_regionkey") == F.col("r_regionkey")))
    panel = (j.groupBy("sku_id", "store_id", "date")
              .agg(F.sum("l_quantity").alias("sales"),
                   F.max((F.col("l_discount") >= PROMO_DISCOUNT).cast("int")).alias("promo"),
                   F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("_cents"),
                   F.sum("l_quantity").alias("_units"))
              .withColumn("price", F.round(F.try_divide(F.col("_cents").cast("double"),
                                                       F.col("_units") * F.lit(100.0)), 6))
              .drop("_cents", "_units"))
    if with_hierarchy:
        from skucast.operators.panel import split_hierarchy
        panel = split_hierarchy(panel)
    return panel
