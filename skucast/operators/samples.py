"""Training-sample builders for the forecasters (survey G01-G06).

Samples are built with series windows (bounded by series length) and ``posexplode`` /
``collect_list`` over row frames, so each sample is produced inside the task that holds its
series; no sample ever passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skucast.operators.features import series_window
from skucast.schema import EPS, KEYS


def multi_horizon(df: DataFrame, horizon: int = 14, keys: Sequence[str] = KEYS, target: str = "sales") -> DataFrame:
    """Direct multi-step samples: for h = 1..H, ``target`` = ``sales`` h rows ahead in the same
    series (A-10), rows without a target dropped, ``horizon`` = h (C09: row x horizon product).

    The H leads are computed by one window pass and expanded with ``posexplode`` (narrow)."""
    w = series_window(keys)
    leads = F.array(*[F.lead(target, h).over(w) for h in range(1, horizon + 1)])
    out = df.withColumn("_leads", leads).select("*", F.posexplode("_leads").alias("_pos", "target")).drop("_leads")
    return out.where(F.col("target").isNotNull()).withColumn("horizon", F.col("_pos") + 1).drop("_pos")


def scoring_frame(df: DataFrame, horizon: int = 14, keys: Sequence[str] = KEYS,
                  cols: Sequence[str] | None = None) -> DataFrame:
    """The latest row of every series repeated for h = 1..H (input of a direct multi-step model)."""
    keys = list(keys)
    cols = [c for c in (cols or df.columns) if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "date").alias("_last"))
    return (last.select(*keys, "_last.*")
                .withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon)))))


def sequence_samples(df: DataFrame, seq_len: int = 30, horizon: int = 7, features: Sequence[str] = ("promo", "price"),
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """G03 (D15 scaling stats): sliding windows for sequence models.

    Per series: sales min-max scaled (``s_min``, ``s_max`` kept for de-scaling), features z-scored
    with the population std; each sample ends at a row, holds the last ``seq_len`` rows as
    ``x`` = array<array<double>> ([scaled sales, features...] per step) and ``y`` = scaled sales
    ``horizon`` rows after the window end. Only full windows with a target are kept."""
    keys = list(keys)
    feats = [c for c in features if c in df.columns]
    aggs = [F.min("sales").alias("s_min"), F.max("sales").alias("s_max")]
    for c in feats:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}")]
    st = df.groupBy(*keys).agg(*aggs)
    t = df.join(st, keys, "left")
    t = t.withColumn("sales_n", (F.col("sales") - F.col("s_min")) / (F.col("s_max") - F.col("s_min") + F.lit(EPS)))
    for c in feats:
        t = t.withColumn(f"{c}_z", (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + F.lit(EPS)))
    w = series_window(keys)
    frame = w.rowsBetween(-(seq_len - 1), 0)
    step = F.array(F.col("sales_n"), *[F.col(f"{c}_z").cast("double") for c in feats])
    t = t.select(*keys, "date", "s_min", "s_max", "sales_n",
                 F.collect_list(step).over(frame).alias("x"),
                 F.lead("sales_n", horizon).over(w).alias("y"))
    return t.where((F.size("x") == seq_len) & F.col("y").isNotNull()).drop("sales_n")


def encdec_prepare(df: DataFrame, min_len: int = 60, keys: Sequence[str] = KEYS,
                   reals: Sequence[str] = ("price", "promo")) -> DataFrame:
    """time_idx per series, keep series whose max time_idx >= ``min_len`` (C04 semi join), reals null -> 0.0,
    sales clipped at 0."""
    from skucast.operators.features import time_idx
    keys = list(keys)
    t = time_idx(df, keys)
    ok = t.groupBy(*keys).agg(F.max("time_idx").alias("_mx")).where(F.col("_mx") >= min_len).select(*keys)
    t = t.join(ok, keys, "left_semi")
    fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in reals if c in t.columns}
    fills["sales"] = F.greatest(F.col("sales"), F.lit(0.0))
    return t.withColumns(fills)


def encdec_windows(df: DataFrame, enc: int = 30, dec: int = 14, min_enc: int | None = None,
                   keys: Sequence[str] = KEYS, target: str = "sales") -> DataFrame:
    """encoder/decoder samples on a prepared panel.

    A sample starts its decoder at a row: encoder = up to ``enc`` previous rows (at least
    ``min_enc``, default enc // 2), decoder = the next ``dec`` rows. Training samples lie entirely
    at ``time_idx <= max(time_idx) - dec``; the validation sample of each series is its last
    window (decoder = last ``dec`` rows). ``split`` tells which."""
    keys = list(keys)
    min_enc = enc // 2 if min_enc is None else min_enc
    cutoff = df.select(F.max("time_idx")).scalar() - dec
    w = series_window(keys)
    t = df.select(
        *keys, "date", "time_idx",
        F.collect_list(target).over(w.rowsBetween(-enc, -1)).alias("encoder"),
        F.collect_list(target).over(w.rowsBetween(0, dec - 1)).alias("decoder"),
        F.lead("date", dec).over(w).isNull().alias("_last"))
    t = t.where((F.size("encoder") >= min_enc) & (F.size("decoder") == dec))
    # a window of a short series can be both: its last one, and wholly before the cut-off
    splits = F.array_compact(F.array(F.when(F.col("time_idx") + dec - 1 <= cutoff, F.lit("train")),
                                     F.when(F.col("_last"), F.lit("val"))))
    return t.withColumn("split", F.explode(splits)).drop("_last")


def multitask_prepare(df: DataFrame, aux_col: str = "inventory_level", keys: Sequence[str] = KEYS) -> DataFrame:
    """Auxiliary target z-scored per SKU (E16), time_idx, calendar categoricals as strings,
    SKU mean / std (null std -> 1.0)."""
    from skucast.operators.features import group_stats, time_idx, zscore_by
    t = zscore_by(df, aux_col, ["sku_id"], f"{aux_col}_norm")
    t = time_idx(t, keys)
    d = F.col("date")
    t = t.withColumns({
        "month_cat": F.month(d).cast("string"),
        "day_of_week_cat": F.weekday(d).cast("string"),
        "quarter_cat": F.quarter(d).cast("string"),
        "is_weekend_cat": (F.weekday(d) >= 5).cast("int").cast("string"),
    })
    t = group_stats(t, "sales", ["sku_id"]).withColumnsRenamed({"sales_mean": "sku_mean", "sales_std": "sku_std"})
    return t.drop("sales_cv")
