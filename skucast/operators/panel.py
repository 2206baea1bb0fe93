"""Panel operators: normalisation, filters, joins and series aggregation (survey B*, C*, D01, D19, K01)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skucast.schema import DEFAULTS

# Sentinels that mean "no filter" in the planner's store / category / SKU pickers (fixed values).
ALL_SENTINELS = (None, "All", "All Stores", "All Products", "All Categories")


# ---------------------------------------------------------------- B: projections, filters
def rename_present(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename the mapped columns that exist; others are left alone."""
    present = {k: v for k, v in mapping.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


def with_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Add each missing column as a literal default."""
    defaults = DEFAULTS if defaults is None else defaults
    missing = {k: F.lit(v) for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df


def clean_target(df: DataFrame, col: str = "sales") -> DataFrame:
    """Non-numeric -> null -> 0, NaN -> 0, clip at 0; result is double."""
    v = F.expr(f"try_cast(`{col}` AS DOUBLE)")
    return df.withColumn(col, F.greatest(F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))


def normalise_keys(df: DataFrame, default_store: str = DEFAULTS["store_id"]) -> DataFrame:
    """Ids as strings; missing store -> 'S1'."""
    out = df.withColumn("sku_id", F.col("sku_id").cast("string"))
    if "store_id" in out.columns:
        return out.withColumn("store_id", F.coalesce(F.col("store_id").cast("string"), F.lit(default_store)))
    return out.withColumn("store_id", F.lit(default_store))


def split_hierarchy(df: DataFrame, sku_col: str = "sku_id") -> DataFrame:
    """category = first '_' token of the SKU id, dept_id = first two tokens joined by '_'."""
    parts = F.split(F.col(sku_col), "_")
    return df.withColumns({
        "category": F.element_at(parts, 1),
        "dept_id": F.array_join(F.slice(parts, 1, 2), "_"),
    })


def favorita_category(df: DataFrame) -> DataFrame:
    """category = family, else class, else 'General'."""
    for c in ("family", "class"):
        if c in df.columns:
            return df.withColumn("category", F.col(c).cast("string"))
    return df.withColumn("category", F.lit(DEFAULTS["category"]))


def _flag(c: Column) -> Column:
    """Promo as int: true / false words first, else a number; anything else is null."""
    low = F.lower(F.trim(c))
    return (F.when(low.isin("true", "t", "yes", "y"), 1).when(low.isin("false", "f", "no", "n"), 0)
            .otherwise(c.try_cast("double").cast("int")))


def fill_panel(df: DataFrame, price_default: float = 2.0) -> DataFrame:
    """Promo null -> 0 (int), price null -> default."""
    return df.withColumns({
        "promo": F.coalesce(_flag(F.col("promo").cast("string")), F.lit(0)),
        "price": F.coalesce(F.col("price").cast("string").try_cast("double"), F.lit(float(price_default))),
    })


def filter_panel(df: DataFrame, store=None, category=None, sku=None) -> DataFrame:
    """Equality filters; sentinel values mean 'all'. Pushed down to the parquet scan."""
    for c, v in (("store_id", store), ("category", category), ("sku_id", sku)):
        if v not in ALL_SENTINELS:
            df = df.where(F.col(c) == F.lit(v))
    return df


def filter_or_all(df: DataFrame, cond: Column) -> DataFrame:
    """Keep rows matching ``cond``; if no row matches, keep every row.

    The "any match" test is a scalar EXISTS subquery, evaluated once by Spark."""
    any_match = df.where(cond).exists()
    return df.where(cond | ~any_match)


def min_history(df: DataFrame, n: int = 30, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """B10 (with D04 row count and C05 membership as a semi join): keep keys with at least ``n`` rows
    (count of non-null dates), as agg + left-semi join."""
    keys = list(keys)
    ok = df.groupBy(*keys).agg(F.count("date").alias("_n")).where(F.col("_n") >= n).select(*keys)
    return df.join(ok, keys, "left_semi")


def top_skus(df: DataFrame, n: int, col: str = "sales") -> DataFrame:
    """B11 (D03 totals, F04 top-k, C05 semi join): restrict to the n SKUs with the largest total
    (ties: sku_id asc).

    The broadcast side holds exactly ``n`` rows (a parameter), so its size is bounded."""
    top = (df.groupBy("sku_id").agg(F.sum(col).alias("_t"))
             .orderBy(F.desc("_t"), F.asc("sku_id")).limit(n).select("sku_id"))
    return df.join(F.broadcast(top), "sku_id", "left_semi")


def list_skus(df: DataFrame, category: str | None = None, store: str | None = None,
              limit: int | None = 1000) -> DataFrame:
    """Sorted distinct SKUs whose id starts with ``category``; store honoured (A-17);
    ``limit`` applies after the total order."""
    if store not in ALL_SENTINELS:
        df = df.where(F.col("store_id") == F.lit(store))
    if category not in ALL_SENTINELS:
        df = df.where(F.col("sku_id").startswith(F.lit(category)))
    out = df.select("sku_id").distinct().orderBy("sku_id")
    return out.limit(limit) if limit else out


def sku_page(df: DataFrame, category: str | None = None, store: str | None = None, limit: int = 1000) -> DataFrame:
    """Q09: the first ``limit`` SKUs, each beside the ``total`` that match."""
    every = list_skus(df, category, store, None)
    total = every.select(F.count(F.lit(1))).scalar()
    return every.limit(limit).withColumn("total", total)


def select_features(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Requested ∩ existing feature columns, nulls -> 0 for the model matrix."""
    present = [c for c in cols if c in df.columns]
    return df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in present])


def promo_days(df: DataFrame) -> DataFrame:
    """Promotion-day rows."""
    return df.where(F.col("promo") == 1)


def winsorise(df: DataFrame, p: float = 0.99, keys: Sequence[str] = ("sku_id",), col: str = "sales") -> DataFrame:
    """Cap ``col`` at its per-key percentile ``p`` (exact; no task holds a key's values)."""
    from skucast.functions.ranking import grouped_percentiles, join_by_keys
    caps = grouped_percentiles(df, keys, col, {"_cap": p})
    return join_by_keys(df, caps, keys).withColumn(col, F.least(F.col(col), F.col("_cap"))).drop("_cap")


def sort_panel(df: DataFrame, keys: Sequence[str] = ("sku_id", "store_id"), within_partitions: bool = False) -> DataFrame:
    """F02 (F01 inside every series window): multi-key sort by keys and date. A global ``orderBy``
    is a range shuffle; ``within_partitions`` only sorts each partition (e.g. before writing files
    clustered by series)."""
    cols = [*keys, "date"]
    return df.sortWithinPartitions(*cols) if within_partitions else df.orderBy(*cols)


def first_skus(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first n SKUs in id order (broadcast side bounded by n)."""
    first = df.select("sku_id").distinct().orderBy("sku_id").limit(n)
    return df.join(F.broadcast(first), "sku_id", "left_semi")


# ---------------------------------------------------------------- C: joins
def join_calendar(panel: DataFrame, cal: DataFrame) -> DataFrame:
    """Left join calendar promo on date (calendar: one row per day), null -> 0."""
    cal = cal.select("date", F.col("promo").alias("_cal_promo"))
    out = panel.join(cal, "date", "left")
    base = F.col("promo") if "promo" in panel.columns else F.lit(None)
    return out.withColumn("promo", F.coalesce(F.col("_cal_promo"), base, F.lit(0)).cast("int")).drop("_cal_promo")


def join_prices(panel: DataFrame, cal: DataFrame, prices: DataFrame, default: float = 2.0) -> DataFrame:
    """Week code from the calendar by date, then left join prices on (store, sku, week); null -> default (A-01)."""
    wk = cal.select("date", "wm_yr_wk")
    p = prices.select("store_id", F.col("item_id").alias("sku_id") if "item_id" in prices.columns else "sku_id",
                      "wm_yr_wk", F.col("sell_price").alias("_price"))
    out = panel.join(wk, "date", "left").join(p, ["store_id", "sku_id", "wm_yr_wk"], "left")
    return out.withColumn("price", F.coalesce(F.col("_price"), F.lit(float(default)))).drop("_price")


def add_holidays(df: DataFrame, holidays: DataFrame | None = None, mode: str = "rules") -> DataFrame:
    """``is_holiday`` by left join on date with a holiday dimension; ``mode='weekend'`` flags weekends."""
    if mode == "weekend":
        return df.withColumn("is_holiday", (F.weekday("date") >= 5).cast("int"))
    bounded = holidays is None  # built by rule: at most 17 rows (11 holidays + 6 observed days) per year of the data
    h = (holiday_dim(df) if bounded else holidays).select("date").distinct().withColumn("_h", F.lit(1))
    return df.join(F.broadcast(h) if bounded else h, "date", "left").withColumn("is_holiday", F.coalesce("_h", F.lit(0))).drop("_h")


def holiday_dim(df: DataFrame, date_col: str = "date") -> DataFrame:
    """US federal holidays (with Saturday->Friday / Sunday->Monday observed days) for the years of ``df``.

    Built by rule from a ``sequence`` of years, one beyond the last (New Year on a Saturday is observed
    the day before), and kept within the years of ``df``; the table has ~11 rows per year."""
    yrs = df.agg(F.year(F.min(date_col)).alias("y0"), F.year(F.max(date_col)).alias("y1"))
    y = yrs.select(F.explode(F.sequence("y0", F.col("y1") + 1)).alias("y"), "y0", "y1")

    def fixed(m, d):
        return F.make_date(F.col("y"), F.lit(m), F.lit(d))

    def nth_weekday(m, dow, n):  # dow: 'MO', 'TH' ...; n-th occurrence in month m
        first = F.next_day(F.date_sub(F.make_date(F.col("y"), F.lit(m), F.lit(1)), 1), dow)
        return F.date_add(first, 7 * (n - 1))

    def last_weekday(m, dow):
        nxt = F.add_months(F.make_date(F.col("y"), F.lit(m), F.lit(1)), 1)
        return F.date_sub(F.next_day(F.date_sub(nxt, 8), dow), 0)

    rules = [
        ("New Year's Day", fixed(1, 1), True),
        ("Martin Luther King Jr. Day", nth_weekday(1, "MO", 3), False),
        ("Washington's Birthday", nth_weekday(2, "MO", 3), False),
        ("Memorial Day", last_weekday(5, "MO"), False),
        ("Juneteenth National Independence Day", fixed(6, 19), True),
        ("Independence Day", fixed(7, 4), True),
        ("Labor Day", nth_weekday(9, "MO", 1), False),
        ("Columbus Day", nth_weekday(10, "MO", 2), False),
        ("Veterans Day", fixed(11, 11), True),
        ("Thanksgiving", nth_weekday(11, "TH", 4), False),
        ("Christmas Day", fixed(12, 25), True),
    ]
    parts = []
    for name, d, observed in rules:
        base = y.select("y", "y0", "y1", d.alias("date"), F.lit(name).alias("holiday"))
        if name.startswith("Juneteenth"):
            base = base.where(F.col("y") >= 2021)
        parts.append(base)
        if observed:
            obs = base.select(
                "y", "y0", "y1",
                F.when(F.weekday("date") == 5, F.date_sub("date", 1))
                 .when(F.weekday("date") == 6, F.date_add("date", 1)).alias("date"),
                F.concat(F.col("holiday"), F.lit(" (observed)")).alias("holiday"))
            parts.append(obs.where(F.col("date").isNotNull()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.year("date").between(F.col("y0"), F.col("y1"))).select("date", "holiday")


def join_external(df: DataFrame, ext: DataFrame, on: Sequence[str] | str, defaults: dict) -> DataFrame:
    """Left join an external signal table and fill its columns with defaults."""
    return df.join(ext, on, "left").fillna(defaults)


def pick_forecast(frames: Sequence[DataFrame], key: str | Sequence[str] = "sku_id") -> DataFrame:
    """Per key, keep the rows of the first frame (in preference order) that has the key.

    Union with a priority column, ``min(priority)`` per key, then a join back: a grouped
    aggregate and an equi-join, both shuffle-partitioned by key."""
    tagged = None
    for i, f in enumerate(frames):
        t = f.withColumn("_prio", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    keys = [key] if isinstance(key, str) else list(key)
    best = tagged.groupBy(*keys).agg(F.min("_prio").alias("_prio"))
    return tagged.join(best, keys + ["_prio"], "left_semi").drop("_prio")


# ---------------------------------------------------------------- D / K01: series aggregation
def daily_series(df: DataFrame, keys: Sequence[str] = ("sku_id",), col: str = "sales") -> DataFrame:
    """Total per key and day over the other keys (stores)."""
    keys = list(keys)
    return df.groupBy(*keys, "date").agg(F.sum(col).alias(col))


def densify(df: DataFrame, keys: Sequence[str] = ("sku_id",), fill: dict | None = None) -> DataFrame:
    """Daily grid between each key's own first and last date; gaps filled (sales -> 0, other
    value columns null, as a left join onto the grid would give).

    One window pass, no join: each row emits itself plus one row per missing day up to the next
    row of its series (``lead(date)`` -> ``posexplode(sequence(...))``), so the data is read once
    and shuffled once on the series key."""
    keys = list(keys)
    fill = {"sales": 0.0} if fill is None else fill
    w = Window.partitionBy(*keys).orderBy("date")
    nxt = F.lead("date").over(w)
    t = df.withColumn("_next", nxt)
    days = F.when(F.col("_next").isNull(), F.array(F.col("date"))).otherwise(
        F.sequence(F.col("date"), F.date_sub(F.col("_next"), 1)))
    t = t.select("*", F.posexplode(days).alias("_pos", "_day"))
    vals = [c for c in df.columns if c not in keys and c != "date"]
    first = F.col("_pos") == 0
    cols = [F.when(first, F.col(c)).otherwise(F.lit(fill[c]) if c in fill else F.lit(None)).cast(df.schema[c].dataType)
            .alias(c) for c in vals]
    return t.select(*keys, F.col("_day").alias("date"), *cols)


def metadata(df: DataFrame) -> DataFrame:
    """One-row dataset summary (counts and date range)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("sku_id").alias("n_skus"),
        F.count_distinct("store_id").alias("n_stores"),
        F.count_distinct("category").alias("n_categories"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
    )


def datasets_overview(panels: dict[str, DataFrame]) -> DataFrame:
    """Q08: the metadata row of every dataset, named."""
    out = None
    for name, df in panels.items():
        row = metadata(df).withColumn("dataset", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of one column (kept distributed, not collected)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def sku_stats(df: DataFrame, keys: Sequence[str] = ("sku_id",), col: str = "sales") -> DataFrame:
    """Mean, std (ddof 1), max, exact median (no task holds a key's values) and cv = std / (mean + 1e-8)
    per key."""
    from skucast.functions.columns import cv
    from skucast.functions.ranking import grouped_percentiles, join_by_keys
    keys = list(keys)
    stats = df.groupBy(*keys).agg(F.avg(col).alias("sku_mean"), F.stddev_samp(col).alias("sku_std"), F.max(col).alias("sku_max"))
    return (join_by_keys(stats, grouped_percentiles(df, keys, col, {"sku_median": 0.5}), keys)
            .withColumn("sku_cv", cv("sku_std", "sku_mean")))


def union_all(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out

