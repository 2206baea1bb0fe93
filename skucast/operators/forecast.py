"""Baseline forecasters for every series in one job (survey K02-K05, K07, K10-K14, C10).

Input: a daily series table (``keys``, date, sales), normally D01 + K01 (totals per SKU,
densified). Each model reduces a series to a handful of scalars (last value, last-7 values,
means, trend slope) with one grouped aggregate over the tail of the series, then expands
H forecast rows with ``explode(sequence(1, H))``. Output schema for all models:
``keys, date, h, yhat, lo, hi, model_used``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Symmetric band (+-20 %), trend window, wiggle amplitude and period of the
# trend fallback, season length of the seasonal naive model.
BAND_PCT = 0.2
TREND_WINDOW = 28
WIGGLE_AMP, WIGGLE_PERIOD = 2.0, 7.0
SEASON = 7
MODELS = ("naive", "seasonal_naive", "moving_average", "mean", "trend_naive")


def _numbered(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """The rows with their place from the end (_rn) and what they add to a series' rows, sum and number of values."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    return df.select(*keys, "date", F.col(col).alias("_x"), rn.alias("_rn"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"),
                     F.lit(1).alias("_rows"), F.col(col).alias("_sum"), F.when(F.col(col).isNotNull(), 1).alias("_known"))


def _numbered_tail(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """``_numbered`` for series with one row for each day from their first to their last, and only their last
    ``TREND_WINDOW`` rows, which stand for all before them in the sums: these days fall into as many classes (day
    number modulo ``TREND_WINDOW``), each with its latest day in the tail. No row is sorted before its class is one row."""
    days = df.withColumn("_class", F.pmod(F.unix_date("date"), F.lit(TREND_WINDOW)))
    t = days.groupBy(*keys, "_class").agg(
        F.max("date").alias("date"), F.max_by(col, "date").alias("_latest"), F.max(F.when(F.col("date").isNull(), F.col(col))).alias("_undated"),
        F.count(F.lit(1)).alias("_rows"), F.sum(col).alias("_sum"), F.count(col).alias("_known"))
    of_series = Window.partitionBy(*keys)
    back = F.date_diff(F.max("date").over(of_series), F.col("date"))
    return t.select(*keys, "date", F.coalesce("_latest", "_undated").alias("_x"), (F.coalesce(back, F.lit(0)) + 1).alias("_rn"),
                    F.sum("_rows").over(of_series).alias("_n"), "_rows", "_sum", "_known")


def series_summary(df: DataFrame, keys: Sequence[str] = ("sku_id",), col: str = "sales", gap_free: bool = False) -> DataFrame:
    """Per series: n, last date, last value, mean, MA-7, last-7 values by reverse position, and the
    least-squares slope over the last min(28, n) points (x = 0..w-1, equals polyfit degree 1).
    ``gap_free`` says that every series has one row a day from its first to its last (K01): then nothing
    is sorted but 28 rows a series."""
    keys = list(keys)
    t = _numbered_tail(df, keys, col) if gap_free else _numbered(df, keys, col)
    w = F.least(F.col("_n"), F.lit(TREND_WINDOW))
    in_trend = F.col("_rn") <= TREND_WINDOW
    return t.groupBy(*keys).agg(
        F.sum("_rows").alias("n"),
        F.max("date").alias("last_date"),
        F.max_by("_x", "date").alias("last_value"),
        F.try_divide(F.sum("_sum").cast("double"), F.sum("_known")).alias("mean_value"),
        F.avg(F.when(F.col("_rn") <= SEASON, F.col("_x"))).alias("ma7"),
        F.avg(F.when(in_trend, F.col("_x"))).alias("ma_trend"),
        F.coalesce(F.regr_slope(F.when(in_trend, F.col("_x")), F.when(in_trend, (w - F.col("_rn")).cast("double"))),
                   F.lit(0.0)).alias("slope"),
        F.map_from_entries(F.collect_list(F.when(F.col("_rn") <= SEASON, F.struct(F.col("_rn"), F.col("_x"))))).alias("last7"),
    )


def pct_band(df: DataFrame, pct: float = BAND_PCT, col: str = "yhat") -> DataFrame:
    """lo = (1 - pct) * yhat, hi = (1 + pct) * yhat."""
    return df.withColumns({"lo": F.col(col) * (1 - pct), "hi": F.col(col) * (1 + pct)})


def _expand(summary: DataFrame, horizon: int, keys: Sequence[str]) -> DataFrame:
    return (summary.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
                   .withColumn("date", F.date_add("last_date", F.col("h"))))


def _model_expr(model: str):
    i = F.col("h") - 1
    if model == "naive":
        y = F.col("last_value")
    elif model == "seasonal_naive":
        y = F.element_at(F.col("last7"), F.least(F.col("n"), SEASON - i % SEASON).cast("int"))
    elif model == "moving_average":
        y = F.col("ma7")
    elif model == "mean":
        y = F.col("mean_value")
    elif model == "trend_naive":
        y = F.greatest(F.lit(0.0), F.col("ma_trend") + F.col("slope") * i
                       + F.lit(WIGGLE_AMP) * F.sin(i / F.lit(WIGGLE_PERIOD)))
    else:
        raise ValueError(f"unknown model {model!r}; choose from {MODELS}")
    return y.cast("double")


def baseline_forecast(df: DataFrame, model: str, horizon: int = 14, keys: Sequence[str] = ("sku_id",),
                      summary: DataFrame | None = None, gap_free: bool = False) -> DataFrame:
    """K02 naive (last value), K03 seasonal naive (step i = y[max(0, n - 7 + i mod 7)]),
    K04 moving average of the last 7, K05 mean of the series, K07 trend + wiggle
    ``max(0, mean(last w) + slope * i + 2 sin(i / 7))`` with w = min(28, n); all with the +-20 % band."""
    return baseline_forecasts(df, [model], horizon, keys, summary, gap_free)


def baseline_forecasts(df: DataFrame, models: Sequence[str] = MODELS, horizon: int = 14,
                       keys: Sequence[str] = ("sku_id",), summary: DataFrame | None = None,
                       gap_free: bool = False) -> DataFrame:
    """Several baselines in one pass: one summary row per series -> H steps -> one row per model
    (``inline`` of an array of (model, yhat) structs), so the models share a single plan branch.
    ``gap_free``: as in ``series_summary``."""
    keys = list(keys)
    s = summary if summary is not None else series_summary(df, keys, gap_free=gap_free)
    t = _expand(s, horizon, keys)
    arr = F.array(*[F.struct(F.lit(m).alias("model_used"), _model_expr(m).alias("yhat")) for m in models])
    t = t.select(*keys, "date", "h", F.inline(arr))
    return pct_band(t).select(*keys, "date", "h", "yhat", "lo", "hi", "model_used")


def forecast_all(df: DataFrame, horizon: int = 14, order: Sequence[str] = ("trend_naive",),
                 keys: Sequence[str] = ("sku_id",), category: str | None = None, limit: int | None = None,
                 extra: dict | None = None) -> DataFrame:
    """Forecasts for every series in one job. ``order`` lists models by preference (C10):
    each series gets the first model that produced rows for it. ``extra`` maps a model name to a
    ready forecast DataFrame (e.g. the seasonal AR or boosted-tree output). ``category`` is a
    SKU-id prefix filter and ``limit`` keeps the first SKUs in id order (broadcast side bounded
    by ``limit``)."""
    keys = list(keys)
    if category:
        df = df.where(F.col("sku_id").startswith(F.lit(category)))
    if limit:
        first = df.select("sku_id").distinct().orderBy("sku_id").limit(limit)
        df = df.join(F.broadcast(first), "sku_id", "left_semi")
    s = series_summary(df, keys)
    frames = []
    for m in order:
        if extra and m in extra:
            f = extra[m].join(df.select(*keys).distinct(), keys, "left_semi")
        else:
            f = baseline_forecast(df, m, horizon, keys, s)
        frames.append(f.select(*keys, "date", "h", "yhat", "lo", "hi", "model_used"))
    from skucast.operators.panel import pick_forecast
    return frames[0] if len(frames) == 1 else pick_forecast(frames, keys)


def forecast_sku(df: DataFrame, sku: str, horizon: int = 14, order: Sequence[str] = ("trend_naive",),
                 store: str | None = None) -> DataFrame:
    """One SKU (filter pushed to the scan) summed over stores and densified, then K11.
    Raises ``ValueError`` naming up to 5 example SKUs when the SKU is absent; horizon 1..30."""
    if not 1 <= horizon <= 30:
        raise ValueError("horizon must be between 1 and 30")
    sel = df.where(F.col("sku_id") == F.lit(sku))
    if store:
        sel = sel.where(F.col("store_id") == F.lit(store))
    if sel.isEmpty():
        examples = [r[0] for r in df.select("sku_id").distinct().orderBy("sku_id").limit(5).collect()]
        raise ValueError(f"SKU '{sku}' not found. Examples: {examples}")
    from skucast.operators.panel import daily_series, densify
    daily = densify(daily_series(sel, ["sku_id"]), ["sku_id"])
    return forecast_all(daily, horizon, order)


def ma_backtest(df: DataFrame, keys: Sequence[str] = ("sku_id", "store_id"), w: int = 7) -> DataFrame:
    """One-step rolling MA-7 backtest: pred = mean of the previous 7 rows (first row: the
    actual), WMAPE = sum|y - p| / (sum y + 1e-8) * 100 per series."""
    keys = list(keys)
    win = Window.partitionBy(*keys).orderBy("date").rowsBetween(-w, -1)
    t = df.withColumn("pred", F.coalesce(F.avg("sales").over(win), F.col("sales")))
    return t.groupBy(*keys).agg(
        (F.sum(F.abs(F.col("sales") - F.col("pred"))) / (F.sum("sales") + F.lit(1e-8)) * 100).alias("wmape"),
        F.count(F.lit(1)).alias("n_obs"))


def eligible(df: DataFrame, n: int, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Keep series with at least ``n`` rows (AR: H + 30 days; sequences: seq_len + H + 20)."""
    keys = list(keys)
    ok = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(*keys)
    return df.join(ok, keys, "left_semi")


def holdout_split(df: DataFrame, horizon: int, keys: Sequence[str] = ("sku_id",)) -> tuple[DataFrame, DataFrame]:
    """E22 as a pair: (train, test) with the last ``horizon`` rows of each series as test; test
    rows carry ``h`` = 1..horizon."""
    keys = list(keys)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    t = df.withColumn("_rn", rn)
    train = t.where(F.col("_rn") > horizon).drop("_rn")
    test = t.where(F.col("_rn") <= horizon).withColumn("h", F.lit(horizon) + 1 - F.col("_rn")).drop("_rn")
    return train, test
