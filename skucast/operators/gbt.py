"""Pooled boosted-tree forecaster over direct multi-step samples (survey K08, K09, D17, B14, E18).

One model for all series and horizons: features (E17) x horizon 1..H (G01) -> regularised boosting
(``boosting``: L1 and L2 terms, histograms added up by Spark). The last 20 % of sample dates form the
validation set, which drives early stopping in the one fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skucast.operators import boosting
from skucast.operators.boosting import BoostedTrees
from skucast.operators.features import DEFAULT_LAGS, DEFAULT_WINDOWS, split_fraction
from skucast.operators.forecast import pct_band
from skucast.operators.metrics import evaluate
from skucast.operators.panel import select_features
from skucast.operators.samples import multi_horizon, scoring_frame
from skucast.session import cut_lineage

#: Columns that the feature operators make beside lags and rolling statistics.
CALENDAR = ("day_of_week", "day_of_month", "week_of_year", "month", "quarter", "is_weekend", "is_holiday", "is_month_start",
            "is_month_end", "sin_week", "cos_week", "sin_year", "cos_year")
PRICE = ("promo", "price", "price_change_pct", "price_vs_mean", "promo_next_7", "promo_rolling")
SERIES = ("sku_mean", "sku_std", "sku_cv", "sku_id_enc", "store_id_enc")
PATIENCE = 20  # rounds without a lower validation error before boosting stops
TOP_IMPORTANCE = 15
KEYS = ["sku_id", "store_id"]


def feature_catalogue(lags: Sequence[int] = DEFAULT_LAGS, windows: Sequence[int] = DEFAULT_WINDOWS,
                      external: Sequence[str] = ()) -> list[str]:
    """The names of all model columns for these lags and windows, then ``external`` columns."""
    rolling = [f"roll_{stat}_{n}" for stat in ("mean", "std", "max") for n in windows]
    return [*(f"lag_{n}" for n in lags), *rolling, *CALENDAR, *PRICE, *SERIES, *external]


def model_columns(df: DataFrame, external: Sequence[str] = ()) -> list[str]:
    """Requested features that exist, plus ``horizon``."""
    return [c for c in feature_catalogue(external=external) if c in df.columns] + ["horizon"]


def gbt_samples(features: DataFrame, horizon: int = 14, keys: Sequence[str] = KEYS,
                val_frac: float = 0.2) -> DataFrame:
    """G01 + B14 + E23: multi-step samples with nulls -> 0 and ``is_val`` for the last ``val_frac``
    of sample rows in date order (date cut-off, A-09)."""
    s = multi_horizon(features, horizon, keys)
    cols = model_columns(s)
    s = select_features(s, cols, keep=[*keys, "date", "target"])
    return split_fraction(s, 1 - val_frac).withColumn("is_val", ~F.col("is_train")).drop("is_train")


def best_rounds(errors: Sequence[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """Number of trees of the lowest error before ``patience`` rounds passed without a lower one, and whether
    that many rounds were seen (if not, more rounds could still change the choice)."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def train_gbt(samples: DataFrame, params: dict | None = None, patience: int = PATIENCE) -> tuple[BoostedTrees, list[str]]:
    """The pooled model with early stopping; returns (model, feature names)."""
    cols = [c for c in samples.columns if c not in (*KEYS, "date", "target", "is_val")]
    model = boosting.fit(samples, cols, [*KEYS, "date", "horizon"], params, patience)
    return model, cols


def predict(model: BoostedTrees, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Clipped (>= 0) prediction with the +-20 % band."""
    return pct_band(df.withColumn("yhat", F.greatest(boosting.predicted(model, df), F.lit(0.0))))


def holdout_metrics(model: BoostedTrees, samples: DataFrame, cols: Sequence[str]) -> DataFrame:
    """L01 on the validation rows (MAE ... SMAPE, n_obs, band coverage / width)."""
    val = predict(model, samples.where("is_val"), cols)
    return evaluate(val, "target", "yhat", "lo", "hi").withColumn("model", F.lit("GBT"))


def feature_importance(model: BoostedTrees, cols: Sequence[str], top: int = TOP_IMPORTANCE) -> DataFrame:
    """The ``top`` largest shares of all gain (one entry per model column)."""
    spark = SparkSession.active()
    rows = sorted(model.importances().items(), key=lambda x: (-x[1], x[0]))[:top]
    return spark.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def score_gbt(model: BoostedTrees, features: DataFrame, cols: Sequence[str], horizon: int = 14,
              keys: Sequence[str] = KEYS) -> DataFrame:
    """Latest feature row of every series x h = 1..H -> clipped forecast and band, dated last + h."""
    base = [c for c in cols if c != "horizon"]
    frame = scoring_frame(features, horizon, keys, cols=["date", *base])
    frame = select_features(frame, [*base, "horizon"], keep=[*keys, "date"])
    out = predict(model, frame, cols)
    return out.select(*keys, F.date_add("date", F.col("horizon").cast("int")).alias("date"),
                      F.col("horizon").cast("int").alias("h"), "yhat", "lo", "hi", F.lit("GBT").alias("model_used"))
