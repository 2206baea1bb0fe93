"""Accuracy metrics, per-SKU evaluation, model comparison and quantile losses (survey L01, L08-L10, D16, D18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skucast.schema import EPS

# Quantiles of the quantile loss and the multi-task weights.
QUANTILES = (0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9)
SALES_WEIGHT, AUX_WEIGHT = 0.7, 0.3
IMPROVEMENT_TARGET = 15.0


def metric_columns(actual: str = "y", pred: str = "p", lo: str | None = None, hi: str | None = None,
                   digits: int = 4) -> list[Column]:
    """L01 as aggregate expressions: MAE, RMSE, MAPE (over |y| > 1e-8, x100, none -> 0),
    WMAPE (sum|e| / sum|y| x100, 0 when sum|y| <= 1e-8), SMAPE (denominator mean(|y|,|p|) + 1e-8),
    n_obs and, with a band, PI coverage (inclusive) and mean width; rounded to 4 digits."""
    y, p = F.col(actual).cast("double"), F.col(pred).cast("double")
    e = F.abs(y - p)
    nz = F.abs(y) > F.lit(EPS)
    tot = F.sum(F.abs(y))
    cols = [
        F.round(F.avg(e), digits).alias("MAE"),
        F.round(F.sqrt(F.avg(e * e)), digits).alias("RMSE"),
        F.round(F.coalesce(F.avg(F.when(nz, F.abs((y - p) / y))) * 100, F.lit(0.0)), digits).alias("MAPE"),
        F.round(F.when(tot > F.lit(EPS), F.sum(e) / tot * 100).otherwise(F.lit(0.0)), digits).alias("WMAPE"),
        F.round(F.avg(e / ((F.abs(y) + F.abs(p)) / 2 + F.lit(EPS))) * 100, digits).alias("SMAPE"),
        F.count(F.lit(1)).alias("n_obs"),
    ]
    if lo and hi:
        cols += [
            F.round(F.avg(((y >= F.col(lo)) & (y <= F.col(hi))).cast("double")), digits).alias("PI_Coverage"),
            F.round(F.avg(F.col(hi) - F.col(lo)), digits).alias("PI_Width"),
        ]
    return cols


def evaluate(df: DataFrame, actual: str = "y", pred: str = "p", lo: str | None = None, hi: str | None = None,
             keys: Sequence[str] = ()) -> DataFrame:
    """Metrics over all rows or per key (one grouped aggregate, partial-aggregated)."""
    cols = metric_columns(actual, pred, lo, hi)
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def evaluate_per_sku(df: DataFrame, actual: str = "sales", pred: str = "pred", sku: str = "sku_id") -> DataFrame:
    """Per-SKU metrics, ordered by WMAPE."""
    return evaluate(df, actual, pred, keys=[sku]).orderBy("WMAPE", sku)


def macro_average(df: DataFrame, col: str = "WMAPE", by: Sequence[str] = ()) -> DataFrame:
    """Mean of a per-SKU metric."""
    agg = F.avg(col).alias(f"avg_{col}")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def improvement(base: Column, model: Column) -> Column:
    """round((base - model) / base * 100, 2); 0 when base is 0."""
    return F.when(base == 0, F.lit(0.0)).otherwise(F.round((base - model) / base * 100, 2))


def compare(metrics: DataFrame, baseline_model: str, model_col: str = "model", by: Sequence[str] = ()) -> DataFrame:
    """Leaderboard ordered by WMAPE with improvement vs a baseline row and target flag (>= 15 %)."""
    by = list(by)
    base = metrics.where(F.col(model_col) == F.lit(baseline_model)).select(*by, F.col("WMAPE").alias("_base"))
    if by:
        t = metrics.join(base, by, "left")
    else:  # one baseline value: a scalar subquery, evaluated once
        t = metrics.withColumn("_base", base.select("_base").scalar())
    t = t.withColumn("improvement_pct", improvement(F.col("_base"), F.col("WMAPE")))
    return (t.withColumn("target_met", F.col("improvement_pct") >= IMPROVEMENT_TARGET)
             .drop("_base").orderBy(*by, "WMAPE", model_col))


def pinball(df: DataFrame, actual: str, preds: dict, keys: Sequence[str] = ()) -> DataFrame:
    """Mean pinball loss per quantile (columns ``pinball_q10`` ...) and their mean ``pinball``.
    ``preds`` maps a quantile to the column with its prediction; rows without a prediction skip."""
    cols, names = [], []
    for q, c in preds.items():
        e = F.col(actual) - F.col(c)
        name = f"pinball_q{int(round(q * 100)):02d}"
        cols.append(F.avg(F.greatest(F.lit(q) * e, F.lit(q - 1) * e)).alias(name))
        names.append(name)
    out = df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)
    return out.withColumn("pinball", sum((F.col(n) for n in names), F.lit(0.0)) / len(names))


def multitask_loss(df: DataFrame, actual: str, preds: dict, aux_actual: str, aux_pred: str,
                   keys: Sequence[str] = ()) -> DataFrame:
    """0.7 x mean quantile loss of the sales target + 0.3 x MSE of the auxiliary target."""
    keys = list(keys)
    pl = pinball(df, actual, preds, keys)
    mse_agg = F.avg((F.col(aux_actual) - F.col(aux_pred)) ** 2).alias("aux_mse")
    mse = df.where(F.col(aux_pred).isNotNull()).groupBy(*keys).agg(mse_agg) if keys else \
        df.where(F.col(aux_pred).isNotNull()).agg(mse_agg)
    t = pl.join(mse, keys, "inner") if keys else pl.withColumn("aux_mse", mse.select("aux_mse").scalar())
    return t.withColumn("multitask_loss", F.lit(SALES_WEIGHT) * F.col("pinball") + F.lit(AUX_WEIGHT) * F.col("aux_mse"))


def interval_from_samples(df: DataFrame, keys: Sequence[str], pred: str = "pred") -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles over sample draws (rows) per key."""
    return (df.groupBy(*keys)
              .agg(F.avg(pred).alias("mean"), F.percentile(pred, 0.025).alias("lower"),
                   F.percentile(pred, 0.975).alias("upper")))
