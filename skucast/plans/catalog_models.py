"""Registered queries for samples (G), forecasts (K) and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skucast.plans.catalog import finish, panel, query

KEYS = ["sku_id", "store_id"]
H = 14


def daily_dense(spark, sf, reuse: bool = False):
    """D01 + K01: per-SKU daily totals over stores on a gap-free daily grid (optionally materialised)."""
    from skucast.operators.panel import daily_series, densify
    d = densify(daily_series(panel(spark, sf), ["sku_id"]), ["sku_id"])
    if not reuse:
        return d
    from skucast.session import cut_lineage
    return cut_lineage(d)


def _sum_array(c):
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def _weighted_sum(c):
    """Sum of position x value: depends on the order of a window, not on its values alone."""
    return _sum_array(F.transform(c, lambda x, i: x * (i + 1)))


# ================================================================= G: samples
@query("G01_multi_horizon")
def q_multi_horizon(spark, sf):
    from skucast.operators.samples import multi_horizon
    out = multi_horizon(panel(spark, sf).select(*KEYS, "date", "sales"), H)
    return finish(out.select(*KEYS, "date", "horizon", "target"))


@query("G02_scoring_frame")
def q_scoring_frame(spark, sf):
    from skucast.operators.features import lags
    from skucast.operators.samples import scoring_frame
    f = lags(panel(spark, sf).select(*KEYS, "date", "sales"), lag_list=[1, 7])
    return finish(scoring_frame(f, H, cols=["date", "sales", "lag_1", "lag_7"]))


@query("G03_sequence_samples")
def q_sequence_samples(spark, sf):
    from skucast.operators.samples import sequence_samples
    s = sequence_samples(panel(spark, sf, reuse=True), seq_len=30, horizon=7, features=["promo", "price"])
    return finish(s.select(*KEYS, "date", "s_min", "s_max", "y", F.size("x").alias("seq_len"),
                           _sum_array(F.transform("x", lambda v: v[0])).alias("seq_sales_sum"),
                           _weighted_sum(F.transform("x", lambda v: v[0])).alias("seq_sales_weighted"),
                           F.element_at(F.element_at("x", -1), 3).alias("last_price_z")))


@query("G04_G05_encdec_windows")
def q_encdec(spark, sf):
    from skucast.operators.samples import encdec_prepare, encdec_windows
    prep = encdec_prepare(panel(spark, sf, reuse=True), 60)
    w = encdec_windows(prep, 30, 14)
    return finish(w.select(*KEYS, "date", "time_idx", "split", F.size("encoder").alias("enc_len"),
                           F.size("decoder").alias("dec_len"), _sum_array("encoder").alias("enc_sum"),
                           _sum_array("decoder").alias("dec_sum"), _weighted_sum("encoder").alias("enc_weighted"),
                           _weighted_sum("decoder").alias("dec_weighted")))


@query("G06_multitask_prepare")
def q_multitask(spark, sf):
    from skucast.operators.samples import multitask_prepare
    out = multitask_prepare(panel(spark, sf).select(*KEYS, "date", "sales", "price"), aux_col="price")
    return finish(out)


# ================================================================= K: forecasts
@query("K02_K07_baselines")
def q_baselines(spark, sf):
    from skucast.operators.forecast import MODELS, baseline_forecasts
    return finish(baseline_forecasts(daily_dense(spark, sf), MODELS, H, gap_free=True))


@query("K11_forecast_all")
def q_forecast_all(spark, sf):
    """Every SKU."""
    return _forecast_all(spark, sf)


@query("K11_forecast_category")
def q_forecast_category(spark, sf):
    """The request parameters: SKUs of a category, the first ``limit`` of them."""
    return _forecast_all(spark, sf, category="PROMO", limit=2)


def _forecast_all(spark, sf, **chosen):
    from skucast.operators.forecast import baseline_forecast, eligible, forecast_all
    d = daily_dense(spark, sf)
    # preference: moving average where the series has >= 2400 days, else the trend fallback
    ma_long = baseline_forecast(eligible(d, 2400), "moving_average", H)
    return finish(forecast_all(d, H, order=("moving_average_long", "trend_naive"),
                               extra={"moving_average_long": ma_long}, **chosen))


@query("K12_forecast_sku")
def q_forecast_sku(spark, sf):
    from skucast.operators.forecast import forecast_sku
    return finish(forecast_sku(panel(spark, sf), "PROMO_2_001", H, order=("trend_naive",)))


@query("K13_ma_backtest")
def q_ma_backtest(spark, sf):
    from skucast.operators.forecast import ma_backtest
    return finish(ma_backtest(panel(spark, sf)))


@query("K14_eligible")
def q_eligible(spark, sf):
    from skucast.operators.forecast import eligible
    return eligible(daily_dense(spark, sf), 2400).groupBy("sku_id").agg(F.count(F.lit(1)).alias("n_rows"))


# ================================================================= L: metrics
def holdout_predictions(spark, sf, horizon: int = 28):
    """Hold out the last ``horizon`` days of every SKU series, forecast them with each baseline
    from the training part, and pair forecasts with actuals on (sku_id, h)."""
    from skucast.operators.forecast import MODELS, baseline_forecasts, holdout_split
    train, test = holdout_split(daily_dense(spark, sf, reuse=True), horizon)
    fc = baseline_forecasts(train, MODELS, horizon, gap_free=True)  # gap-free series stay so without their last days
    return fc.join(test.select("sku_id", "h", F.col("sales").alias("y")), ["sku_id", "h"])


@query("L01_holdout_metrics")
def q_holdout_metrics(spark, sf):
    from skucast.operators.metrics import evaluate
    pairs = holdout_predictions(spark, sf)
    return finish(evaluate(pairs, "y", "yhat", "lo", "hi", keys=["model_used"]))


@query("L08_per_sku_metrics")
def q_per_sku(spark, sf):
    from skucast.operators.metrics import evaluate
    pairs = holdout_predictions(spark, sf)
    return finish(evaluate(pairs, "y", "yhat", keys=["sku_id", "model_used"]))


@query("L09_compare_models")
def q_compare(spark, sf):
    from skucast.operators.metrics import compare, evaluate, macro_average
    per_sku = evaluate(holdout_predictions(spark, sf), "y", "yhat", keys=["sku_id", "model_used"])
    macro = macro_average(per_sku, "WMAPE", by=["model_used"]).withColumnRenamed("avg_WMAPE", "WMAPE")
    return finish(compare(macro, "mean", model_col="model_used"))


@query("L10_pinball_multitask")
def q_pinball(spark, sf):
    from skucast.operators.features import series_window
    from skucast.operators.metrics import QUANTILES, multitask_loss
    p = panel(spark, sf).select(*KEYS, "date", "sales", "price")
    w = series_window(KEYS)
    frame = w.rowsBetween(-28, -1)
    cols = {f"q{int(round(q * 100)):02d}": F.percentile("sales", q).over(frame) for q in QUANTILES}
    t = p.withColumns(cols).withColumn("price_prev", F.lag("price", 1).over(w)).where(F.col("q50").isNotNull())
    preds = {q: f"q{int(round(q * 100)):02d}" for q in QUANTILES}
    return finish(multitask_loss(t, "sales", preds, "price", "price_prev", keys=["store_id"]))


# ================================================================= K08 / K09 / D17: pooled boosted trees
_FITTED: dict[tuple[str, str], tuple] = {}


def _gbt(spark, sf):
    """Features, samples (materialised once: the x14 expansion is read by the split, the fit and the metrics),
    the model and its columns; fitted once per application and set of tables."""
    from skucast.operators.features import build_features
    from skucast.operators.gbt import gbt_samples, train_gbt
    from skucast.session import cut_lineage
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        feats = cut_lineage(build_features(panel(spark, sf, reuse=True)))
        samples = cut_lineage(gbt_samples(feats, H))
        _FITTED[key] = (feats, samples, *train_gbt(samples))
    return _FITTED[key]


def _first_tree(spark, sf):
    """One tree of two levels over a few columns, without sampling: what SQL can grow as well."""
    from skucast.operators.features import lags
    from skucast.operators.gbt import gbt_samples, train_gbt
    from skucast.session import cut_lineage
    feats = cut_lineage(lags(panel(spark, sf).select(*KEYS, "date", "sales", "promo", "price"), lag_list=[1, 7]))
    samples = cut_lineage(gbt_samples(feats, H))
    whole = {"maxIter": 1, "maxDepth": 2, "subsamplingRate": 1.0, "featureSubset": 1.0}
    return feats, *train_gbt(samples, whole)


@query("K08_first_tree")
def q_first_tree(spark, sf):
    """The nodes of the first tree: column and cut of splits, value of leaves."""
    _, model, cols = _first_tree(spark, sf)
    rows = []
    for tree in model.trees:
        live = {0}
        for node, (f, cut, value) in enumerate(zip(tree.feature.tolist(), tree.cut.tolist(), tree.value.tolist())):
            if node in live:
                if f >= 0:
                    live |= {2 * node + 1, 2 * node + 2}
                rows.append((node, cols[f] if f >= 0 else None, model.edges[f][cut] if f >= 0 else None, None if f >= 0 else value))
    return finish(spark.createDataFrame(rows, "node int, feature string, cut double, value double"))


@query("K09_first_tree_forecast")
def q_first_tree_forecast(spark, sf):
    from skucast.operators.gbt import score_gbt
    feats, model, cols = _first_tree(spark, sf)
    return finish(score_gbt(model, feats, cols, H))


@query("K08_gbt_holdout_metrics")
def q_gbt_metrics(spark, sf):
    from skucast.operators.gbt import holdout_metrics
    _, samples, model, cols = _gbt(spark, sf)
    return finish(holdout_metrics(model, samples, cols).withColumn("n_trees", F.lit(model.getNumTrees)))


@query("K08_gbt_validation_rows")
def q_gbt_validation_rows(spark, sf):
    """The part of K08 that SQL can state: validation rows, their horizons and dates."""
    from skucast.operators.features import build_features
    from skucast.operators.gbt import gbt_samples
    val = gbt_samples(build_features(panel(spark, sf, reuse=True)), H).where("is_val")
    return val.groupBy(F.col("horizon").cast("int").alias("horizon")).agg(
        F.count(F.lit(1)).alias("n_obs"), F.min("date").alias("first_date"), F.sum("target").alias("sum_target"))


@query("K09_gbt_forecast")
def q_gbt_forecast(spark, sf):
    from skucast.operators.gbt import score_gbt
    feats, _, model, cols = _gbt(spark, sf)
    return finish(score_gbt(model, feats, cols, H))


@query("K09_gbt_forecast_grid")
def q_gbt_forecast_grid(spark, sf):
    """The part of K09 that SQL can state: series, dates and horizons, and bands in order."""
    from skucast.operators.gbt import score_gbt
    feats, _, model, cols = _gbt(spark, sf)
    fc = score_gbt(model, feats, cols, H)
    ordered = (F.col("yhat") >= 0) & (F.col("lo") <= F.col("yhat")) & (F.col("yhat") <= F.col("hi"))
    return fc.select(*KEYS, "date", "h", "model_used", ordered.alias("band_in_order"))


@query("D17_feature_importance")
def q_importance(spark, sf):
    from skucast.operators.gbt import feature_importance
    _, _, model, cols = _gbt(spark, sf)
    return finish(feature_importance(model, cols))


# ================================================================= K06: seasonal AR (ARIMA role)
@query("K06_normal_equations")
def q_normal_equations(spark, sf):
    from skucast.operators.seasonal_ar import NX, normal_equations
    ne = normal_equations(daily_dense(spark, sf))
    cols = [F.col("gram")[i * NX + j].alias(f"g{i}{j}") for i in range(NX) for j in range(i, NX)]
    cols += [F.col("xty")[i].alias(f"b{i}") for i in range(NX)]
    return finish(ne.select("sku_id", *cols, "yty", "n"))


@query("K06_seasonal_ar_forecast")
def q_seasonal_ar(spark, sf):
    from skucast.operators.seasonal_ar import seasonal_ar
    return finish(seasonal_ar(daily_dense(spark, sf, reuse=True), 28))


@query("K06_seasonal_ar_holdout")
def q_seasonal_ar_holdout(spark, sf):
    from skucast.operators.seasonal_ar import holdout_report
    return finish(holdout_report(daily_dense(spark, sf, reuse=True), 28))


@query("K06_unit_root_tests")
def q_unit_root_tests(spark, sf):
    from skucast.operators.arima import unit_root_tests
    return finish(unit_root_tests(daily_dense(spark, sf, reuse=True)))


@query("K06_arima_forecast")
def q_arima(spark, sf):
    from skucast.operators.arima import arima
    return finish(arima(daily_dense(spark, sf, reuse=True), 28))


@query("K06_arima_holdout")
def q_arima_holdout(spark, sf):
    from skucast.operators.arima import arima
    from skucast.operators.seasonal_ar import holdout_report
    return finish(holdout_report(daily_dense(spark, sf, reuse=True), 28, model=arima, name="ARIMA"))


@query("D18_interval_from_samples")
def q_interval(spark, sf):
    """D18 on the panel: per (SKU, day) the stores' sales are the draws."""
    from skucast.operators.metrics import interval_from_samples
    return finish(interval_from_samples(panel(spark, sf), ["sku_id", "date"], "sales"))
