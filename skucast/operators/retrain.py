"""Retraining run (survey L07): decide per model, train what is due, isolate failures, log the run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skucast.operators.drift import retrain_plan
from skucast.sources.sinks import write_run_log

LOG = "model string, due boolean, status string, error string, seconds double"
Trainer = Callable[[DataFrame], DataFrame]


def default_trainers(horizon: int = 28) -> dict[str, Trainer]:
    """The two trained forecasters: seasonal AR per series, boosted trees pooled. Each returns its hold-out report."""

    def seasonal(panel: DataFrame) -> DataFrame:
        from skucast.operators.panel import daily_series, densify
        from skucast.operators.seasonal_ar import holdout_report
        return holdout_report(densify(daily_series(panel)), horizon)

    def boosted(panel: DataFrame) -> DataFrame:
        from skucast.operators.features import build_features
        from skucast.operators.gbt import gbt_samples, holdout_metrics, train_gbt
        from skucast.session import cut_lineage
        samples = cut_lineage(gbt_samples(build_features(panel)))
        model, cols = train_gbt(samples)
        return holdout_metrics(model, samples, cols)

    return {"SAR": seasonal, "GBT": boosted}


def run_pipeline(panel: DataFrame, drift: DataFrame, staleness: DataFrame, trainers: dict[str, Trainer] | None = None,
                 force: bool = False, log_path: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Trains every model of ``trainers`` that is due (forced, drifted or stale; unknown to the registry counts as
    stale) and returns the log (one row per model) and the reports of those that succeeded. A failing model is
    logged with its error and does not stop the others. The log is appended to ``log_path`` if given."""
    import time
    trainers = default_trainers() if trainers is None else trainers
    spark = panel.sparkSession
    # one row per registered model: bounded by the number of models
    due = {r.model: r.retrain for r in retrain_plan(drift, staleness, force).select("model", "retrain").collect()}
    rows, reports = [], {}
    for name, train in trainers.items():
        if not (force or due.get(name, True)):
            rows.append((name, False, "skipped", None, 0.0))
            continue
        begun = time.monotonic()
        try:
            report = train(panel)
            report = spark.createDataFrame(report.collect(), report.schema)  # a few metric rows
            reports[name] = report.withColumn("model", F.lit(name))
            rows.append((name, True, "trained", None, time.monotonic() - begun))
        except Exception as e:  # noqa: BLE001 - one model's failure is logged and must not stop the others
            rows.append((name, True, "failed", f"{type(e).__name__}: {e}"[:500], time.monotonic() - begun))
    log = spark.createDataFrame(rows, LOG)
    if log_path:
        write_run_log(log, log_path)
    return log, reports
