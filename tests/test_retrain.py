"""Retraining run, model registry and early stopping."""

from pyspark.sql import functions as F

from skucast.operators import gbt, retrain
from skucast.operators.features import build_features
from skucast.session import cut_lineage
from skucast.sources import sinks
from skucast.sources.tables import demand_panel
from tests.conftest import SF001


def test_best_rounds_waits_for_patience():
    assert gbt.best_rounds([5, 4, 3, 9, 9, 2, 9, 9, 9, 9], 3) == (6, True)
    assert gbt.best_rounds([5, 4, 3, 9, 9, 9, 2], 3) == (3, True)
    assert gbt.best_rounds([5, 4, 3], 3) == (3, False)
    assert gbt.best_rounds([], 3) == (1, False)


def test_pipeline_isolates_failures_and_logs(spark, tmp_path):
    drift = spark.createDataFrame([(False,)], "drift_detected boolean")
    stale = spark.createDataFrame([("A", True), ("B", True), ("C", False)], "model string, is_stale boolean")
    report = spark.createDataFrame([(1.5,)], "WMAPE double")

    def broken(_):
        raise ValueError("no data")

    trainers = {"A": lambda p: report, "B": broken, "C": lambda p: report, "new": lambda p: report}
    log, reports = retrain.run_pipeline(report, drift, stale, trainers, log_path=str(tmp_path / "log"))
    got = {r.model: (r.due, r.status, r.error) for r in log.collect()}
    assert got == {"A": (True, "trained", None), "B": (True, "failed", "ValueError: no data"),
                   "C": (False, "skipped", None), "new": (True, "trained", None)}
    assert set(reports) == {"A", "new"} and reports["A"].first().WMAPE == 1.5
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    forced, _ = retrain.run_pipeline(report, drift, stale, trainers, force=True)
    assert forced.where("status = 'trained'").count() == 3


def test_model_round_trip_and_choice_by_registry(spark, tmp_path):
    few = demand_panel(spark, SF001).where("store_id = 'ASIA' AND category = 'PROMO'")
    samples = cut_lineage(gbt.gbt_samples(build_features(few), 3))
    model, cols = gbt.train_gbt(samples, {"maxIter": 4, "maxDepth": 2}, patience=2)
    assert 1 <= model.getNumTrees <= 4
    registry = str(tmp_path / "registry")
    sinks.save_model(model, cols, str(tmp_path / "good"), registry, "M5", "GBT", {"WMAPE": 9.0})
    sinks.save_model(model, cols, str(tmp_path / "bad"), registry, "M5", "OTHER", {"WMAPE": 12.0})
    assert sinks.best_artifact(registry, "UCI") is None
    found = sinks.best_artifact(registry, "M5")
    assert found == str(tmp_path / "good")
    again, names = sinks.load_model(found)
    assert names == cols
    both = [gbt.predict(m, samples, cols).agg(F.sum("yhat")).first()[0] for m in (model, again)]
    assert both[0] == both[1]
