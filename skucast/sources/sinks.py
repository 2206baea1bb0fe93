"""Sinks: metric reports, run logs, model registry, forecast tables (survey A15, A17-A19).

All sinks write through Spark's committers (task output committed atomically per job), so a
retried task after executor loss never leaves partial files behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skucast.operators.boosting import BoostedTrees


def write_report(metrics: DataFrame, report_dir: str, dataset: str, model: str) -> str:
    """Metric rows as JSON under ``{report_dir}/dataset=../model=..`` (reports by product keep their
    partitions; adaptive execution makes small ones one file); rewriting a report replaces only its own
    partition (dynamic partition overwrite)."""
    out = metrics.withColumns({"dataset": F.lit(dataset), "model": F.lit(model)})
    (out.hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset", "model").json(report_dir))
    return report_dir


def write_run_log(log: DataFrame, path: str) -> str:
    """Append pipeline / retraining log rows with a run timestamp."""
    log.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
    return path


def write_registry(entries: DataFrame, path: str) -> str:
    """Append registry rows (dataset, model, sku_id, metrics..., trained_at, artifact path)."""
    out = entries if "trained_at" in entries.columns else entries.withColumn("trained_at", F.current_timestamp())
    out.write.mode("append").partitionBy("dataset", "model").parquet(path)
    return path


def save_model(model: BoostedTrees, cols: list[str], path: str, registry: str, dataset: str, name: str, metrics: dict) -> str:
    """The model and its column list under ``path``, and a registry row that points to it."""
    spark = SparkSession.active()
    spark.createDataFrame([(model.to_json(), cols)], "model string, columns array<string>").coalesce(1).write.mode("overwrite").parquet(path)
    entry = spark.createDataFrame([(dataset, name, path)], "dataset string, model string, artifact string")
    write_registry(entry.withColumns({k: F.lit(float(v)) for k, v in metrics.items()}), registry)
    return path


def load_model(path: str) -> tuple[BoostedTrees, list[str]]:
    """A saved model and its columns."""
    row = SparkSession.active().read.parquet(path).first()
    return BoostedTrees.from_json(row["model"]), list(row["columns"])


def best_artifact(registry: str, dataset: str, metric: str = "WMAPE") -> str | None:
    """C10 over the registry: the artifact of ``dataset`` with the lowest ``metric`` among each model's latest."""
    rows = SparkSession.active().read.parquet(registry).where(F.col("dataset") == dataset)
    latest = rows.groupBy("model").agg(F.max_by(F.struct(metric, "artifact"), "trained_at").alias("r"))
    found = latest.select("r.*").where(F.col("artifact").isNotNull()).orderBy(F.asc_nulls_last(metric), "artifact").first()
    return found["artifact"] if found else None


def write_forecast(forecast: DataFrame, path: str, dataset: str) -> str:
    """Long forecast table (dataset, sku, date, h, yhat, lo, hi, model_used), partitioned by dataset and
    model; writing one dataset's forecast leaves those of others."""
    (forecast.withColumn("dataset", F.lit(dataset)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "model_used").parquet(path))
    return path
