"""Drift report per arriving batch of files (L04 + A17 over Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skucast.operators.drift import PSI_THRESHOLD, KS_THRESHOLD, detect_drift


def drift_monitor(spark: SparkSession, source_dir: str, schema: T.StructType, reference: DataFrame, col: str,
                  log_path: str, checkpoint_path: str, available_now: bool = True,
                  thr_psi: float = PSI_THRESHOLD, thr_ks: float = KS_THRESHOLD):
    """Start a file stream over ``source_dir`` (parquet, declared ``schema``). Every micro-batch is
    compared with ``reference`` on ``col``; the one-row report (plus row count) is written to the
    ``batch_id=`` folder of ``log_path``. Progress lives in ``checkpoint_path`` (shared storage): a
    restarted query resumes after the last committed batch, and a batch that is replayed after a
    failure replaces its own folder, so every batch is reported once.
    Returns the ``StreamingQuery`` (``available_now=True`` processes what is there and stops)."""
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def report(batch: DataFrame, batch_id: int) -> None:
        n = batch.count()
        if n == 0:
            return
        out = detect_drift(reference, batch, col, thr_psi, thr_ks)
        out = out.withColumns({"batch_rows": F.lit(n), "logged_at": F.current_timestamp()})
        out.write.mode("overwrite").parquet(f"{log_path.rstrip('/')}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
