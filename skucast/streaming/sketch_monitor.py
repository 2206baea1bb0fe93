"""Drift of a file stream by mergeable quantile sketches (L02, L04, L07): the reference is read once.

A sample is kept as one row: its size, sums and a KLL sketch of its values. The reference's row is written when the
monitor first starts; every micro-batch becomes such a row, is compared with the reference, and is merged into the row
of all batches so far, which is compared as well. Ranks read from a sketch are off by at most ``rank_error(k)`` with
99 % confidence, so a share of PSI by twice that, and the distance D by the errors of both sketches and the step of
the grid of ``GRID`` reference quantiles that it is taken over. PSI takes logarithms of shares: a bucket that is almost
empty in one sample makes it as uncertain as that bucket's share; the exact PSI (``drift.psi``) is there for such cases.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skucast.operators.drift import KS_THRESHOLD, MEAN_CHANGE_THRESHOLD, PSI_SHARE_FLOOR, PSI_THRESHOLD, kolmogorov_p
from skucast.schema import EPS
from skucast.sources.readers import path_exists

K, GRID = 800, 200


def rank_error(k: int = K) -> float:
    """Normalised rank error of a KLL sketch of parameter ``k`` (the published fit for single ranks)."""
    return 2.296 / k**0.9021


def value_sketch(df: DataFrame, col: str, k: int = K) -> DataFrame:
    """One row: n, total, low, high and the sketch of the non-null values of ``col``."""
    v = F.col(col).cast("double")
    return df.where(v.isNotNull()).agg(F.count(v).alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.min(v).alias("low"),
                                       F.max(v).alias("high"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame) -> DataFrame:
    """The row of all samples whose rows are given."""
    return sketches.where("n > 0").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))


def _ranks(sketch: DataFrame, values: list[float]) -> list[float]:
    return sketch.select(F.kll_sketch_get_rank_double("sketch", F.array(*map(F.lit, values)))).first()[0]


def sketch_drift(ref: DataFrame, cur: DataFrame, thr_psi: float = PSI_THRESHOLD, thr_ks: float = KS_THRESHOLD, bins: int = 10) -> DataFrame:
    """The drift report of two sketch rows: psi, ks_d, ks_p_value (asymptotic), mean_change_pct, drift_detected, and
    the rank error. An empty sample shows no drift. A bounded number of quantiles and ranks passes the driver."""
    spark = ref.sparkSession
    a, b = (s.select("n", "total", "low", "high").first() for s in (ref, cur))
    psi, d, change = 0.0, 0.0, 0.0
    if a.n and b.n:
        grid = ref.select(F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))).first()[0]
        points = sorted({a.low, a.high, b.low, b.high, *grid})
        ra, rb = (dict(zip(points, _ranks(s, points))) for s in (ref, cur))
        d = max(abs(ra[p] - rb[p]) for p in points)
        edges = sorted({a.low, a.high, *(grid[round(i * GRID / bins)] for i in range(1, bins))})
        floor = lambda x: max(x, PSI_SHARE_FLOOR)
        for i in range(1, len(edges)):
            # the first bucket holds its lower edge as well, so its share starts below it
            shares = [r[edges[i]] - (r[edges[i - 1]] if i > 1 else 0.0) for r in (ra, rb)]
            psi += (floor(shares[1]) - floor(shares[0])) * math.log(floor(shares[1]) / floor(shares[0]))
        change = abs(b.total / b.n - a.total / a.n) / (a.total / a.n + EPS)
    lam = d * math.sqrt(a.n * b.n / (a.n + b.n)) if a.n and b.n else 0.0
    row = spark.range(1).select(F.lit(float(psi)).alias("psi"), F.lit(float(d)).alias("ks_d"), kolmogorov_p(F.lit(lam)).alias("ks_p_value"),
                                F.lit(change * 100).alias("mean_change_pct"), F.lit(a.n).alias("ref_rows"), F.lit(b.n).alias("rows"),
                                F.lit(rank_error()).alias("rank_error"))
    return row.withColumn("drift_detected", (F.col("psi") > thr_psi) | (F.col("ks_p_value") < thr_ks) | F.lit(change > MEAN_CHANGE_THRESHOLD))


def sketch_monitor(spark: SparkSession, source_dir: str, schema: T.StructType, reference: DataFrame, col: str, state_path: str,
                   checkpoint_path: str, available_now: bool = True):
    """Starts a file stream whose batches are compared with ``reference`` by their sketches. Below ``state_path``:
    ``reference`` (read only if it is not there yet), ``batches/batch_id=`` (a sketch row each) and
    ``reports/batch_id=`` (two rows: the batch, and all batches up to it). A batch that is replayed replaces its own
    rows, and the rows of all batches come from the batch folders, so nothing is counted twice. Returns the query."""
    root = state_path.rstrip("/")
    if not path_exists(spark, f"{root}/reference/_SUCCESS"):
        value_sketch(reference, col).write.mode("overwrite").parquet(f"{root}/reference")
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def report(batch: DataFrame, batch_id: int) -> None:
        value_sketch(batch, col).write.mode("overwrite").parquet(f"{root}/batches/batch_id={batch_id}")
        ref = spark.read.parquet(f"{root}/reference")
        every = spark.read.parquet(f"{root}/batches").where(F.col("batch_id") <= batch_id)
        mine = sketch_drift(ref, every.where(F.col("batch_id") == batch_id)).withColumn("scope", F.lit("batch"))
        so_far = sketch_drift(ref, merged(every)).withColumn("scope", F.lit("all"))
        mine.unionByName(so_far).coalesce(1).write.mode("overwrite").parquet(f"{root}/reports/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
