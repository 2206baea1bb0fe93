"""SparkSession builder with the settings the operators assume."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "skucast", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return (or create) a session: ANSI on, UTC, AQE with skew handling, no UI. The master is the given one,
    the configured one, or local; memory and partition counts are only set for local masters.

    ``spark.checkpoint.dir`` is taken from the cluster configuration; a local
    scratch folder is only set when nothing is configured (tests, laptops).
    """
    configured = master or SparkConf().get("spark.master", None)  # spark-submit and spark-defaults
    cores = os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(configured or f"local[{cores}]").appName(app)
    if (configured or "local").startswith("local"):
        b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cores)))
              .config("spark.driver.memory", os.environ.get("SKUCAST_DRIVER_MEMORY", "16g")))
    elif shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (b
         .config("spark.ui.enabled", "false")
         .config("spark.sql.ansi.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder (URI), set from ``spark.checkpoint.dir`` when the context has none.

    Only a local master, whose driver and executors are one process, may fall back on a scratch folder.
    On a cluster an unset folder is an error: a machine-local path would lose data with its executor."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="skucast-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Materialise ``df`` to the shared checkpoint folder (reliable, survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, label: str) -> str:
    """URI of a new folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside drop their shuffle files when they end, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
