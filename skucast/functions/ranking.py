"""Distributed global ordering helpers (no driver collect, no single-partition window on big data)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skucast.session import cut_lineage


def _n_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))


def global_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """0-based position of each row of ``df`` in ascending ``col`` order (``col`` unique).

    Rows are range-partitioned on ``col``, tagged with their partition id and checkpointed (so a
    recomputation after executor loss cannot re-draw the ranges), numbered inside each partition,
    and the partition offsets added. Only the per-partition size table (one row per partition) is
    ordered globally; it is broadcast, bounded by the partition count."""
    ranged = cut_lineage(df.repartitionByRange(_n_parts(df), col).withColumn("_pid", F.spark_partition_id()))
    local = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_pid").orderBy(col)))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    return (local.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
                 .withColumn(out, (F.col("_off") + F.col("_i") - 1).cast("int"))
                 .drop("_pid", "_i", "_off"))


def running_sums(df: DataFrame, order_col: str, sum_cols: list[str]) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ascending ``order_col`` order (``order_col`` unique).

    Same scheme as ``global_index``: range partitions -> per-partition running sums -> partition
    totals prefix-summed on a table with one row per partition."""
    ranged = cut_lineage(df.repartitionByRange(_n_parts(df), order_col).withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"_run_{c}": F.sum(c).over(w) for c in sum_cols})
    totals = ranged.groupBy("_pid").agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    wp = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_pid", *[F.coalesce(F.sum(f"_tot_{c}").over(wp), F.lit(0)).alias(f"_off_{c}")
                                   for c in sum_cols])
    out = local.join(F.broadcast(offs), "_pid")
    return out.withColumns({f"cum_{c}": F.col(f"_off_{c}") + F.col(f"_run_{c}") for c in sum_cols}).drop(
        "_pid", *[f"_run_{c}" for c in sum_cols], *[f"_off_{c}" for c in sum_cols])


def grouped_percentiles(df: DataFrame, keys: Sequence[str], col: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles (linear interpolation, nulls left out) per key, without one task holding a key's values.

    Value counts, made with partial sums, are range-partitioned by key and value, so the distinct values of one
    key may span tasks. Running counts come from sums within a partition and the totals of the key's earlier
    partitions (one row per partition and key); the values at the two ranks beside each position are then grouped
    minima. ``shares`` maps the output columns to their percentiles; a key without values has no row."""
    keys = list(keys)
    names = [f"_k{i}" for i in range(len(keys))]
    counts = (df.where(F.col(col).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(col).cast("double").alias("_v"))
              .groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_c")))
    ranged = cut_lineage(counts.repartitionByRange(_n_parts(df), *names, "_v").withColumn("_pid", F.spark_partition_id()))
    upto = Window.partitionBy("_pid", *names).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_run", F.sum("_c").over(upto))
    totals = ranged.groupBy(*names, "_pid").agg(F.sum("_c").alias("_t"))
    by = Window.partitionBy(*names)
    offsets = totals.select(
        *[F.col(n).alias(f"{n}_o") for n in names], F.col("_pid").alias("_pid_o"), F.sum("_t").over(by).alias("_n"),
        F.coalesce(F.sum("_t").over(by.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    same = F.col("_pid") == F.col("_pid_o")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_o"))
    ranked = local.join(offsets, same).withColumn("_cum", F.col("_off") + F.col("_run"))
    places = {}
    for i, share in enumerate(shares.values()):
        at = (F.col("_n") - 1) * F.lit(float(share))
        places[f"_p{i}"] = F.first(at)
        places[f"_l{i}"] = F.min(F.when(F.col("_cum") > F.floor(at), F.col("_v")))
        places[f"_h{i}"] = F.min(F.when(F.col("_cum") > F.ceil(at), F.col("_v")))
    found = ranked.groupBy(*names).agg(*[c.alias(n) for n, c in places.items()])
    out = []
    for i, name in enumerate(shares):
        at, low, high = F.col(f"_p{i}"), F.col(f"_l{i}"), F.col(f"_h{i}")
        mixed = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
        out.append(F.when(low == high, low).otherwise(mixed).alias(name))
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *out)


def join_by_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys`` in which null keys are equal; the columns of ``left``, then the others of ``right``."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(r[f"_r_{k}"])
    return left.join(r, on, "left").drop(*[f"_r_{k}" for k in keys])
