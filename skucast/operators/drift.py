"""Distribution drift (PSI, two-sample KS), staleness and retraining decisions (survey D06, L02-L07).

Everything reduces to one table of value counts with a distributed prefix sum (range partitions +
per-partition offsets): exact quantiles, bucket counts and the KS statistic are read from it, so no
step orders or holds a whole sample inside one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skucast.functions.ranking import running_sums
from skucast.schema import EPS
from skucast.session import cut_lineage

# Default thresholds of the drift test and the retraining policy.
PSI_THRESHOLD = 0.2
KS_THRESHOLD = 0.05
MEAN_CHANGE_THRESHOLD = 0.3
PSI_SHARE_FLOOR = 1e-6
STALE_HOURS = 24
EXACT_KS = 2_000  # values a sample; the exact p-value takes (n1 + n2) steps over n1 numbers


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """(v, n): how often each non-null value occurs (partial aggregation, one row per distinct value)."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias(name))


def _order_statistics(cum: DataFrame, n: str, total: int, shares: Sequence[float]) -> dict[float, float]:
    """Exact percentiles (linear interpolation) from value counts with running sums: the value at position p is the
    first whose running sum passes p. A bounded number of values is fetched, whatever the data size."""
    places = {q: q * (total - 1) for q in shares}
    needed = sorted({math.floor(p) for p in places.values()} | {math.ceil(p) for p in places.values()})
    row = cum.agg(*[F.min(F.when(F.col(f"cum_{n}") > p, F.col("v"))).alias(f"p{p}") for p in needed]).first()
    at = {p: row[f"p{p}"] for p in needed}
    return {q: at[math.floor(p)] + (p - math.floor(p)) * (at[math.ceil(p)] - at[math.floor(p)])
            for q, p in places.items()}


def exact_percentiles(df: DataFrame, col: str, shares: Sequence[float]) -> list[float] | None:
    """Exact percentiles of a whole column without one task holding its values; None without values."""
    counts = value_counts(df, col)
    cum = running_sums(counts, "v", ["n"])
    total = cum.agg(F.max("cum_n")).first()[0]
    if not total:
        return None
    found = _order_statistics(cum, "n", total, shares)
    return [found[q] for q in shares]


def dist_stats(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """Mean, std (ddof 1), p25, p50, p75, p95 (exact, linear interpolation like numpy)."""
    names = ["p25", "p50", "p75", "p95"]
    q = exact_percentiles(df, col, [0.25, 0.5, 0.75, 0.95]) or [None] * 4
    t = df.agg(F.avg(col).alias(prefix + "mean"), F.stddev_samp(col).alias(prefix + "std"))
    return t.withColumns({prefix + n: F.lit(x).cast("double") for n, x in zip(names, q)})


def psi_edges(ref: DataFrame, col: str, bins: int = 10) -> Column:
    """Quantile edges of the reference (0, 10, ..., 100 %), de-duplicated, as a literal array of at most
    ``bins + 1`` numbers (higher-order functions cannot hold subqueries)."""
    edges = exact_percentiles(ref, col, [i / bins for i in range(bins + 1)]) or []
    return _edge_literal(edges)


def _edge_literal(edges: Sequence[float]) -> Column:
    distinct = sorted(set(edges))
    return F.array(*[F.lit(float(e)) for e in distinct]) if distinct else F.array().cast("array<double>")


def _bucket(x: Column, edges: Column) -> Column:
    """np.histogram bin of x for sorted edges: [e_i, e_i+1), last bin closed, outside -> null."""
    nb = F.size(edges) - 1
    last = F.element_at(edges, -1)
    idx = F.size(F.filter(edges, lambda e: e <= x)) - 1
    return (F.when(x.isNull() | (x < F.element_at(edges, 1)) | (x > last), None)
             .when(x == last, nb - 1).otherwise(idx))


def psi(ref: DataFrame, cur: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """L02 (D14 histogram on quantile edges): population stability index of ``cur`` against ``ref``. One row."""
    return _psi_of(_both_counts(ref, cur, col), bins)


def _both_counts(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """(v, a, b, cum_a, cum_b): counts of every value in both samples and their running sums, written once."""
    both = (ref.select(F.col(col).cast("double").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(cur.select(F.col(col).cast("double").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    counts = both.where(F.col("v").isNotNull()).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return cut_lineage(running_sums(counts, "v", ["a", "b"]))


def _totals(counts: DataFrame) -> tuple[int, int]:
    n1, n2 = counts.agg(F.max("cum_a"), F.max("cum_b")).first()
    return int(n1 or 0), int(n2 or 0)


def _psi_of(counts: DataFrame, bins: int) -> DataFrame:
    """Shares are bucket counts / (n + 1e-8) (values outside the reference range stay in n), floored at 1e-6;
    PSI = sum((c - r) * ln(c / r)); fewer than 2 distinct edges, or an empty sample, -> 0."""
    n_ref, n_cur = _totals(counts)
    found = _order_statistics(counts, "a", n_ref, [i / bins for i in range(bins + 1)]) if n_ref and n_cur else {}
    edges = _edge_literal(list(found.values()))
    if len(set(found.values())) < 2:
        return counts.sparkSession.range(1).select(F.lit(0.0).alias("psi"))
    per = (counts.select(_bucket(F.col("v"), edges).alias("b_no"), "a", "b").where(F.col("b_no").isNotNull())
           .groupBy("b_no").agg(F.sum("a").alias("r"), F.sum("b").alias("c")))
    every = counts.sparkSession.range(len(set(found.values())) - 1).withColumnRenamed("id", "b_no")
    t = every.join(per, "b_no", "left")
    rp = F.greatest(F.coalesce(F.col("r"), F.lit(0)) / F.lit(n_ref + EPS), F.lit(PSI_SHARE_FLOOR))
    cp = F.greatest(F.coalesce(F.col("c"), F.lit(0)) / F.lit(n_cur + EPS), F.lit(PSI_SHARE_FLOOR))
    return t.agg(F.coalesce(F.sum((cp - rp) * F.log(cp / rp)), F.lit(0.0)).alias("psi"))


def kolmogorov_p(lam: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p = 2 * sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lam^2), in [0, 1]; 1 for lam < 0.2."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def ks_two_sample(ref: DataFrame, cur: DataFrame, col: str, exact_up_to: int = EXACT_KS) -> DataFrame:
    """D = max |F_ref(v) - F_cur(v)| over all observed values and its p-value: exact for samples of at most
    ``exact_up_to`` values, else asymptotic with lambda = D * sqrt(n1 n2 / (n1 + n2)) (A-12). One row: ``ks_d``, ``ks_p_value``; an empty
    sample shows no difference (0, 1)."""
    return _ks_of(_both_counts(ref, cur, col), exact_up_to)


def _ks_of(counts: DataFrame, exact_up_to: int = EXACT_KS) -> DataFrame:
    n1, n2 = (float(n) for n in _totals(counts))  # doubles: n1 * n2 overflows a long at scale
    if not n1 or not n2:
        return counts.sparkSession.range(1).select(F.lit(0.0).alias("ks_d"), F.lit(1.0).alias("ks_p_value"))
    d = counts.agg(F.max(F.abs(F.col("cum_a") / n1 - F.col("cum_b") / n2)).alias("ks_d"))
    if max(n1, n2) <= exact_up_to:
        return d.select("ks_d", exact_ks_p("ks_d", F.lit(int(n1)), F.lit(int(n2))).alias("ks_p_value"))
    return d.select("ks_d", kolmogorov_p(F.col("ks_d") * math.sqrt(n1 * n2 / (n1 + n2))).alias("ks_p_value"))


@cache
def _exact_ks(h: int, n1: int, n2: int) -> float:
    """P(D >= h / lcm(n1, n2)) of two samples of one continuous law: a random lattice path from (0, 0) to (n1, n2) is
    followed along its diagonals, with the probability of every point that no earlier point reached h."""
    scale = math.lcm(n1, n2)
    if h <= 0:
        return 1.0
    s1, s2, total = scale // n1, scale // n2, n1 + n2
    inside = np.zeros(n1 + 1)  # by the number i of steps in the first sample
    inside[0] = 1.0
    for k in range(1, total + 1):
        lo, hi = max(0, k - n2), min(n1, k)
        i = np.arange(lo, hi + 1)
        left = total - k + 1
        stay = inside[lo:hi + 1] * ((n2 - (k - 1 - i)) / left)  # the step was in the second sample
        step = np.zeros(len(i))
        step[i > 0] = (inside[i[i > 0] - 1]) * ((n1 - i[i > 0] + 1) / left)
        now = np.zeros(n1 + 1)
        now[lo:hi + 1] = np.where(np.abs(i * s1 - (k - i) * s2) < h, np.where(k - i > 0, stay, 0) + step, 0)
        inside = now
    return float(min(1.0, max(0.0, 1.0 - inside[n1])))


@F.pandas_udf(T.DoubleType())
def exact_ks_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([_exact_ks(round(x * math.lcm(int(a), int(b))), int(a), int(b)) for x, a, b in zip(d, n1, n2)], dtype="float64")


def ks_by_key(ref: DataFrame, cur: DataFrame, keys: Sequence[str], col: str, exact_up_to: int = EXACT_KS) -> DataFrame:
    """L03 per key: n1, n2, D and its p-value, exact where both samples have at most ``exact_up_to`` values (as for
    continuous data, so conservative with ties), asymptotic beyond. Keys that one sample lacks show no
    difference (0, 1). A key's distinct values are read in order by one task, a row at a time."""
    keys = list(keys)
    both = (ref.select(*keys, F.col(col).cast("double").alias("_v"), F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(cur.select(*keys, F.col(col).cast("double").alias("_v"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    counts = both.where(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    by = Window.partitionBy(*keys)
    upto = by.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumns({"_a": F.sum("a").over(upto), "_b": F.sum("b").over(upto), "n1": F.sum("a").over(by), "n2": F.sum("b").over(by)})
    gap = F.abs(F.try_divide(F.col("_a"), F.col("n1")) - F.try_divide(F.col("_b"), F.col("n2")))
    found = run.groupBy(*keys).agg(F.max("n1").cast("int").alias("n1"), F.max("n2").cast("int").alias("n2"),
                                   F.coalesce(F.max(gap), F.lit(0.0)).alias("ks_d"))
    small = (F.col("n1") <= exact_up_to) & (F.col("n2") <= exact_up_to)
    some = (F.col("n1") > 0) & (F.col("n2") > 0)
    root = F.sqrt(F.col("n1").cast("double") * F.col("n2") / (F.col("n1") + F.col("n2")))
    exact = exact_ks_p("ks_d", F.when(small & some, F.col("n1")).otherwise(1), F.when(small & some, F.col("n2")).otherwise(1))
    return found.select(*keys, "n1", "n2", "ks_d", F.when(~some, 1.0).when(small, exact).otherwise(
        kolmogorov_p(F.col("ks_d") * root)).alias("ks_p_value"))


def reference_current(df: DataFrame, frac: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """reference = first ``frac`` of the rows in date order, current = the rest (E23 cut-off)."""
    from skucast.operators.features import split_fraction
    s = split_fraction(df, frac)
    return s.where("is_train").drop("is_train"), s.where("NOT is_train").drop("is_train")


def detect_drift(ref: DataFrame, cur: DataFrame, col: str = "sales", thr_psi: float = PSI_THRESHOLD,
                 thr_ks: float = KS_THRESHOLD, bins: int = 10, exact_up_to: int = EXACT_KS) -> DataFrame:
    """One-row drift report: drift = PSI > thr OR KS p < thr OR relative mean change > 0.3,
    plus std change and rounded reference / current means.

    Each sample is read twice: by one aggregate (mean, std) and into one table of value counts with
    running sums, from which quantile edges, histogram and KS are read. An empty sample shows no drift."""
    rm, rsd = ref.agg(F.avg(col), F.stddev_samp(col)).first()
    cm, csd = cur.agg(F.avg(col), F.stddev_samp(col)).first()
    counts = _both_counts(ref, cur, col)
    p = _psi_of(counts, bins).first()[0]
    ks = _ks_of(counts, exact_up_to)
    mean_ch = abs(cm - rm) / (rm + EPS) if rm is not None and cm is not None else 0.0
    std_ch = abs(csd - rsd) / (rsd + EPS) if rsd is not None and csd is not None else 0.0
    return ks.select(
        ((F.lit(p) > thr_psi) | (F.col("ks_p_value") < thr_ks) | F.lit(mean_ch > MEAN_CHANGE_THRESHOLD))
        .alias("drift_detected"),
        F.round(F.lit(p), 4).alias("psi"),
        F.round("ks_p_value", 4).alias("ks_p_value"),
        F.round(F.lit(mean_ch * 100), 2).alias("mean_change_pct"),
        F.round(F.lit(std_ch * 100), 2).alias("std_change_pct"),
        F.round(F.lit(rm).cast("double"), 3).alias("ref_mean"),
        F.round(F.lit(cm).cast("double"), 3).alias("curr_mean"),
        F.lit(thr_psi).alias("threshold_psi"),
        F.lit(thr_ks).alias("threshold_ks"))


def is_stale(registry: DataFrame, now_ts, hours: float = STALE_HOURS, by: tuple = ("model",)) -> DataFrame:
    """Per model, stale unless some artifact was trained less than ``hours`` before ``now_ts``
    (registry columns: model, trained_at timestamp)."""
    now = F.lit(now_ts).cast("timestamp_ntz") if isinstance(now_ts, str) else F.lit(now_ts)
    age_h = F.timestamp_diff("SECOND", F.col("trained_at"), now) / 3600.0
    return registry.groupBy(*by).agg((~F.bool_or(age_h < hours)).alias("is_stale"),
                                     F.max("trained_at").alias("last_trained_at"))


def retrain_plan(drift: DataFrame, staleness: DataFrame, force: bool = False) -> DataFrame:
    """Per model, retrain = force OR drift detected OR stale. ``drift`` is the one-row L04 report
    (used as a scalar), ``staleness`` the L06 table."""
    d = drift.select("drift_detected").scalar()
    return staleness.withColumn("drift_detected", d).withColumn(
        "retrain", F.lit(force) | F.col("drift_detected") | F.col("is_stale"))
