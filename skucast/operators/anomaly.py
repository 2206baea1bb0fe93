"""Anomaly and disruption detection (survey M01-M07, D12, D13, J02).

Per-series statistics are grouped aggregates joined back (skew-safe); the isolation forest is
the one grouped-map Python kernel (``applyInPandas`` per series, Arrow batches), fed with
features that Spark computes first. A series has one row per day, so each group is bounded by
the calendar length, never by the table size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skucast.functions.ranking import grouped_percentiles, join_by_keys
from skucast.schema import EPS, KEYS

ANOMALY_FEATURES = ["sales", "lag1", "lag7", "roll_mean_7", "roll_std_7", "zscore", "change", "pct_change",
                    "day_of_week", "month"]
# Detector defaults.
Z_THRESHOLD, IQR_MULT = 3.0, 3.0
CONTAMINATION, N_TREES, MAX_SAMPLES = 0.05, 100, 256
PRIME = 2**31 - 1


def anomaly_features(df: DataFrame, keys: Sequence[str] = KEYS, col: str = "sales") -> DataFrame:
    """Sales, lag 1 / 7, 7-row mean and std (ddof 1) including the current row, rolling
    z-score (s - m) / (sd + 1e-8), change and relative change vs the previous row, weekday, month;
    nulls -> 0."""
    w = Window.partitionBy(*keys).orderBy("date")
    fr = w.rowsBetween(-6, 0)
    prev = F.lag(col, 1).over(w)
    t = df.withColumns({
        "lag1": F.lag(col, 1).over(w),
        "lag7": F.lag(col, 7).over(w),
        "roll_mean_7": F.avg(col).over(fr),
        "roll_std_7": F.coalesce(F.stddev_samp(col).over(fr), F.lit(0.0)),
        "change": F.coalesce(F.col(col) - prev, F.lit(0.0)),
        "pct_change": F.coalesce((F.col(col) - prev) / (F.abs(prev) + F.lit(EPS)), F.lit(0.0)),
        "day_of_week": F.weekday("date"),
        "month": F.month("date"),
    })
    t = t.withColumn("zscore", (F.col(col) - F.col("roll_mean_7")) / (F.col("roll_std_7") + F.lit(EPS)))
    return t.fillna(0, ["lag1", "lag7"])


def stat_anomaly(df: DataFrame, keys: Sequence[str] = KEYS, col: str = "sales", z: float = Z_THRESHOLD,
                 k: float = IQR_MULT) -> DataFrame:
    """Per key |z| > 3 with the population std (+1e-8) OR outside [Q1 - 3 IQR, Q3 + 3 IQR]."""
    keys = list(keys)
    st = df.groupBy(*keys).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    st = join_by_keys(st, grouped_percentiles(df, keys, col, {"_q1": 0.25, "_q3": 0.75}), keys)
    t = df.join(st, keys, "left")
    q1, q3 = F.col("_q1"), F.col("_q3")
    iqr = q3 - q1
    zz = F.abs((F.col(col) - F.col("_m")) / (F.col("_s") + F.lit(EPS)))
    flag = (zz > z) | (F.col(col) < q1 - k * iqr) | (F.col(col) > q3 + k * iqr)
    return t.withColumn("stat_anomaly", flag).drop("_m", "_s", "_q1", "_q3")


# ---------------------------------------------------------------- M02: isolation forest
def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n > 2:
        return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n
    return 1.0 if n == 2 else 0.0


def _c_vec(n: np.ndarray) -> np.ndarray:
    n = n.astype(float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + 0.5772156649015329) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def series_seed(key: str) -> int:
    """A number of a series' key: its characters as digits of base 31, modulo ``PRIME``."""
    x = 1
    for c in key:
        x = (x * 31 + ord(c)) % PRIME
    return x


def drawn(seed: int, *counters) -> np.ndarray:
    """Random numbers in [0, PRIME) that depend on nothing but the seed and the counters (arrays or numbers): a
    quadratic map takes in one counter a step, and two zeros at the end."""
    x = np.asarray(seed, np.int64)
    for c in (*counters, 0, 0):
        x = (x * x + 48271 * x + np.asarray(c, np.int64) + 11) % PRIME
    return x


def isolation_scores(X: np.ndarray, seed: int, n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES,
                     contamination: float = CONTAMINATION) -> tuple[np.ndarray, np.ndarray]:
    """Isolation forest on X: returns (decision, is_anomaly); decision is the score minus its ``contamination``
    percentile, lower = more anomalous.

    All trees grow together, one level per step: points are grouped by (tree, node), per-group feature ranges come
    from sorted ``reduceat``, each group that can be split takes one of its features that vary and a threshold. All
    draws are counter-based (``drawn``: seed, tree, and row, or node and feature), so the same forest can be grown as
    tables. Path lengths are added up in whole millionths, so the flags do not depend on the order of the sums.
    Splits do not depend on the scale of a feature, so X is used as it is."""
    n, nf = X.shape
    psi = min(max_samples, n)
    limit = int(np.ceil(np.log2(max(psi, 2)) - 1e-9))
    width = 2 ** (limit + 1) - 1  # heap-indexed nodes per tree
    feat = np.zeros((n_trees, width), dtype=np.int64)
    thr = np.zeros((n_trees, width))
    leaf = np.ones((n_trees, width), dtype=bool)
    size = np.zeros((n_trees, width))
    tree = np.repeat(np.arange(n_trees), psi)
    row = np.argsort(drawn(seed, np.arange(n_trees)[:, None], np.arange(n)[None, :]), axis=1, kind="stable")[:, :psi].ravel()
    node = np.zeros(tree.size, dtype=np.int64)
    for depth in range(limit + 1):
        if tree.size == 0:
            break
        key = tree * width + node
        order = np.argsort(key, kind="stable")
        key, tree, node, row = key[order], tree[order], node[order], row[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[starts, key.size])
        g_tree, g_node = tree[starts], node[starts]
        size[g_tree, g_node] = counts
        vals = X[row]
        lo = np.minimum.reduceat(vals, starts, axis=0)
        hi = np.maximum.reduceat(vals, starts, axis=0)
        can = (hi > lo) & (counts[:, None] > 1)
        split = can.any(axis=1) & (depth < limit)
        pick = np.argmax(np.where(can, drawn(seed, g_tree[:, None], g_node[:, None], np.arange(1, nf + 1)[None, :]) * 16 + np.arange(nf), -1), axis=1)
        at = np.arange(len(starts))
        t = lo[at, pick] + (drawn(seed, g_tree, g_node, 100) + 0.5) / PRIME * (hi[at, pick] - lo[at, pick])
        feat[g_tree[split], g_node[split]] = pick[split]
        thr[g_tree[split], g_node[split]] = t[split]
        leaf[g_tree[split], g_node[split]] = False
        gid = np.repeat(np.arange(len(starts)), counts)
        keep = split[gid]
        go_left = vals[np.arange(row.size), pick[gid]] < t[gid]
        node = np.where(go_left, 2 * node + 1, 2 * node + 2)
        tree, node, row = tree[keep], node[keep], row[keep]
    # score every point in every tree
    cur = np.zeros((n_trees, n), dtype=np.int64)
    depth_at = np.zeros((n_trees, n))
    tix = np.arange(n_trees)[:, None]
    for depth in range(limit + 1):
        is_leaf = leaf[tix, cur]
        if is_leaf.all():
            break
        f = feat[tix, cur]
        x = X[np.arange(n)[None, :], f]
        nxt = np.where(x < thr[tix, cur], 2 * cur + 1, 2 * cur + 2)
        cur = np.where(is_leaf, cur, nxt)
        depth_at = np.where(is_leaf, depth_at, depth_at + 1)
    path = np.round(1e6 * (depth_at + _c_vec(size[tix, cur]))).astype(np.int64).sum(axis=0)
    score = -np.power(2.0, -path / (1e6 * n_trees) / _c(psi))
    return score - np.percentile(score, 100.0 * contamination), path < np.percentile(path, 100.0 * contamination)


def _forest(pdf: pd.DataFrame, keys: list[str], feats: list[str], n_trees: int, contamination: float):
    """(score, flag) of one series in date order; missing features count as 0."""
    if len(pdf) < 2:
        return 0.0, False
    seed = series_seed("|".join(str(pdf[k].iloc[0]) for k in keys))
    return isolation_scores(np.nan_to_num(pdf[feats].to_numpy(dtype=float)), seed, n_trees, MAX_SAMPLES, contamination)


def isolation_forest(df: DataFrame, keys: Sequence[str] = KEYS, features: Sequence[str] = ANOMALY_FEATURES,
                     contamination: float = CONTAMINATION, n_trees: int = N_TREES) -> DataFrame:
    """Per-series isolation forest (grouped map). Adds ``if_score`` (lower = more anomalous) and
    ``if_anomaly``; the seed is a number of the series key, so results do not depend on partitioning
    or on task retries. Series of fewer than 2 rows get False / 0.0 (A-13); any other failure fails the job."""
    keys = list(keys)
    feats = list(features)
    slim = df.select(*keys, "date", *[F.col(c).cast("double").alias(c) for c in feats])
    key_types = ", ".join(f"{k} string" for k in keys)
    schema = f"{key_types}, date date, if_score double, if_anomaly boolean"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        out = pdf[keys + ["date"]].copy()
        out["if_score"], out["if_anomaly"] = _forest(pdf, keys, feats, n_trees, contamination)
        return out

    # Explicit hash partitioning on the series key: the groups are CPU-heavy, and an explicit count
    # keeps adaptive execution from coalescing the small input into a few tasks; groupBy on the
    # same keys reuses this partitioning (no second shuffle).
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return slim.repartition(n, *keys).groupBy(*keys).applyInPandas(fit, schema)


def _stat_flags(s: np.ndarray, z: float = Z_THRESHOLD, k: float = IQR_MULT) -> np.ndarray:
    """M03 on one series in numpy (population std, linear percentiles), as in the grouped map."""
    zz = np.abs((s - s.mean()) / (s.std() + EPS))
    q1, q3 = np.percentile(s, [25, 75])
    return (zz > z) | (s < q1 - k * (q3 - q1)) | (s > q3 + k * (q3 - q1))


def detect_anomalies(df: DataFrame, keys: Sequence[str] = KEYS, with_forest: bool = True,
                     n_trees: int = N_TREES) -> DataFrame:
    """stat_anomaly (M03) OR if_anomaly (M02, J02 grouped map) -> is_anomaly, one row per input row.

    With the forest, one grouped map per series computes both detectors (the statistical one is a
    few numpy reductions over the series already in memory), so no result is joined back: one
    exchange for the feature windows and one explicit repartition on the series key. Without the
    forest, the statistical detector runs as grouped aggregates in the JVM."""
    keys = list(keys)
    if not with_forest:
        t = stat_anomaly(df, keys).withColumns({"if_score": F.lit(0.0), "if_anomaly": F.lit(False)})
        return t.withColumn("is_anomaly", F.col("stat_anomaly") | F.col("if_anomaly"))
    feats = list(ANOMALY_FEATURES)
    # rounded, so that sums made in another order give the same splits
    slim = anomaly_features(df, keys).select(*keys, "date", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in feats])
    schema = (", ".join(f"{k} string" for k in keys) + ", date date, sales double, stat_anomaly boolean, "
              "if_score double, if_anomaly boolean, is_anomaly boolean")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        out = pdf[keys + ["date", "sales"]].copy()
        out["stat_anomaly"] = _stat_flags(pdf["sales"].to_numpy(dtype=float))
        out["if_score"], out["if_anomaly"] = _forest(pdf, keys, feats, n_trees, CONTAMINATION)
        out["is_anomaly"] = out["stat_anomaly"] | out["if_anomaly"]
        return out

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return slim.repartition(n, *keys).groupBy(*keys).applyInPandas(run, schema)


def anomaly_summary(flagged: DataFrame, key: str = "sku_id") -> DataFrame:
    """Total points, anomalies, rate % (2 dp), SKUs with at least one anomaly."""
    per = flagged.groupBy(key).agg(F.bool_or("is_anomaly").alias("_any"), F.count(F.lit(1)).alias("_n"),
                                   F.sum(F.col("is_anomaly").cast("long")).alias("_a"))
    return per.agg(F.sum("_n").alias("total_points"), F.sum("_a").alias("anomalies_found"),
                   F.round(F.sum("_a") / F.sum("_n") * 100, 2).alias("anomaly_rate"),
                   F.count_if("_any").alias("skus_with_anomalies"))


def anomaly_report(flagged: DataFrame, key: str = "sku_id") -> DataFrame:
    """Per SKU with >= 1 anomaly: count, first and last anomaly date, counts by type.
    The dates and values themselves are the long table of ``anomaly_points`` (one row each), so a
    SKU with very many anomalies never becomes one huge list in one task."""
    a = flagged.where("is_anomaly")
    return a.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_anomalies"),
        F.min("date").alias("first_anomaly"),
        F.max("date").alias("last_anomaly"),
        F.count_if("stat_anomaly").alias("n_statistical"),
        F.count_if("if_anomaly").alias("n_isolation_forest"),
    )


def anomaly_points(flagged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every anomalous point (date as yyyy-MM-dd, value, which detector fired), long form."""
    return flagged.where("is_anomaly").select(*keys, F.date_format("date", "yyyy-MM-dd").alias("date"),
                                              F.col("sales").alias("value"), "stat_anomaly", "if_anomaly")


def zero_runs(df: DataFrame, min_len: int = 3, keys: Sequence[str] = KEYS, include_open: bool = False,
              col: str = "sales") -> DataFrame:
    """Runs of >= ``min_len`` consecutive zero rows per series -> (start, length_days).

    Gaps and islands: island id = running count of non-zero rows; a run is closed when a later
    non-zero row exists (island id below the series maximum). Open trailing runs are dropped
    unless ``include_open`` (A-14). Use on a densified panel (K01)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    # same partitioning for both windows: one exchange; the series maximum marks the open run
    t = (df.withColumn("_island", F.sum((F.col(col) != 0).cast("int")).over(w))
           .withColumn("_max_island", F.max("_island").over(Window.partitionBy(*keys))))
    runs = (t.where(F.col(col) == 0).groupBy(*keys, "_island")
             .agg(F.min("date").alias("start"), F.count(F.lit(1)).alias("length_days"),
                  F.max("_max_island").alias("_max_island")))
    runs = runs.withColumn("is_open", F.col("_island") == F.col("_max_island"))
    runs = runs.where(F.col("length_days") >= min_len)
    if not include_open:
        runs = runs.where(~F.col("is_open"))
    return runs.drop("_island", "_max_island")
