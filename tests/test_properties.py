"""Property tests on the driver tables (sf0.001)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skucast.operators import anomaly, drift, features, forecast, graph, panel
from skucast.sources.tables import demand_panel
from tests.conftest import SF001

KEYS = ["sku_id", "store_id"]


@pytest.fixture(scope="module")
def p(spark):
    return demand_panel(spark, SF001).cache()


def test_panel_key_unique(p):
    assert p.groupBy(*KEYS, "date").count().where("count > 1").count() == 0
    assert p.where("sales < 0 OR sales IS NULL").count() == 0


def test_lag_lead_inverse(p):
    w = features.series_window(KEYS)
    t = p.withColumn("l", F.lag("sales", 3).over(w)).withColumn("back", F.lead("l", 3).over(w))
    assert t.where("back IS NOT NULL AND back != sales").count() == 0


def test_ks_equal_samples_zero(p):
    r = drift.ks_two_sample(p, p, "sales").first()
    assert r.ks_d == 0.0 and r.ks_p_value == 1.0


def test_forecast_shape_and_band(p):
    d = panel.densify(panel.daily_series(p), ["sku_id"])
    fc = forecast.forecast_all(d, 14, ("trend_naive",))
    n_sku = p.select("sku_id").distinct().count()
    assert fc.count() == n_sku * 14
    assert fc.where("NOT (lo <= yhat AND yhat <= hi) OR yhat < 0").count() == 0


def test_summary_of_gap_free_series_equals_the_ranked_one(spark, p):
    """Short, long, undated, null and leap-day series: the same summary, without a sort of the daily rows."""
    starts = {"one": (1, 3), "eight": (8, 5), "w27": (27, 2), "w28": (28, 2), "w29": (29, 9), "long": (400, 40)}
    rows = [(k, (i * 7 + n) % 13 * 1.5, at + i) for k, (n, at) in starts.items() for i in range(n)]
    rows += [("undated", 4.0, None), ("nulls", None, 1), ("nulls", 3.0, 2), ("nulls", None, 3)]
    daily = spark.createDataFrame(rows, "sku_id string, sales double, d int").select(
        "sku_id", F.date_add(F.lit("2019-12-30").cast("date"), "d").alias("date"), "sales")
    got, want = ({r.sku_id: r.asDict() for r in forecast.series_summary(daily, gap_free=free).collect()} for free in (True, False))
    assert got.keys() == want.keys() == {*starts, "undated", "nulls"}
    for k, row in want.items():
        for c, v in row.items():
            assert got[k][c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (k, c)
    dense = panel.densify(panel.daily_series(p), ["sku_id"])
    plan = forecast.series_summary(dense, gap_free=True)._jdf.queryExecution().executedPlan().toString()
    after = plan[:plan.index("Generate posexplode")]  # what is done to the daily rows
    assert after.count("Sort [") == 1 and after.rindex("HashAggregate(keys=[sku_id") > after.index("Sort [") and "Exchange" not in after


def test_edges_symmetric(p):
    e = graph.correlation_edges(p, 0.0, fallback=False)
    a = {(r.src, r.dst, round(r.weight, 12)) for r in e.collect()}
    assert a and all((d, s, w) in a for s, d, w in a)


def test_gram_matches_pairwise(p):
    """Blocked Gram (block 4, several blocks) equals a direct per-date computation."""
    e_small = graph.correlation_edges(p, 0.0, block=4, fallback=False)
    e_big = graph.correlation_edges(p, 0.0, block=256, fallback=False)
    a = {(r.src, r.dst): r.weight for r in e_small.collect()}
    b = {(r.src, r.dst): r.weight for r in e_big.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_isolation_forest_rate_and_spike(spark, p):
    s = p.where((F.col("sku_id") == "PROMO_1_001") & (F.col("store_id") == "ASIA")).select(*KEYS, "date", "sales")
    last = s.agg(F.max("date")).first()[0]
    spiked = s.withColumn("sales", F.when(F.col("date") == last, F.lit(10000.0)).otherwise(F.col("sales")))
    out = anomaly.detect_anomalies(spiked, KEYS, with_forest=True).collect()
    flags = [r for r in out if r.if_anomaly]
    assert 0 < len(flags) <= max(1, round(0.05 * len(out)) + 1)
    assert any(r.date == last for r in flags) and any(r.date == last and r.stat_anomaly for r in out)


def test_isolation_forest_deterministic(p):
    f = anomaly.isolation_forest(anomaly.anomaly_features(p.select(*KEYS, "date", "sales")), KEYS, n_trees=20)
    a = sorted((r.sku_id, r.store_id, r.date, r.if_score) for r in f.collect())
    b = sorted((r.sku_id, r.store_id, r.date, r.if_score) for r in f.repartition(3).collect())
    assert a == b


def test_global_index_is_the_sorted_position(spark):
    from skucast.functions.ranking import global_index
    keys = spark.range(5000).select((F.col("id") * 7919 % 100003).cast("string").alias("k")).distinct()
    got = {r.k: r.i for r in global_index(keys, "k", "i").collect()}
    assert sorted(got.values()) == list(range(5000))
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got)


def test_edges_match_pandas_pivot_corr(p):
    """Weights equal pandas' pivot_table(mean).fillna(0).corr() for every pair (threshold 0)."""
    pdf = p.select("sku_id", "date", "sales").toPandas()
    piv = pdf.pivot_table(index="date", columns="sku_id", values="sales", aggfunc="mean").fillna(0)
    want = piv.corr()
    e = graph.correlation_edges(p, 0.0, block=5, fallback=False).collect()
    assert len(e) == len(want) * (len(want) - 1)
    assert all(abs(r.weight - want.loc[r.src_sku, r.dst_sku]) < 1e-9 for r in e)


def test_stat_flags_numpy_equals_jvm(p):
    """The in-map statistical detector equals the JVM one (M03) on every series."""
    fl = anomaly.detect_anomalies(p.select(*KEYS, "date", "sales"), KEYS, with_forest=True, n_trees=5)
    jvm = anomaly.stat_anomaly(p.select(*KEYS, "date", "sales"), KEYS)
    a = {(r.sku_id, r.store_id, r.date): r.stat_anomaly for r in fl.collect()}
    b = {(r.sku_id, r.store_id, r.date): r.stat_anomaly for r in jvm.collect()}
    assert a == b and any(b.values())


def test_exact_ks_equals_enumeration():
    """Every way to mix two samples of up to 8 values."""
    import itertools
    import math
    for n1, n2 in [(1, 1), (2, 5), (3, 3), (4, 7), (8, 8), (6, 8)]:
        scale, seen = math.lcm(n1, n2), {}
        for places in itertools.combinations(range(n1 + n2), n1):
            mine, i, most = set(places), 0, 0
            for k in range(n1 + n2):
                i += k in mine
                most = max(most, abs(i * scale // n1 - (k + 1 - i) * scale // n2))
            seen[most] = seen.get(most, 0) + 1
        total = sum(seen.values())
        for h in seen:
            want = sum(c for d, c in seen.items() if d >= h) / total
            assert abs(drift._exact_ks(h, n1, n2) - want) < 1e-12


def test_ks_by_key_small_large_and_missing(spark):
    ref = spark.createDataFrame([("a", float(i)) for i in range(5)] + [("b", 1.0)] + [("c", float(i)) for i in range(30)], "k string, v double")
    cur = spark.createDataFrame([("a", float(i) + 10) for i in range(5)] + [("c", float(i)) for i in range(30)] + [("b", None)], "k string, v double")
    got = {r.k: (r.n1, r.n2, r.ks_d, round(r.ks_p_value, 9)) for r in drift.ks_by_key(ref, cur, ["k"], "v").collect()}
    assert got == {"a": (5, 5, 1.0, round(2 / 252, 9)), "b": (1, 0, 0.0, 1.0), "c": (30, 30, 0.0, 1.0)}
    loose = {r.k: r.ks_p_value for r in drift.ks_by_key(ref, cur, ["k"], "v", exact_up_to=4).collect()}
    assert loose["c"] == 1.0 and abs(loose["a"] - 2 / 252) < 0.01


def test_the_complete_graph_stays_implied(spark):
    """30,000 nodes and no edge: relation, degrees and sums have a row a node."""
    nodes = spark.range(30_000).select(F.col("id").cast("int").alias("node"), F.col("id").cast("string").alias("sku_id"), (F.col("id") * 1.0).alias("x"))
    none = spark.createDataFrame([], "src int, dst int, src_sku string, dst_sku string, weight double")
    g = graph.Graph(nodes.select("node", "sku_id"), none, True)
    assert g.relation().count() == 30_000 and g.degrees().where("degree = 29999").count() == 30_000
    total = 29_999 * 30_000 / 2
    assert g.neighbour_sums(nodes, ["x"]).where(F.abs(F.col("x") - (total - F.col("node"))) < 1e-6).count() == 30_000
    few = graph.complete_graph(nodes.where("node < 5").select("node", "sku_id"))
    small = graph.Graph(nodes.where("node < 5"), few, False), graph.Graph(nodes.where("node < 5"), none, True)
    for a, b in zip(*[(x.degrees(), x.neighbour_sums(nodes.where("node < 5"), ["x"])) for x in small]):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_correlation_query_has_every_edge_where_no_pair_passes(spark, monkeypatch):
    from skucast.plans import catalog_analytics as queries
    days = [("a", 1, 5.0), ("a", 2, 1.0), ("b", 3, 4.0), ("c", 5, 2.0), ("d", 6, 2.0)]
    tiny = spark.createDataFrame(days, "sku_id string, day int, sales double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), "day"))
    monkeypatch.setattr(queries, "panel", lambda spark, sf, reuse=False: tiny)
    rows = queries.q_edges(spark, "").collect()
    assert sorted((r.src_sku, r.dst_sku) for r in rows) == sorted((a, b) for a in "abcd" for b in "abcd" if a != b)
    assert {r.weight for r in rows} == {1.0} and all(r.src != r.dst for r in rows)


@pytest.mark.parametrize("share", [0.0, 1 / 16, 1.0])
def test_sparse_and_dense_blocks_give_the_same_correlations(spark, monkeypatch, share):
    """Rare and frequent series, a constant one and one of a single day, in blocks of 4, against numpy; mostly zero
    blocks are packed as their non-zero values."""
    monkeypatch.setattr(graph, "SPARSE", share)
    rng = np.random.default_rng(3)
    n_dates, n = 120, 14
    x = np.where(rng.random((n_dates, n)) < np.where(np.arange(n) < 9, 0.03, 0.7), rng.integers(1, 50, (n_dates, n)), 0).astype(float)
    x[:, 5], x[:, 6], x[:, 11] = 0.0, 0.0, 7.0
    x[17, 6] = 3.0
    rows = [(int(i), int(d), float(x[d, i])) for d, i in zip(*np.nonzero(x))]
    vals = spark.createDataFrame(rows, "node int, d int, x double")
    packed = graph._blocks(vals, n_dates, 4).collect()
    assert any(len(b.u or b"") for b in packed) == (share > 0) and sum(b.z is None for b in packed) >= (4 if share == 1 else 0)
    got = {(r.i, r.j): r.corr for r in graph._corr_blocks(vals, n, n_dates, 4, 0.05).collect()}
    with np.errstate(invalid="ignore"):
        c = np.corrcoef(x.T)
    want = {(i, j): c[i, j] for i in range(n) for j in range(i + 1, n) if abs(c[i, j]) >= 0.05}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12


@pytest.mark.parametrize("n_blocks, side", [(1, 1), (7, 3), (16, 4), (33, 5)])
def test_grid_cells_meet_every_pair_of_blocks_once(spark, n_blocks, side):
    z = spark.range(n_blocks).select(F.col("id").cast("int").alias("blk"))
    dealt = graph.dealt_blocks(z, n_blocks, side)
    assert dealt.count() == n_blocks * (side + 1)  # copies: blocks x side, not blocks squared
    cells = {}
    for r in dealt.collect():
        cells.setdefault((r.r, r.c), ([], []))[r.column].append(r.blk)
    met = sorted((a, b) for rows, cols in cells.values() for a in rows for b in cols if a <= b)
    assert met == [(a, b) for a in range(n_blocks) for b in range(a, n_blocks)]
    assert graph.grid_side(118, 200) == 20 and graph.grid_side(3, 200) == 3 and graph.grid_side(4000, 8) == 500


def test_edges_are_not_stored_on_the_way_and_equal_numpy(spark, monkeypatch):
    """Returns as well as sales, rows without a date, an SKU or sales, in small blocks and many cells."""
    rng = np.random.default_rng(5)
    n_dates, n = 90, 23
    x = np.where(rng.random((n_dates, n)) < 0.05, rng.integers(-9, 30, (n_dates, n)), 0).astype(float)
    x[:, 3] = np.where(rng.random(n_dates) < 0.8, 4.0 + np.arange(n_dates) % 3, 0.0)  # a dense block among sparse ones
    x[0] = np.maximum(x[0], 1.0)
    rows = [(f"s{i:02d}", int(d), float(x[d, i])) for d, i in zip(*np.nonzero(x))] + [("s00", d, None) for d in range(n_dates) if x[d, 0] == 0]
    rows += [(None, 1, 5.0), ("s05", None, 7.0)]
    df = spark.createDataFrame(rows, "sku_id string, day int, sales double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), "day"))
    kept = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df, cut=graph.cut_lineage: kept.append(df.columns) or cut(df))
    monkeypatch.setattr(graph, "HELD", 2)
    monkeypatch.setattr(graph, "HELD_BYTES", 1)
    edges = graph.correlation_edges(df, 0.15, block=4)
    got = {(r.src_sku, r.dst_sku): (r.src, r.dst, r.weight) for r in edges.collect()}
    c = np.corrcoef(np.vstack([x, np.zeros(n)]).T)  # the row without a date counts as one more, of zeros
    want = {(f"s{i:02d}", f"s{j:02d}"): (i + 1, j + 1, c[i, j]) for i in range(n) for j in range(n) if i != j and abs(c[i, j]) >= 0.15}
    assert got.keys() == want.keys() and len(want) > 10 and min(w for _, _, w in want.values()) < 0
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-12 for k in want)
    assert not any("weight" in columns for columns in kept)


def test_small_blocks_are_held_by_their_bytes():
    assert graph.grid_side(4688, 24, held=1000) == 7 and graph.grid_side(4688, 24) == 586
