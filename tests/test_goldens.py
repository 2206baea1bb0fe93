"""Golden values (FIXTURES.md section 3), computed from the formulas by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skucast.operators import anomaly, analytics, drift, features, forecast, metrics, panel, samples, signals


def series(spark, values, sku="A", store="S", start=dt.date(2023, 1, 1)):
    rows = [(sku, store, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "sku_id string, store_id string, date date, sales double")


def test_L01_metrics(spark):
    df = spark.createDataFrame(list(zip([10.0, 20.0, 30.0, 40.0, 50.0], [11.0, 19.0, 31.0, 39.0, 51.0])), "y double, p double")
    r = metrics.evaluate(df, "y", "p").first().asDict()
    assert r == {"MAE": 1.0, "RMSE": 1.0, "MAPE": 4.5667, "WMAPE": 3.3333, "SMAPE": 4.4885, "n_obs": 5}


@pytest.mark.parametrize("model,expected", [
    ("naive", [30.0] * 7),
    ("seasonal_naive", [24.0, 25, 26, 27, 28, 29, 30]),
    ("moving_average", [27.0] * 7),
])
def test_K02_K04_baselines(spark, model, expected):
    s = series(spark, range(1, 31))
    out = forecast.baseline_forecast(s, model, 7).orderBy("h").collect()
    assert [r.yhat for r in out] == expected
    assert all(r.lo <= r.yhat <= r.hi for r in out)


def test_K07_trend_naive(spark):
    out = forecast.baseline_forecast(series(spark, range(1, 31)), "trend_naive", 7).orderBy("h").collect()
    assert [round(r.yhat, 2) for r in out] == [16.5, 17.78, 19.06, 20.33, 21.58, 22.81, 24.01]


def test_K03_short_series_clamps(spark):
    out = forecast.baseline_forecast(series(spark, [5, 6, 7]), "seasonal_naive", 7).orderBy("h").collect()
    # y[max(0, n - 7 + i % 7)] with n = 3
    assert [r.yhat for r in out] == [5.0, 5.0, 5.0, 5.0, 5.0, 6.0, 7.0]


def test_M03_stat_anomaly(spark):
    vals = [10, 11, 10, 12, 9, 10, 100, 10, 11, 10, 9, 11, 10]
    out = anomaly.stat_anomaly(series(spark, vals)).orderBy("date").collect()
    assert [i for i, r in enumerate(out) if r.stat_anomaly] == [6]


def test_M07_zero_runs(spark):
    vals = [0, 0, 0, 5, 0, 0, 1, 0, 0, 0, 0, 2, 0, 0, 0]
    s = series(spark, vals)
    start = dt.date(2023, 1, 1)
    closed = {(r.start, r.length_days) for r in anomaly.zero_runs(s, 3).collect()}
    assert closed == {(start, 3), (start + dt.timedelta(days=7), 4)}
    both = {(r.start, r.length_days) for r in anomaly.zero_runs(s, 3, include_open=True).collect()}
    assert both == closed | {(start + dt.timedelta(days=12), 3)}


def test_E10_price_change(spark):
    rows = [("A", "S", dt.date(2023, 1, 1 + i), 0, float(p)) for i, p in enumerate([0, 0, 2, 0, 3])]
    df = spark.createDataFrame(rows, "sku_id string, store_id string, date date, promo int, price double")
    out = features.promo_features(df).orderBy("date").collect()
    assert [r.price_change_pct for r in out] == [0.0, 0.0, 0.0, -1.0, 0.0]


def test_Q05_risk_band(spark):
    df = spark.createDataFrame([(0.3,), (0.31,), (0.6,), (None,)], "cv double")
    out = [r[0] for r in df.select(analytics.risk_band("cv")).collect()]
    assert out == ["Low", "Medium", "Medium", None]


def test_B05_split_hierarchy(spark):
    df = spark.createDataFrame([("A_1_2",), ("B",)], "sku_id string")
    out = [(r.category, r.dept_id) for r in panel.split_hierarchy(df).collect()]
    assert out == [("A", "A_1"), ("B", "B")]


def test_E01_iso_week(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 3),), (dt.date(2020, 12, 31),)], "date date")
    out = features.date_features(df).collect()
    assert [r.week_of_year for r in out] == [53, 53]
    assert [r.day_of_week for r in out] == [6, 3]


def test_E04_lags(spark):
    out = features.lags(series(spark, range(40)), lag_list=[1, 7]).orderBy("date").collect()
    assert [r.lag_1 for r in out] == [None] + [float(v) for v in range(39)]
    assert [r.lag_7 for r in out] == [None] * 7 + [float(v) for v in range(33)]


def test_E06_rolling_std_first_rows(spark):
    out = features.rolling(series(spark, [3, 8, 1, 4])).orderBy("date").collect()
    assert [out[0].roll_std_7, out[1].roll_std_7] == [0.0, 0.0]
    assert out[0].roll_mean_7 is None and out[1].roll_mean_7 == 3.0


def test_G01_sample_counts(spark):
    rows = [(f"SKU_{k}", f"S{s}", dt.date(2020, 1, 1) + dt.timedelta(days=d), 1.0)
            for k in range(3) for s in range(2) for d in range(200)]
    df = spark.createDataFrame(rows, "sku_id string, store_id string, date date, sales double")
    w = features.series_window(["sku_id", "store_id"])
    warm = df.withColumn("_rn", F.row_number().over(w)).where("_rn > 28").drop("_rn")
    assert samples.multi_horizon(warm, 14, ["sku_id"]).count() == 14133
    assert samples.multi_horizon(warm, 14, ["sku_id", "store_id"]).count() == 13818


def test_L02_psi_identical_is_zero(spark):
    s = series(spark, [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, 11])
    assert drift.psi(s, s, "sales").first()[0] == pytest.approx(0.0, abs=1e-12)


def test_L03_kolmogorov_p(spark):
    df = spark.range(1).select(drift.kolmogorov_p(F.lit(1.36)).alias("p"))
    assert round(df.first().p, 5) == 0.04949


def test_L09_improvement(spark):
    df = spark.range(1).select(metrics.improvement(F.lit(11.6794), F.lit(9.4059)).alias("x"))
    assert df.first().x == 19.47


def test_O01_signal(spark):
    scored = spark.createDataFrame([("d1", "POSITIVE", 1.0), ("d2", "NEGATIVE", 1.0)],
                                   "date string, label string, score double")
    sig = {r.date: r.demand_sentiment for r in signals.sentiment_signal(scored).collect()}
    assert sig == {"d1": pytest.approx(1.3), "d2": pytest.approx(0.7)}
    days = spark.createDataFrame([("d1",), ("d3",)], "date string")
    out = {r.date: r.demand_sentiment for r in signals.enrich_sentiment(days, signals.sentiment_signal(scored)).collect()}
    assert out["d3"] == 1.0


def test_D18_interval_from_samples(spark):
    df = spark.createDataFrame([("A", float(v)) for v in range(1, 41)], "k string, pred double")
    r = metrics.interval_from_samples(df, ["k"]).first()
    # numpy linear interpolation: position (n - 1) * q
    assert r.mean == 20.5 and r.lower == pytest.approx(1 + 39 * 0.025) and r.upper == pytest.approx(1 + 39 * 0.975)


def test_F02_F04_sort_and_top_k(spark):
    df = spark.createDataFrame([("B", "S2", dt.date(2023, 1, 2), 5.0), ("A", "S1", dt.date(2023, 1, 3), 5.0),
                                ("A", "S1", dt.date(2023, 1, 1), 9.0)],
                               "sku_id string, store_id string, date date, sales double")
    assert [(r.sku_id, r.date.day) for r in panel.sort_panel(df).collect()] == [("A", 1), ("A", 3), ("B", 2)]
    top = analytics.top_k(df, "sales", 2).collect()
    assert [(r.sku_id, r.sales) for r in top] == [("A", 9.0), ("A", 5.0)]  # tie on 5.0 broken by sku_id
    low = analytics.top_k(df, "sales", 1, asc=True).collect()
    assert [(r.sku_id, r.sales) for r in low] == [("A", 5.0)]


def test_C06_holidays_2021(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 5),), (dt.date(2022, 3, 1),)], "date date")
    got = {r.date: r.holiday for r in panel.holiday_dim(df).collect() if r.date.year == 2021}
    d = dt.date
    assert got[d(2021, 1, 18)] == "Martin Luther King Jr. Day"
    assert got[d(2021, 2, 15)] == "Washington's Birthday"
    assert got[d(2021, 5, 31)] == "Memorial Day"
    assert got[d(2021, 6, 18)] == "Juneteenth National Independence Day (observed)"  # Saturday -> Friday
    assert got[d(2021, 7, 5)] == "Independence Day (observed)"  # Sunday -> Monday
    assert got[d(2021, 9, 6)] == "Labor Day" and got[d(2021, 10, 11)] == "Columbus Day"
    assert got[d(2021, 11, 25)] == "Thanksgiving"
    assert got[d(2021, 12, 24)] == "Christmas Day (observed)"
    assert got[d(2021, 12, 31)] == "New Year's Day (observed)"  # 2022-01-01 is a Saturday
    marked = panel.add_holidays(spark.createDataFrame([(d(2021, 11, 25),), (d(2021, 11, 26),)], "date date"))
    assert sorted((r.date.day, r.is_holiday) for r in marked.collect()) == [(25, 1), (26, 0)]


def test_C10_pick_forecast_multi_key_and_C07_defaults(spark):
    a = spark.createDataFrame([("A", "S1", 1, 5.0)], "sku_id string, store_id string, h int, yhat double")
    b = spark.createDataFrame([("A", "S1", 1, 7.0), ("A", "S2", 1, 9.0)], "sku_id string, store_id string, h int, yhat double")
    got = sorted((r.store_id, r.yhat) for r in panel.pick_forecast([a, b], ["sku_id", "store_id"]).collect())
    assert got == [("S1", 5.0), ("S2", 9.0)]
    ext = spark.createDataFrame([("S1", 1.5)], "store_id string, web_trend double")
    out = {r.store_id: r.web_trend for r in panel.join_external(b, ext, "store_id", {"web_trend": 1.0}).collect()}
    assert out == {"S1": 1.5, "S2": 1.0}


def test_L02_psi_and_percentiles_from_value_counts(spark):
    import numpy as np
    s = spark.createDataFrame([(float(v % 17),) for v in range(500)], "x double")
    assert drift.psi(s, s, "x").first()[0] == pytest.approx(0.0, abs=1e-12)
    shares = [0.0, 0.1, 0.25, 0.333, 0.95, 1.0]
    want = np.percentile([v % 17 for v in range(500)], [100 * q for q in shares])
    assert drift.exact_percentiles(s, "x", shares) == pytest.approx(list(want))
    none = s.where("x > 99")
    assert drift.exact_percentiles(none, "x", shares) is None
    row = drift.detect_drift(s, none, "x").first()
    assert not row.drift_detected and row.psi == 0 and row.ks_p_value == 1 and row.curr_mean is None
    shifted = s.select((F.col("x") + 5).alias("x"))
    assert drift.psi(s, shifted, "x").first()[0] > 0.2


def test_G03_sequence_samples_match_numpy(spark):
    import numpy as np
    sales = [3.0, 7.0, 1.0, 9.0, 4.0, 6.0, 2.0, 8.0]
    price = [1.0, 1.5, 1.0, 2.0, 2.5, 1.0, 1.5, 2.0]
    rows = [("A", "S", dt.date(2023, 1, 1 + i), s, p) for i, (s, p) in enumerate(zip(sales, price))]
    df = spark.createDataFrame(rows, "sku_id string, store_id string, date date, sales double, price double")
    out = samples.sequence_samples(df, seq_len=3, horizon=2, features=["price"]).orderBy("date").collect()
    s, p = np.array(sales), np.array(price)
    sn = (s - s.min()) / (s.max() - s.min() + 1e-8)
    pz = (p - p.mean()) / (p.std() + 1e-8)
    want = [(np.column_stack([sn[i:i + 3], pz[i:i + 3]]), sn[i + 3 + 2 - 1]) for i in range(len(s) - 3 - 2 + 1)]
    assert len(out) == len(want)
    for r, (x, y) in zip(out, want):
        assert np.allclose(np.array(r.x), x) and abs(r.y - y) < 1e-12
        assert (r.s_min, r.s_max) == (1.0, 9.0)


def test_G04_G05_encdec_window_counts(spark):
    rows = [("A", "S", dt.date(2023, 1, 1) + dt.timedelta(days=i), float(i), 1.0, 0) for i in range(80)]
    df = spark.createDataFrame(rows, "sku_id string, store_id string, date date, sales double, price double, promo int")
    prep = samples.encdec_prepare(df, min_len=60)
    w = samples.encdec_windows(prep, enc=30, dec=14).collect()
    train = sorted(r.time_idx for r in w if r.split == "train")
    val = [r for r in w if r.split == "val"]
    assert train == list(range(15, 53))
    assert len(val) == 1 and val[0].time_idx == 66 and len(val[0].encoder) == 30 and val[0].decoder == [float(v) for v in range(66, 80)]
    short = samples.encdec_prepare(df.where("sales < 50"), min_len=60)
    assert short.count() == 0  # max time_idx 49 < 60


def test_O05_commentary_rules(spark):
    fc = spark.createDataFrame([("UP", 1, 10.0, "m"), ("UP", 2, 12.0, "m"), ("FLAT", 1, 10.0, "m"), ("FLAT", 2, 10.2, "m"),
                                ("DOWN", 1, 10.0, "m"), ("DOWN", 2, 8.0, "m")],
                               "sku_id string, h int, yhat double, model_used string")
    k = spark.createDataFrame([("UP", 0.9), ("FLAT", 0.1), ("DOWN", 0.5)], "sku_id string, cv double")
    out = {r.sku_id: r for r in signals.commentary(fc, k).collect()}
    assert (out["UP"].trend, out["UP"].volatility) == ("increasing", "high")
    assert (out["FLAT"].trend, out["FLAT"].volatility) == ("stable", "low")
    assert (out["DOWN"].trend, out["DOWN"].volatility) == ("decreasing", "low")
    assert "Plan for increased inventory" in out["UP"].commentary and "(2-day horizon)" in out["UP"].commentary
    assert "Avg Forecast: 11.0 units/day" in out["UP"].commentary


def test_Q03_empty_buckets_are_zero(spark):
    rows = [("A", dt.date(2023, 1, 2), 4.0), ("A", dt.date(2023, 1, 9), 6.0)]  # two Mondays in January
    df = spark.createDataFrame(rows, "sku_id string, date date, sales double")
    out = {(r.profile, r.bucket): r.avg_sales for r in analytics.seasonality(df).collect()}
    assert len(out) == 19 and out[("weekday", "Monday")] == 5.0 and out[("month", "Jan")] == 5.0
    assert out[("weekday", "Sunday")] == 0.0 and out[("month", "Dec")] == 0.0


def test_L10_pinball_and_multitask(spark):
    df = spark.createDataFrame([(10.0, 8.0, 12.0, 3.0, 1.0)], "y double, q50 double, q90 double, a double, ap double")
    r = metrics.multitask_loss(df, "y", {0.5: "q50", 0.9: "q90"}, "a", "ap").first()
    assert r.pinball_q50 == pytest.approx(1.0) and r.pinball_q90 == pytest.approx(0.2)  # max(.9*-2, -.1*-2)
    assert r.pinball == pytest.approx(0.6) and r.aux_mse == pytest.approx(4.0)
    assert r.multitask_loss == pytest.approx(0.7 * 0.6 + 0.3 * 4.0)


def test_N04_propagate_two_nodes(spark):
    from skucast.operators import graph
    nodes = spark.createDataFrame([(0, 2.0), (1, 6.0)], "node int, mean double")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src int, dst int, weight double")
    # self loops -> degree 2 for both, coefficient 1/sqrt(2*2) = 0.5 on every edge
    one = {r.node: r.mean for r in graph.propagate(nodes, edges, hops=1, cols=["mean"]).collect()}
    assert one == {0: pytest.approx(4.0), 1: pytest.approx(4.0)}


def test_Q01_prior_week_on_short_series(spark):
    s = series(spark, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10])
    r = analytics.kpis(s).first()
    assert r.last7_avg == pytest.approx(7.0) and r.prev7_avg == pytest.approx(4.0)  # rows 4-10 vs rows 1-7
    assert r.trend == "up" and r.n_days == 10 and r.total_sales == 55.0


def test_K13_ma_backtest(spark):
    r = forecast.ma_backtest(series(spark, [10, 20, 30])).first()
    # predictions: 10 (first row = actual), 10, 15 -> |e| = 0, 10, 15 over a total of 60
    assert r.wmape == pytest.approx(25 / 60 * 100) and r.n_obs == 3


def test_N01_constant_series_have_no_edge(spark):
    from skucast.operators import graph
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(100)]
    rows = [(s, d, v) for s, v in (("A", 0.1), ("B", 12.3)) for d in days]
    rows += [("C", d, float(i % 7)) for i, d in enumerate(days)] + [("D", d, 2.0 * (i % 7) + 1) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "sku_id string, date date, sales double")
    got = {(r.src_sku, r.dst_sku): r.weight for r in graph.correlation_edges(df, 0.5, block=2).collect()}
    assert set(got) == {("C", "D"), ("D", "C")} and got["C", "D"] == pytest.approx(1.0)


def test_C06_new_year_observed_the_day_before(spark):
    df = spark.createDataFrame([(dt.date(2021, 12, 30),), (dt.date(2021, 12, 31),)], "date date")
    got = {r.date: r.is_holiday for r in panel.add_holidays(df).collect()}
    assert got == {dt.date(2021, 12, 30): 0, dt.date(2021, 12, 31): 1}
