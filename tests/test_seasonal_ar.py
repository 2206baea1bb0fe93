"""Seasonal AR (K06): recovery of a planted process, recursion, fallback."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from skucast.operators import seasonal_ar as S


def ar_series(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    y = [10.0] * 14
    for _ in range(n):
        y.append(5.0 + 0.6 * y[-7] + rng.normal(0, 0.5))
    rows = [("AR", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "sku_id string, date date, sales double"), y


def test_fit_recovers_weekly_lag(spark):
    df, _ = ar_series(spark)
    m = S.fit(df).first()
    assert "7" in m.order.split(",")
    assert abs(m.beta[3] - 0.6) < 0.1 and m.sigma2 > 0


def test_recursion_matches_numpy(spark):
    df, y = ar_series(spark)
    m = S.fit(df)
    b = m.first().beta
    fc = S.forecast(df, m, 21).orderBy("h").collect()
    acc = list(y[-14:])
    for _ in range(21):
        acc.append(b[0] + b[1] * acc[-1] + b[2] * acc[-2] + b[3] * acc[-7] + b[4] * acc[-14])
    assert max(abs(max(0.0, e) - r.yhat) for e, r in zip(acc[14:], fc)) < 1e-9
    assert all(r.lo <= r.yhat <= r.hi for r in fc)
    widths = [r.hi - r.lo for r in fc]
    assert widths[-1] >= widths[0]  # uncertainty grows with the horizon


def test_short_series_fall_back(spark):
    df, _ = ar_series(spark, n=20)  # 34 days < 28 + 30
    out = S.seasonal_ar(df, 28).collect()
    assert {r.model_used for r in out} == {"seasonal_naive"} and len(out) == 28


def test_normal_equations_match_numpy(spark):
    df, y = ar_series(spark, n=100)
    ne = S.normal_equations(df).first()
    y = np.array(y)
    t = np.arange(14, len(y))
    X = np.column_stack([np.ones(len(t))] + [y[t - l] for l in S.LAGS])
    assert np.allclose(np.array(ne.gram).reshape(5, 5), X.T @ X)
    assert np.allclose(ne.xty, X.T @ y[t]) and ne.n == len(t)
