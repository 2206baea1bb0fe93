"""Seasonal ARIMA: the batched filter against a plain one, planted models, differencing, forecasts, fallback."""

import datetime as dt

import numpy as np
import pytest

from skucast.operators import arima as A


def simulate(rng, n, ar=(), sar=(), ma=(), sma=(), c=0.0, sd=1.0, burn=300):
    params = np.array([[*ar, *sar, *ma, *sma, c]])
    phi, theta, _ = (v[0] for v in A.polynomials(params, (len(ar), len(ma), len(sar), len(sma), 1)))
    e, x = rng.normal(0, sd, n + burn), np.zeros(n + burn)
    for t in range(10, n + burn):
        x[t] = e[t] + sum(p * x[t - i - 1] for i, p in enumerate(phi)) + sum(q * e[t - j - 1] for j, q in enumerate(theta))
    return x[burn:] + c


def plain_likelihood(x, phi, theta):
    """One series, textbook filter with matrices; the state's covariance by summing its series."""
    size = max(len(phi), len(theta) + 1)
    T, R = np.zeros((size, size)), np.zeros(size)
    T[:len(phi), 0], R[0], R[1:len(theta) + 1] = phi, 1, theta
    T[:-1, 1:] += np.eye(size - 1)
    P, power = np.zeros((size, size)), np.outer(R, R)
    for _ in range(20000):
        P += power
        power = T @ power @ T.T
    a, sq, logs = np.zeros(size), 0.0, 0.0
    for v in x:
        f = P[0, 0]
        err = v - a[0]
        sq, logs = sq + err * err / f, logs + np.log(f)
        K = T @ P[:, 0] / f
        a, P = T @ a + K * err, T @ P @ T.T + np.outer(R, R) - np.outer(K, K) * f
    s2 = sq / len(x)
    return -0.5 * (len(x) * (np.log(2 * np.pi * s2) + 1) + logs), s2, a


@pytest.mark.parametrize("order", [(2, 2, 1, 1, 0), (0, 1, 0, 1, 0), (1, 0, 0, 0, 0), (0, 2, 1, 0, 0)])
def test_batched_filter_equals_a_plain_one(order):
    rng = np.random.default_rng(sum(order))
    p, q, sp, sq, _ = order
    params = rng.uniform(-0.45, 0.45, (5, p + q + sp + sq))
    x = rng.normal(0, 2, (90, 5)).cumsum(axis=0) * 0.1 + rng.normal(0, 1, (90, 5))
    phi, theta, _ = A.polynomials(params, order)
    got = A.kalman(x, phi, theta)
    for i in range(5):
        want = plain_likelihood(x[:, i], phi[i], theta[i])
        assert abs(got[0][i] - want[0]) < 1e-8 * max(1, abs(want[0])) and abs(got[1][i] - want[1]) < 1e-8
        assert np.abs(got[2][i] - want[2]).max() < 1e-8


def test_planted_moving_averages_are_recovered():
    rng = np.random.default_rng(4)
    x = np.stack([simulate(rng, 1500, ma=(0.6,), sma=(-0.5,), c=20.0) for _ in range(6)], axis=1)
    params, sound = A.estimate(x, (0, 1, 0, 1, 1))
    assert sound.all() and np.abs(params.mean(axis=0) - [0.6, -0.5, 20.0]).max() < 0.05
    assert np.abs(params - [0.6, -0.5, 20.0]).max() < 0.2
    chosen = A.search(x, True)
    assert sum(c[0][1] >= 1 and c[0][3] == 1 for c in chosen) == 6  # ma and seasonal ma terms are found
    plain = A.kalman(x - x.mean(axis=0), np.zeros((6, 0)), np.zeros((6, 0)))[0]
    assert all(c[2] < s for c, s in zip(chosen, A.aicc(plain, len(x), 2)))


def test_planted_autoregression_and_forecast_of_its_mean():
    rng = np.random.default_rng(5)
    x = simulate(rng, 2000, ar=(0.7,), sar=(0.4,), c=50.0)
    (chosen,) = A.search(x[:, None], True)
    assert chosen[0][0] >= 1 and chosen[0][2] == 1 and abs(chosen[3] - 1) < 0.1
    mean, half = A.forecast_path(x, chosen, 0, 0, 200)
    assert abs(mean[-1] - 50) < 1 and np.all(np.diff(half) > -1e-12)
    phi, theta, c = (v[0] for v in A.polynomials(chosen[1][None], chosen[0]))
    if not theta.any():  # without errors the forecast is the plain recursion
        z = list(x - c)
        for _ in range(20):
            z.append(sum(p * z[-i - 1] for i, p in enumerate(phi)))
        assert np.abs(np.array(z[2000:]) + c - mean[:20]).max() < 1e-6


def test_differences_are_undone():
    y = np.array([3.0, 5, 1, 2, 8, 9, 4] * 8) + 2.0 * np.arange(56)
    state = np.zeros(1)
    chosen = ((0, 0, 0, 0, 0), np.zeros(0), 0.0, 1.0, state)
    mean, half = A.forecast_path(y, chosen, 0, 1, 14)
    assert np.allclose(mean, np.concatenate([y[-7:], y[-7:]])) and np.allclose(half[[0, 7]], A.Z95 * np.sqrt([1, 2]))
    mean, half = A.forecast_path(y, chosen, 2, 0, 3)
    assert np.allclose(mean, y[-1] + (y[-1] - y[-2]) * np.arange(1, 4)) and np.allclose(half, A.Z95 * np.sqrt([1, 5, 14]))


def frame(spark, series):
    rows = [(k, dt.date(2021, 1, 3) + dt.timedelta(days=i), float(v)) for k, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "sku_id string, date date, sales double")


def plain_kpss(x):
    n, e = len(x), x - x.mean()
    lags = int(4 * (n / 100) ** 0.25)
    spread = (e @ e + 2 * sum((1 - l / (lags + 1)) * (e[l:] @ e[:-l]) for l in range(1, lags + 1))) / n
    return (e.cumsum() ** 2).sum() / n ** 2 / spread


def test_unit_roots(spark):
    rng = np.random.default_rng(6)
    noise = rng.normal(0, 1, 400)
    series = {"level": 9 + noise, "walk": noise.cumsum(), "twice": noise.cumsum().cumsum(),
              "weekly": np.tile([1.0, 9, 4, 7, 2, 20, 12], 58)[:400] + noise, "flat": np.full(400, 3.0)}
    got = {r.sku_id: r for r in A.unit_root_tests(frame(spark, series)).collect()}
    assert {k: (r.d, r.seasonal_d) for k, r in got.items()} == {
        "level": (0, 0), "walk": (1, 0), "twice": (2, 0), "weekly": (0, 1), "flat": (0, 0)}
    for k in ("level", "walk", "twice"):
        assert abs(got[k].kpss_0 - plain_kpss(series[k])) < 1e-9 * max(1, got[k].kpss_0)
        assert abs(got[k].kpss_1 - plain_kpss(np.diff(series[k]))) < 1e-9 * max(1, got[k].kpss_1)
    w = series["weekly"]
    assert abs(got["weekly"].kpss_0 - plain_kpss(w[7:] - w[:-7])) < 1e-9


def test_forecasts_fall_back_and_beat_the_mean(spark):
    rng = np.random.default_rng(7)
    weekly = 30 + np.tile([1.0, 9, 4, 7, 2, 20, 12], 80)[:420] + simulate(rng, 420, ma=(0.5,))
    series = {"weekly": weekly[:392], "short": weekly[:50], "flat": np.full(200, 3.0), "null": np.full(100, 5.0)}
    out = A.arima(frame(spark, series), 28)
    rows = {}
    for r in out.collect():
        rows.setdefault(r.sku_id, []).append(r)
    assert {k: {r.model_used for r in v} for k, v in rows.items()} == {
        "weekly": {"arima"}, "short": {"seasonal_naive"}, "flat": {"seasonal_naive"}, "null": {"seasonal_naive"}}
    assert all(len(v) == 28 and all(r.lo <= r.yhat <= r.hi for r in v) for v in rows.values())
    errors = [abs(r.yhat - weekly[391 + r.h]) for r in rows["weekly"]]
    assert np.mean(errors) < 0.4 * np.abs(weekly[392:] - weekly[:392].mean()).mean()
    assert A.arima(frame(spark, series).limit(0), 28).count() == 0
