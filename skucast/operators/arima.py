"""Seasonal ARIMA with an automatic order, for every series in one job (survey K06, J01, J02 fallback, K05, L09).

SARIMA(p, d, q)(P, D, Q)7 with p, q <= 2 and P, Q <= 1:

1. Differencing is chosen by DataFrame windows and grouped sums (``unit_root_tests``): D = 1 where the weekday
   explains most of the detrended series, d by KPSS tests of level stationarity.
2. Orders are searched stepwise: four start orders, then the neighbours of the best so far, until none has a lower
   AICc. Every series goes its own way; all (series, order) pairs of a round that share an order are one batch.
3. A batch is estimated by least squares on its residuals (Levenberg-Marquardt, all series and all derivatives in one
   recursion over time), then its exact Gaussian likelihood comes from a Kalman filter over all series of the batch
   at once, which switches to a constant gain when the gain has settled.
4. Forecasts continue the filter's state and undo the differences; the 95 % band is yhat +- 1.96 sigma
   sqrt(sum psi^2). All values are clipped at 0.

A series has one row a day, so it is one array; a task works on ``SERIES`` series at a time. Series shorter than
H + 30 days, and constant ones, fall back to the seasonal naive model with the +-20 % band.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skucast.operators.forecast import baseline_forecast, eligible
from skucast.operators.seasonal_ar import MIN_EXTRA_DAYS, Z95

SEASON, MAX_PQ, MAX_SEASONAL, MAX_D = 7, 2, 1, 2
KPSS_CRITICAL = 0.463  # level stationarity, 5 %
STRENGTH = 0.64  # a stronger weekly pattern is differenced
KPSS_LAGS = 15  # the window 4 (n / 100)^(1/4) reaches it at 20,000 days
SERIES, STEPS, MARGIN = 64, 12, 0.995
Order = tuple[int, int, int, int, int]  # p, q, P, Q, constant


# ----------------------------------------------------------------- differencing, on Spark
def seasonal_strength(daily: DataFrame, keys: Sequence[str] = ("sku_id",), col: str = "sales") -> DataFrame:
    """Per series: the share of the detrended variance (less a centred weekly mean) that its weekday means hold."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("date")
    week = w.rowsBetween(-3, 3)
    t = daily.select(*keys, F.weekday("date").alias("_day"), (F.col(col) - F.avg(col).over(week)).alias("_x"),
                     F.count(F.lit(1)).over(week).alias("_n")).where(F.col("_n") == SEASON)
    days = t.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("q"))
    total = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    return days.groupBy(*keys).agg(F.when(total > 1e-9, between / total).otherwise(0.0).alias("strength"))


def _kpss_sums(name: str) -> list:
    e, level = F.col(f"_e{name}"), F.col(f"_c{name}")
    sums = [F.count(e).alias(f"n{name}"), F.sum(level * level).alias(f"s{name}"), F.sum(e * e).alias(f"g{name}_0")]
    return sums + [F.sum(e * F.col(f"_e{name}_{l}")).alias(f"g{name}_{l}") for l in range(1, KPSS_LAGS + 1)]


def _kpss(name: str):
    n = F.col(f"n{name}").cast("double")
    lags = F.least(F.floor(4 * F.pow(n / 100, 0.25)), F.lit(KPSS_LAGS))
    spread = F.col(f"g{name}_0")
    for l in range(1, KPSS_LAGS + 1):
        spread = spread + F.when(lags >= l, 2 * (1 - F.lit(l) / (lags + 1)) * F.coalesce(F.col(f"g{name}_{l}"), F.lit(0.0))).otherwise(0.0)
    return F.when(spread > 1e-9, F.col(f"s{name}") / (n * spread)).otherwise(0.0)


def unit_root_tests(daily: DataFrame, keys: Sequence[str] = ("sku_id",), col: str = "sales") -> DataFrame:
    """Per series: n, strength, seasonal_d, kpss_0 and kpss_1 (of the seasonally differenced series and of its first
    differences), d."""
    keys = list(keys)
    by = Window.partitionBy(*keys)
    w = by.orderBy("date")
    strength = seasonal_strength(daily, keys, col).withColumn("seasonal_d", (F.col("strength") > STRENGTH).cast("int"))
    y = F.col(col).cast("double")
    t = daily.select(*keys, "date", y.alias("_y")).join(strength, keys)
    t = t.withColumn("_x0", F.when(F.col("seasonal_d") == 1, F.col("_y") - F.lag("_y", SEASON).over(w)).otherwise(F.col("_y")))
    t = t.withColumn("_x1", F.col("_x0") - F.lag("_x0").over(w))
    t = t.withColumns({f"_e{i}": F.col(f"_x{i}") - F.avg(f"_x{i}").over(by) for i in (0, 1)})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({**{f"_c{i}": F.when(F.col(f"_e{i}").isNotNull(), F.sum(f"_e{i}").over(upto)) for i in (0, 1)},
                       **{f"_e{i}_{l}": F.lag(f"_e{i}", l).over(w) for i in (0, 1) for l in range(1, KPSS_LAGS + 1)}})
    sums = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("strength").alias("strength"),
                                F.max("seasonal_d").alias("seasonal_d"), *_kpss_sums("0"), *_kpss_sums("1"))
    out = sums.select(*keys, "n", "strength", "seasonal_d", _kpss("0").alias("kpss_0"), _kpss("1").alias("kpss_1"))
    return out.withColumn("d", F.when(F.col("kpss_0") <= KPSS_CRITICAL, 0).when(F.col("kpss_1") <= KPSS_CRITICAL, 1).otherwise(MAX_D))


# ----------------------------------------------------------------- the model, on batches of series
def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of two rows of polynomials (series x degree + 1)."""
    out = np.zeros((len(a), a.shape[1] + b.shape[1] - 1))
    for i in range(a.shape[1]):
        out[:, i:i + b.shape[1]] += a[:, i:i + 1] * b
    return out


def polynomials(params: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phi, theta, constant) of parameter rows [ar, seasonal ar, ma, seasonal ma, constant]: x(t) = sum phi x(t-i)
    + e(t) + sum theta e(t-j)."""
    p, q, sp, sq, const = order
    one = np.ones((len(params), 1))

    def season(cols: np.ndarray) -> np.ndarray:
        out = np.zeros((len(params), SEASON * cols.shape[1] + 1))
        out[:, 0], out[:, SEASON::SEASON] = 1, cols
        return out

    ar, sar, ma, sma = np.split(params[:, :p + sp + q + sq], [p, p + sp, p + sp + q], axis=1)
    phi = -_times(np.hstack([one, -ar]), season(-sar))[:, 1:]
    theta = _times(np.hstack([one, ma]), season(sma))[:, 1:]
    return phi, theta, params[:, -1] if const else np.zeros(len(params))


def admissible(params: np.ndarray, order: Order) -> np.ndarray:
    """Stationary and invertible rows: every factor's roots lie outside the unit circle, with a margin."""
    p, q, sp, sq, _ = order
    ok = np.ones(len(params), bool)
    at = 0
    for size, sign, seasonal in ((p, 1, False), (sp, 1, True), (q, -1, False), (sq, -1, True)):
        part = sign * params[:, at:at + size]
        at += size
        if size == 1 or (seasonal and size):
            ok &= np.abs(part[:, 0]) < MARGIN
        elif size == 2:
            ok &= (np.abs(part[:, 1]) < MARGIN) & (part[:, 0] + part[:, 1] < MARGIN) & (part[:, 1] - part[:, 0] < MARGIN)
    return ok


def residuals(x: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """One-step errors (time x series) of x (time x series), earlier values and errors being 0."""
    n, m = x.shape
    u = x.copy()
    for i in range(phi.shape[1]):
        if phi[:, i].any():
            u[i + 1:] -= phi[:, i] * x[:n - i - 1]
    lags = [j + 1 for j in range(theta.shape[1]) if theta[:, j].any()]
    if not lags:
        return u
    pad = max(lags)
    e, weights = np.zeros((n + pad, m)), [theta[:, j - 1].copy() for j in lags]
    for t in range(n):
        now = u[t]
        for j, weight in zip(lags, weights):
            now = now - weight * e[t + pad - j]
        e[t + pad] = now
    return e[pad:]


def estimate(x: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares parameters of every column of x (time x series), and which of them are sound."""
    n, m = x.shape
    k = sum(order)
    params = np.zeros((m, k))
    if order[4]:
        params[:, -1] = x.mean(axis=0)

    def errors(rows: np.ndarray, data: np.ndarray) -> np.ndarray:
        phi, theta, constant = polynomials(rows, order)
        with np.errstate(over="ignore", invalid="ignore"):
            return residuals(data - constant, phi, theta)

    if not k:
        return params, np.ones(m, bool)
    scale = np.maximum(x.std(axis=0), 1e-12)
    shift = np.full(k, 1e-5)
    damping, best = np.full(m, 1e-2), np.full(m, np.inf)
    live = np.ones(m, bool)
    for _ in range(STEPS):
        rows = params[live]
        count = len(rows)
        moves = np.broadcast_to(shift, (count, k)).copy()
        if order[4]:
            moves[:, -1] = 1e-5 * scale[live]
        tried = np.repeat(rows[None], k + 1, axis=0)
        for i in range(k):
            tried[i + 1, :, i] += moves[:, i]
        e = errors(tried.reshape(-1, k), np.tile(x[:, live], k + 1)).reshape(n, k + 1, count)
        base = e[:, 0]
        slope = (e[:, 1:] - base[:, None]) / moves.T[None]
        best[live] = np.einsum("ts,ts->s", base, base)
        gram = np.einsum("tis,tjs->sij", slope, slope)
        right = np.einsum("tis,ts->si", slope, base)
        diagonal = np.einsum("sii->si", gram)
        step = -np.linalg.solve(gram + (damping[live, None] * diagonal + 1e-12)[:, :, None] * np.eye(k), right[:, :, None])[:, :, 0]
        new = rows + step
        sse = np.full(count, np.inf)
        fine = admissible(new, order) & np.isfinite(new).all(axis=1)
        if fine.any():
            tested = errors(new[fine], x[:, live][:, fine])
            sse[fine] = np.einsum("ts,ts->s", tested, tested)
        sse[~np.isfinite(sse)] = np.inf
        better = sse < best[live]
        at = np.flatnonzero(live)
        gain = np.where(better, 1 - sse / np.maximum(best[live], 1e-300), 0)
        params[at[better]], damping[at[better]] = new[better], damping[at[better]] / 4
        damping[at[~better]] *= 8
        live[at[(better & (gain < 1e-7)) | (damping[at] > 1e6)]] = False
        if not live.any():
            break
    return params, admissible(params, order) & np.isfinite(params).all(axis=1)


def kalman(x: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact log-likelihood and error variance (profiled) of every column of x (time x series) under its ARMA model,
    and the state that predicts the next values (series x state)."""
    n, m = x.shape
    size = max(phi.shape[1], theta.shape[1] + 1)
    ar, noise = np.zeros((m, size)), np.zeros((m, size))
    ar[:, :phi.shape[1]], noise[:, 0], noise[:, 1:theta.shape[1] + 1] = phi, 1, theta
    move = np.zeros((m, size, size))
    move[:, :, 0] = ar
    move[:, np.arange(size - 1), np.arange(1, size)] = 1
    drive = noise[:, :, None] * noise[:, None, :]
    both = np.einsum("sij,skl->sikjl", move, move).reshape(m, size * size, size * size)
    cover = np.linalg.solve(np.eye(size * size) - both, drive.reshape(m, -1, 1)).reshape(m, size, size)
    state, squares, logs = np.zeros((m, size)), np.zeros(m), np.zeros(m)
    settled = False
    for t in range(n):
        if not settled:
            spread = cover[:, 0, 0]
            gain = np.einsum("sij,sj->si", move, cover[:, :, 0]) / spread[:, None]
            new = move @ cover @ move.transpose(0, 2, 1) + drive - gain[:, :, None] * gain[:, None, :] * spread[:, None, None]
            settled = np.abs(new - cover).max() < 1e-13
            cover, log_spread = new, np.log(spread)
        error = x[t] - state[:, 0]
        squares += error * error / spread
        logs += log_spread
        head = state[:, 0]
        state = np.hstack([state[:, 1:], np.zeros((m, 1))]) + ar * head[:, None] + gain * error[:, None]
    variance = squares / n
    with np.errstate(divide="ignore"):
        likelihood = -0.5 * (n * (np.log(2 * np.pi * variance) + 1) + logs)
    return likelihood, variance, state


def aicc(likelihood: np.ndarray, n: int, k: int) -> np.ndarray:
    return -2 * likelihood + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)


def neighbours(order: Order, with_constant: bool) -> list[Order]:
    p, q, sp, sq, const = order
    steps = [(i, j, 0, 0) for i, j in product((-1, 0, 1), repeat=2) if (i, j) in ((1, 1), (-1, -1)) or abs(i) + abs(j) == 1]
    steps += [(0, 0, *s[:2]) for s in steps]
    out = [(p + a, q + b, sp + c, sq + d, const) for a, b, c, d in steps]
    out = [o for o in out if all(0 <= v <= MAX_PQ for v in o[:2]) and all(0 <= v <= MAX_SEASONAL for v in o[2:4])]
    return out + [(p, q, sp, sq, 1 - const)] * with_constant


def search(x: np.ndarray, with_constant: bool) -> list[tuple[Order, np.ndarray, float, float, np.ndarray]]:
    """The chosen (order, parameters, AICc, variance, state) of every column of x (time x series)."""
    m, const = x.shape[1], int(with_constant)
    start = [(2, 2, 1, 1, const), (0, 0, 0, 0, const), (1, 0, 1, 0, const), (0, 1, 0, 1, const)] + [(0, 0, 0, 0, 0)] * const
    best: list = [None] * m
    tried: list[set] = [set() for _ in range(m)]
    wanted = {o: list(range(m)) for o in start}
    while wanted:
        moved = set()
        for order, who in wanted.items():
            for i in who:
                tried[i].add(order)
            params, sound = estimate(x[:, who], order)
            phi, theta, constant = polynomials(params[sound], order)
            mine = np.array(who)[sound]
            if not len(mine):
                continue
            likelihood, variance, state = kalman(x[:, mine] - constant, phi, theta)
            scores = aicc(likelihood, len(x), sum(order) + 1)
            for i, own, score, v, s in zip(mine.tolist(), params[sound], scores.tolist(), variance.tolist(), state):
                if np.isfinite(score) and (best[i] is None or score < best[i][2] - 1e-9):
                    best[i] = (order, own, score, v, s)
                    moved.add(i)
        wanted = {}
        for i in sorted(moved):
            for order in neighbours(best[i][0], with_constant):
                if order not in tried[i]:
                    wanted.setdefault(order, []).append(i)
    return best


def _difference(y: np.ndarray, d: int, seasonal_d: int) -> np.ndarray:
    for _ in range(seasonal_d):
        y = y[SEASON:] - y[:-SEASON]
    for _ in range(d):
        y = np.diff(y, axis=0)
    return y


def forecast_path(y: np.ndarray, chosen: tuple, d: int, seasonal_d: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, half width of the 95 % band) of the next values of one series."""
    order, params, _, variance, state = chosen
    phi, theta, constant = (v[0] for v in polynomials(params[None], order))
    undo = np.ones((1, 1))
    for size, times in ((1, d), (SEASON, seasonal_d)):
        for _ in range(times):
            undo = _times(undo, np.eye(1, size + 1) - np.eye(1, size + 1, size))
    full = -_times(undo, np.concatenate(([1.0], -phi))[None])[0, 1:]
    undo, history, psi = -undo[0, 1:], list(y), [1.0]
    ar = np.zeros(len(state))
    ar[:len(phi)] = phi
    for h in range(horizon):
        history.append(state[0] + constant + sum(c * history[-i - 1] for i, c in enumerate(undo)))
        state = np.append(state[1:], 0) + ar * state[0]
        psi.append((theta[h] if h < len(theta) else 0.0) + sum(c * psi[-i - 1] for i, c in enumerate(full[:len(psi)])))
    return np.array(history[len(y):]), Z95 * np.sqrt(variance * np.cumsum(np.square(psi[:horizon])))


def fit_batch(series: list[np.ndarray], d: int, seasonal_d: int) -> list[tuple | None]:
    """The chosen model of every series (of one length), None for series that are constant after differencing."""
    x = np.stack([_difference(y, d, seasonal_d) for y in series], axis=1)
    out: list[tuple | None] = [None] * len(series)
    varies = np.flatnonzero(x.std(axis=0) > 1e-9) if len(x) > 2 * SEASON else []
    if len(varies):
        for i, chosen in zip(varies, search(x[:, varies], d + seasonal_d <= 1)):
            out[i] = chosen
    return out


# ----------------------------------------------------------------- DataFrames
def series_arrays(daily: DataFrame, keys: Sequence[str] = ("sku_id",), col: str = "sales") -> DataFrame:
    """keys, last_date, y (values in date order), d, seasonal_d."""
    keys = list(keys)
    arrays = daily.groupBy(*keys).agg(F.max("date").alias("last_date"), F.transform(
        F.sort_array(F.collect_list(F.struct("date", F.col(col).cast("double").alias("v")))), lambda s: s["v"]).alias("y"))
    return arrays.join(unit_root_tests(daily, keys, col).select(*keys, "d", "seasonal_d"), keys)


MODEL = ("order string, params array<double>, aicc double, sigma2 double, yhat array<double>, half array<double>")


def arima_models(daily: DataFrame, horizon: int = 28, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Per series: last_date, the chosen ``order`` (p,d,q)(P,D,Q) with constant, its parameters, AICc and variance, and
    the forecast path with the half width of its band; series that cannot be fitted give no row."""
    keys = list(keys)
    kept = [*keys, "last_date"]

    def fitted(rows: list[dict]) -> Iterator[tuple]:
        groups: dict[tuple, list[dict]] = {}
        for r in rows:
            groups.setdefault((len(r["y"]), r["d"], r["seasonal_d"]), []).append(r)
        for (_, d, seasonal_d), members in groups.items():
            series = [np.array(r["y"]) for r in members]
            for r, y, chosen in zip(members, series, fit_batch(series, d, seasonal_d)):
                if chosen:
                    (p, q, sp, sq, const), params, score, variance, _ = chosen
                    mean, half = forecast_path(y, chosen, d, seasonal_d, horizon)
                    name = f"({p},{d},{q})({sp},{seasonal_d},{sq})" + " with constant" * const
                    yield (*[r[c] for c in kept], name, params.tolist(), score, variance, mean.tolist(), half.tolist())

    source = series_arrays(daily, keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*kept).schema) + ", " + MODEL
    names = [*kept, *(c.split()[0] for c in MODEL.split(", "))]

    def work(batches):
        for b in batches:
            types = [b.schema.field(c).type for c in kept]
            types += [pa.string(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            for at in range(0, b.num_rows, SERIES):
                out = list(fitted(b.slice(at, SERIES).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    parts = int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return source.repartition(parts, *keys).mapInArrow(work, schema)


def arima(daily: DataFrame, horizon: int = 28, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Seasonal ARIMA where the series has >= H + 30 days and varies; otherwise the seasonal naive fallback (K03,
    +-20 %). Output: keys, date, h, yhat, lo, hi, model_used."""
    from skucast.operators.panel import pick_forecast
    keys = list(keys)
    models = arima_models(eligible(daily, horizon + MIN_EXTRA_DAYS, keys), horizon, keys)
    path = models.select(*keys, "last_date", F.posexplode(F.arrays_zip("yhat", "half")).alias("i", "f"))
    zero = F.lit(0.0)
    own = path.select(*keys, F.date_add("last_date", F.col("i") + 1).alias("date"), (F.col("i") + 1).alias("h"),
                      F.greatest("f.yhat", zero).alias("yhat"), F.greatest(F.col("f.yhat") - F.col("f.half"), zero).alias("lo"),
                      F.greatest(F.col("f.yhat") + F.col("f.half"), zero).alias("hi"), F.lit("arima").alias("model_used"))
    return pick_forecast([own, baseline_forecast(daily, "seasonal_naive", horizon, keys)], keys)
