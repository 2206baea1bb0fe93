"""DuckDB oracle SQL for samples (G), forecasts (K) and metrics."""

from __future__ import annotations

from skucast.plans.oracle import R, sql

H = 14
FR = "PARTITION BY sku_id, store_id ORDER BY date"

DAILY_CTES = (
    "daily AS (SELECT sku_id, date, SUM(sales) AS sales FROM panel GROUP BY sku_id, date)",
    "dspan AS (SELECT sku_id, MIN(date) AS d0, MAX(date) AS d1 FROM daily GROUP BY sku_id)",
    """dense AS (SELECT g.sku_id, g.date, COALESCE(d.sales, 0.0) AS sales
  FROM (SELECT sku_id, CAST(UNNEST(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM dspan) g
  LEFT JOIN daily d ON g.sku_id = d.sku_id AND g.date = d.date)""",
)


def summary_ctes(src: str, tag: str) -> tuple[str, ...]:
    return (
        f"""ranked_{tag} AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sku_id ORDER BY date DESC) AS rn,
  COUNT(*) OVER (PARTITION BY sku_id) AS n FROM {src})""",
        f"""summ_{tag} AS (SELECT sku_id, COUNT(*) AS n, MAX(date) AS last_date, arg_max(sales, date) AS last_value,
  AVG(sales) AS mean_value, AVG(CASE WHEN rn <= 7 THEN sales END) AS ma7, AVG(CASE WHEN rn <= 28 THEN sales END) AS ma_trend,
  COALESCE(regr_slope(CASE WHEN rn <= 28 THEN sales END, CASE WHEN rn <= 28 THEN CAST(LEAST(n, 28) - rn AS DOUBLE) END), 0.0) AS slope
  FROM ranked_{tag} GROUP BY sku_id)""",
    )


def forecast_cte(tag: str, horizon: int, models=("naive", "seasonal_naive", "moving_average", "mean", "trend_naive")) -> str:
    steps = f"summ_{tag} s CROSS JOIN range(1, {horizon + 1}) t(h)"
    parts = {
        "naive": f"SELECT s.sku_id, s.last_date, t.h, 'naive' AS model_used, s.last_value AS yhat FROM {steps}",
        "seasonal_naive": f"""SELECT s.sku_id, s.last_date, t.h, 'seasonal_naive' AS model_used, r.sales AS yhat FROM {steps}
    JOIN ranked_{tag} r ON r.sku_id = s.sku_id AND r.rn = LEAST(s.n, 7 - (t.h - 1) % 7)""",
        "moving_average": f"SELECT s.sku_id, s.last_date, t.h, 'moving_average' AS model_used, s.ma7 AS yhat FROM {steps}",
        "mean": f"SELECT s.sku_id, s.last_date, t.h, 'mean' AS model_used, s.mean_value AS yhat FROM {steps}",
        "trend_naive": f"""SELECT s.sku_id, s.last_date, t.h, 'trend_naive' AS model_used,
    GREATEST(0.0, s.ma_trend + s.slope * (t.h - 1) + 2.0 * sin(CAST(t.h - 1 AS DOUBLE) / 7.0)) AS yhat FROM {steps}""",
    }
    body = "\n  UNION ALL ".join(parts[m] for m in models)
    return f"""fc_{tag} AS (SELECT sku_id, CAST(last_date + CAST(h AS INTEGER) AS DATE) AS date, CAST(h AS INTEGER) AS h, model_used, yhat,
  yhat * 0.8 AS lo, yhat * 1.2 AS hi FROM (
  {body}))"""


def fc_select(tag: str) -> str:
    return f"SELECT sku_id, date, h, {R('yhat')} AS yhat, {R('lo')} AS lo, {R('hi')} AS hi, model_used FROM fc_{tag}"


# ================================================================= G
leads = ", ".join(f"lead(sales, {h}) OVER ({FR})" for h in range(1, H + 1))
sql("G01_multi_horizon", f"""
SELECT sku_id, store_id, date, CAST(t.h AS INTEGER) AS horizon, arr[t.h] AS target
FROM (SELECT sku_id, store_id, date, [{leads}] AS arr FROM panel) p CROSS JOIN range(1, {H + 1}) t(h)
WHERE arr[t.h] IS NOT NULL""")

sql("G02_scoring_frame", f"""
SELECT sku_id, store_id, date, sales, lag_1, lag_7, CAST(t.h AS INTEGER) AS horizon FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sku_id, store_id ORDER BY date DESC) AS rn FROM (
    SELECT sku_id, store_id, date, sales, lag(sales, 1) OVER ({FR}) AS lag_1, lag(sales, 7) OVER ({FR}) AS lag_7
    FROM panel)) x CROSS JOIN range(1, {H + 1}) t(h) WHERE rn = 1""")

sql("G03_sequence_samples", f"""
SELECT sku_id, store_id, date, s_min, s_max, {R('y')} AS y, CAST(seq_len AS INTEGER) AS seq_len,
       {R('ssum')} AS seq_sales_sum, {R('wsum - (rn - 30) * ssum')} AS seq_sales_weighted,
       {R('price_z')} AS last_price_z FROM (
  SELECT *, COUNT(*) OVER ({FR} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS seq_len,
         SUM(sn) OVER ({FR} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ssum,
         SUM(rn * sn) OVER ({FR} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS wsum,
         lead(sn, 7) OVER ({FR}) AS y FROM (
    SELECT p.sku_id, p.store_id, p.date, st.s_min, st.s_max,
           ROW_NUMBER() OVER (PARTITION BY p.sku_id, p.store_id ORDER BY p.date) AS rn,
           (p.sales - st.s_min) / (st.s_max - st.s_min + 1e-8) AS sn,
           (p.price - st.mpr) / (st.spr + 1e-8) AS price_z
    FROM panel p JOIN (SELECT sku_id, store_id, MIN(sales) AS s_min, MAX(sales) AS s_max,
                              AVG(price) AS mpr, STDDEV_POP(price) AS spr FROM panel GROUP BY 1, 2) st
    ON p.sku_id = st.sku_id AND p.store_id = st.store_id))
WHERE seq_len = 30 AND y IS NOT NULL""")


def _encdec_select(src: str, split: str, cond: str) -> str:
    return f"""SELECT sku_id, store_id, date, time_idx, '{split}' AS split, CAST(enc_len AS INTEGER) AS enc_len,
       CAST(dec_len AS INTEGER) AS dec_len, {R('enc_sum')} AS enc_sum, {R('dec_sum')} AS dec_sum,
       {R('enc_w - (time_idx - enc_len) * enc_sum')} AS enc_weighted, {R('dec_w - time_idx * dec_sum')} AS dec_weighted FROM (
  SELECT sku_id, store_id, date, time_idx,
         COUNT(sales) OVER ({FR} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS enc_len,
         COUNT(sales) OVER ({FR} ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING) AS dec_len,
         COALESCE(SUM(sales) OVER ({FR} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0.0) AS enc_sum,
         COALESCE(SUM(sales) OVER ({FR} ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING), 0.0) AS dec_sum,
         COALESCE(SUM((time_idx + 1) * sales) OVER ({FR} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0.0) AS enc_w,
         COALESCE(SUM((time_idx + 1) * sales) OVER ({FR} ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING), 0.0) AS dec_w,
         ROW_NUMBER() OVER (PARTITION BY sku_id, store_id ORDER BY date DESC) AS rn_desc
  FROM {src}) WHERE {cond}"""


sql("G04_G05_encdec_windows", f"""
{_encdec_select("(SELECT * FROM prep WHERE time_idx <= (SELECT MAX(time_idx) - 14 FROM prep))", "train",
                "enc_len >= 15 AND dec_len = 14")}
UNION ALL
{_encdec_select("prep", "val", "rn_desc = 14 AND enc_len >= 15")}""",
    f"prep0 AS (SELECT *, CAST(ROW_NUMBER() OVER ({FR}) - 1 AS INTEGER) AS time_idx FROM panel)",
    """prep AS (SELECT p.* FROM prep0 p JOIN (SELECT sku_id, store_id FROM prep0 GROUP BY 1, 2 HAVING MAX(time_idx) >= 60) k
  ON p.sku_id = k.sku_id AND p.store_id = k.store_id)""")

sql("G06_multitask_prepare", f"""
SELECT p.sku_id, p.store_id, p.date, p.sales, p.price, {R('(p.price - z.m) / (z.s + 1e-8)')} AS price_norm,
       CAST(ROW_NUMBER() OVER (PARTITION BY p.sku_id, p.store_id ORDER BY p.date) - 1 AS INTEGER) AS time_idx,
       CAST(month(p.date) AS VARCHAR) AS month_cat, CAST(isodow(p.date) - 1 AS VARCHAR) AS day_of_week_cat,
       CAST(quarter(p.date) AS VARCHAR) AS quarter_cat,
       CASE WHEN isodow(p.date) >= 6 THEN '1' ELSE '0' END AS is_weekend_cat,
       {R('g.m')} AS sku_mean, {R('g.s')} AS sku_std
FROM panel p
JOIN (SELECT sku_id, AVG(price) AS m, STDDEV_SAMP(price) AS s FROM panel GROUP BY 1) z ON p.sku_id = z.sku_id
JOIN (SELECT sku_id, AVG(sales) AS m, COALESCE(STDDEV_SAMP(sales), 1.0) AS s FROM panel GROUP BY 1) g ON p.sku_id = g.sku_id""")

# ================================================================= K
sql("K02_K07_baselines", fc_select("all"), *DAILY_CTES, *summary_ctes("dense", "all"), forecast_cte("all", H))

sql("K11_forecast_all", f"""
SELECT sku_id, date, h, {R('yhat')} AS yhat, {R('lo')} AS lo, {R('hi')} AS hi, model_used FROM fc_el
WHERE sku_id IN (SELECT sku_id FROM sel)
UNION ALL
SELECT sku_id, date, h, {R('yhat')} AS yhat, {R('lo')} AS lo, {R('hi')} AS hi, model_used FROM fc_sel
WHERE sku_id NOT IN (SELECT sku_id FROM fc_el)""",
    *DAILY_CTES,
    "sel AS (SELECT * FROM dense)",
    "elig AS (SELECT * FROM dense WHERE sku_id IN (SELECT sku_id FROM dense GROUP BY sku_id HAVING COUNT(*) >= 2400))",
    *summary_ctes("elig", "el"), forecast_cte("el", H, ("moving_average",)),
    *summary_ctes("sel", "sel"), forecast_cte("sel", H, ("trend_naive",)))

sql("K11_forecast_category", f"""
SELECT sku_id, date, h, {R('yhat')} AS yhat, {R('lo')} AS lo, {R('hi')} AS hi, model_used FROM fc_el
WHERE sku_id IN (SELECT sku_id FROM sel)
UNION ALL
SELECT sku_id, date, h, {R('yhat')} AS yhat, {R('lo')} AS lo, {R('hi')} AS hi, model_used FROM fc_sel
WHERE sku_id NOT IN (SELECT sku_id FROM fc_el)""",
    *DAILY_CTES,
    """sel AS (SELECT * FROM dense WHERE sku_id IN (
  SELECT DISTINCT sku_id FROM dense WHERE starts_with(sku_id, 'PROMO') ORDER BY sku_id LIMIT 2))""",
    "elig AS (SELECT * FROM dense WHERE sku_id IN (SELECT sku_id FROM dense GROUP BY sku_id HAVING COUNT(*) >= 2400))",
    *summary_ctes("elig", "el"), forecast_cte("el", H, ("moving_average",)),
    *summary_ctes("sel", "sel"), forecast_cte("sel", H, ("trend_naive",)))

_LAST = f"feat AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER ({FR}) AS rn FROM panel) WHERE rn > 28)"
sql("K08_gbt_validation_rows", """
SELECT CAST(horizon AS INTEGER) AS horizon, COUNT(*) AS n_obs, MIN(date) AS first_date, SUM(target) AS sum_target
FROM smp WHERE date > (SELECT MAX(date) FROM cum WHERE c <= FLOOR((SELECT COUNT(*) FROM smp) * 0.8)) GROUP BY horizon""",
    _LAST,
    f"""smp AS (SELECT sku_id, store_id, date, t.h AS horizon, arr[t.h] AS target
  FROM (SELECT sku_id, store_id, date, [{leads}] AS arr FROM feat) p CROSS JOIN range(1, {H + 1}) t(h)
  WHERE arr[t.h] IS NOT NULL)""",
    """cum AS (SELECT date, SUM(n) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
  FROM (SELECT date, COUNT(*) AS n FROM smp GROUP BY date))""")

sql("K09_gbt_forecast_grid", f"""
SELECT sku_id, store_id, CAST(last_date + CAST(h AS INTEGER) AS DATE) AS date, CAST(h AS INTEGER) AS h,
       'GBT' AS model_used, TRUE AS band_in_order
FROM (SELECT sku_id, store_id, MAX(date) AS last_date FROM feat GROUP BY 1, 2) CROSS JOIN range(1, {H + 1}) t(h)""", _LAST)

_COLS = ("lag_1", "lag_7", "promo", "price", "horizon")
_GAIN = "POW(GREATEST(ABS({g}) - 0.1, 0), 2) / ({h} + 1.0)"
_LEAF = "-SIGN({g}) * GREATEST(ABS({g}) - 0.1, 0) / ({h} + 1.0) * 0.05"


def _split(tag: str, rows: str) -> tuple[str, ...]:
    """The best split of each node of ``rows`` (rid, node, f, bin, g)."""
    gain = (f"0.5 * ({_GAIN.format(g='lg', h='lh')} + {_GAIN.format(g='(tg - lg)', h='(th - lh)')}"
            f" - {_GAIN.format(g='tg', h='th')})")
    return (
        f"""cum_{tag} AS (SELECT node, f, bin, SUM(g) OVER w AS lg, SUM(h) OVER w AS lh, SUM(g) OVER t AS tg, SUM(h) OVER t AS th
  FROM (SELECT node, f, bin, SUM(g) AS g, CAST(COUNT(*) AS DOUBLE) AS h FROM {rows} GROUP BY ALL)
  WINDOW t AS (PARTITION BY node, f), w AS (PARTITION BY node, f ORDER BY bin))""",
        f"""gains_{tag} AS (SELECT *, CASE WHEN lh >= 1 AND th - lh >= 1 AND raw > 0
    THEN ROUND(raw * POW(10, 8 - FLOOR(LOG10(raw)))) / POW(10, 8 - FLOOR(LOG10(raw))) ELSE 0 END AS gain
  FROM (SELECT *, {gain} AS raw FROM cum_{tag}))""",
        f"""split_{tag} AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) AS k
  FROM gains_{tag}) WHERE k = 1 AND gain > 0)""",
    )


TREE_CTES = (
    f"""lagged AS (SELECT *, COALESCE(lag(sales, 1) OVER ({FR}), 0) AS lag_1, COALESCE(lag(sales, 7) OVER ({FR}), 0) AS lag_7 FROM panel)""",
    f"""smp AS (SELECT sku_id, store_id, date, t.h AS horizon, arr[t.h] AS target, lag_1, lag_7, promo, price
  FROM (SELECT *, [{leads}] AS arr FROM lagged) p CROSS JOIN range(1, {H + 1}) t(h) WHERE arr[t.h] IS NOT NULL)""",
    """cum AS (SELECT date, SUM(n) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
  FROM (SELECT date, COUNT(*) AS n FROM smp GROUP BY date))""",
    f"""train AS (SELECT row_number() OVER () AS rid, target, CAST([{", ".join(_COLS)}] AS DOUBLE[]) AS x FROM smp
  WHERE date <= (SELECT MAX(date) FROM cum WHERE c <= FLOOR((SELECT COUNT(*) FROM smp) * 0.8)))""",
    f"""edges AS (SELECT f, list_sort(list_distinct(quantile_cont(x[f], [{", ".join(f"{i / 64}" for i in range(1, 64))}]))) AS e
  FROM train CROSS JOIN range(1, {len(_COLS) + 1}) t(f) GROUP BY f)""",
    "base AS (SELECT AVG(target) AS b FROM train)",
    """bins AS (SELECT rid, f, len([v for v in e if v < x[f]]) AS bin, b - target AS g FROM train, edges, base)""",
    "level0 AS (SELECT rid, 0 AS node, f, bin, g FROM bins)",
    *_split("0", "level0"),
    """side AS (SELECT rid, CASE WHEN bins.bin > s.bin THEN 1 ELSE 0 END AS node FROM bins JOIN split_0 s ON bins.f = s.f)""",
    "level1 AS (SELECT rid, node, f, bin, g FROM bins JOIN side USING (rid))",
    *_split("1", "level1"),
    f"""nodes AS (
  SELECT 0 AS node, f, e[bin + 1] AS cut, NULL AS value FROM split_0 JOIN edges USING (f)
  UNION ALL SELECT node + 1, f, e[bin + 1], NULL FROM split_1 JOIN edges USING (f)
  UNION ALL SELECT 2 * node + 3, NULL, NULL, {_LEAF.format(g='lg', h='lh')} FROM split_1
  UNION ALL SELECT 2 * node + 4, NULL, NULL, {_LEAF.format(g='(tg - lg)', h='(th - lh)')} FROM split_1
  UNION ALL SELECT node + 1, NULL, NULL, value FROM (
    SELECT 0 AS node, {_LEAF.format(g='lg', h='lh')} AS value FROM split_0
    UNION ALL SELECT 1, {_LEAF.format(g='(tg - lg)', h='(th - lh)')} FROM split_0)
  WHERE node NOT IN (SELECT node FROM split_1)
  UNION ALL SELECT 0, NULL, NULL, (SELECT {_LEAF.format(g='SUM(g)', h='COUNT(*)')} FROM level0 WHERE f = 1)
  WHERE NOT EXISTS (SELECT * FROM split_0))""",
)
_NAME = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_COLS, 1))
sql("K08_first_tree", f"""
SELECT CAST(node AS INTEGER) AS node, CASE f {_NAME} END AS feature, {R('cut')} AS cut, {R('value')} AS value FROM nodes""", *TREE_CTES)

sql("K09_first_tree_forecast", f"""
SELECT sku_id, store_id, date, h, {R('yhat')} AS yhat, {R('yhat * 0.8')} AS lo, {R('yhat * 1.2')} AS hi, 'GBT' AS model_used FROM (
  SELECT sku_id, store_id, CAST(l.date + CAST(h AS INTEGER) AS DATE) AS date, CAST(h AS INTEGER) AS h,
         GREATEST(b + COALESCE(n2.value, n1.value, n0.value), 0) AS yhat
  FROM (SELECT *, CAST([lag_1, lag_7, promo, price, t.h] AS DOUBLE[]) AS x, t.h AS h FROM lagged CROSS JOIN range(1, {H + 1}) t(h)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY sku_id, store_id, t.h ORDER BY date DESC) = 1) l
  CROSS JOIN base JOIN nodes n0 ON n0.node = 0
  LEFT JOIN nodes n1 ON n0.f IS NOT NULL AND n1.node = CASE WHEN x[n0.f] > n0.cut THEN 2 ELSE 1 END
  LEFT JOIN nodes n2 ON n1.f IS NOT NULL AND n2.node = 2 * n1.node + CASE WHEN x[n1.f] > n1.cut THEN 2 ELSE 1 END)""", *TREE_CTES)

sql("K12_forecast_sku", fc_select("one"),
    "daily AS (SELECT sku_id, date, SUM(sales) AS sales FROM panel WHERE sku_id = 'PROMO_2_001' GROUP BY sku_id, date)",
    *DAILY_CTES[1:], *summary_ctes("dense", "one"), forecast_cte("one", H, ("trend_naive",)))

sql("K13_ma_backtest", f"""
SELECT sku_id, store_id, {R('SUM(ABS(sales - pred)) / (SUM(sales) + 1e-8) * 100')} AS wmape, COUNT(*) AS n_obs FROM (
  SELECT *, COALESCE(AVG(sales) OVER ({FR} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), sales) AS pred FROM panel)
GROUP BY 1, 2""")

sql("K14_eligible", "SELECT sku_id, COUNT(*) AS n_rows FROM dense GROUP BY sku_id HAVING COUNT(*) >= 2400", *DAILY_CTES)

# ================================================================= L
HOLD = 28
HOLDOUT_CTES = (
    *DAILY_CTES,
    "hranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sku_id ORDER BY date DESC) AS hrn FROM dense)",
    "htrain AS (SELECT sku_id, date, sales FROM hranked WHERE hrn > 28)",
    "htest AS (SELECT sku_id, CAST(29 - hrn AS INTEGER) AS h, sales AS y FROM hranked WHERE hrn <= 28)",
    *summary_ctes("htrain", "ho"), forecast_cte("ho", HOLD),
    "pairs AS (SELECT f.*, t.y FROM fc_ho f JOIN htest t ON f.sku_id = t.sku_id AND f.h = t.h)",
)


def metric_sql(band: bool = True) -> str:
    cols = [
        "ROUND(AVG(ABS(y - yhat)), 4) AS MAE",
        "ROUND(SQRT(AVG(ABS(y - yhat) * ABS(y - yhat))), 4) AS RMSE",
        "ROUND(COALESCE(AVG(CASE WHEN ABS(y) > 1e-8 THEN ABS((y - yhat) / y) END) * 100, 0.0), 4) AS MAPE",
        "ROUND(CASE WHEN SUM(ABS(y)) > 1e-8 THEN SUM(ABS(y - yhat)) / SUM(ABS(y)) * 100 ELSE 0.0 END, 4) AS WMAPE",
        "ROUND(AVG(ABS(y - yhat) / ((ABS(y) + ABS(yhat)) / 2 + 1e-8)) * 100, 4) AS SMAPE",
        "COUNT(*) AS n_obs",
    ]
    if band:
        cols += ["ROUND(AVG(CASE WHEN y >= lo AND y <= hi THEN 1.0 ELSE 0.0 END), 4) AS PI_Coverage",
                 "ROUND(AVG(hi - lo), 4) AS PI_Width"]
    return ", ".join(cols)


sql("L01_holdout_metrics", f"SELECT model_used, {metric_sql()} FROM pairs GROUP BY model_used", *HOLDOUT_CTES)
sql("L08_per_sku_metrics", f"SELECT sku_id, model_used, {metric_sql(False)} FROM pairs GROUP BY sku_id, model_used",
    *HOLDOUT_CTES)
sql("L09_compare_models", """
SELECT model_used, ROUND(WMAPE, 6) AS WMAPE, improvement_pct, improvement_pct >= 15 AS target_met FROM (
  SELECT model_used, WMAPE,
         CASE WHEN b = 0 THEN 0.0 ELSE ROUND((b - WMAPE) / b * 100, 2) END AS improvement_pct FROM (
    SELECT model_used, WMAPE, (SELECT WMAPE FROM macro WHERE model_used = 'mean') AS b FROM macro))""",
    *HOLDOUT_CTES,
    f"per_sku AS (SELECT sku_id, model_used, {metric_sql(False)} FROM pairs GROUP BY sku_id, model_used)",
    "macro AS (SELECT model_used, AVG(WMAPE) AS WMAPE FROM per_sku GROUP BY model_used)")

QS = (0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9)
qcols = ", ".join(f"quantile_cont(sales, {q}) OVER ({FR} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS q{int(q * 100):02d}"
                  for q in QS)
pcols = ", ".join(f"AVG(GREATEST(CAST({q} AS DOUBLE) * (sales - q{int(q * 100):02d}), "
                  f"(CAST({q} AS DOUBLE) - 1.0) * (sales - q{int(q * 100):02d}))) AS pinball_q{int(q * 100):02d}"
                  for q in QS)
psum = " + ".join(f"pinball_q{int(q * 100):02d}" for q in QS)
sql("L10_pinball_multitask", f"""
SELECT store_id, {", ".join(f"ROUND(pinball_q{int(q * 100):02d}, 6) AS pinball_q{int(q * 100):02d}" for q in QS)},
       ROUND(pinball, 6) AS pinball, ROUND(aux_mse, 6) AS aux_mse,
       ROUND(0.7 * pinball + 0.3 * aux_mse, 6) AS multitask_loss FROM (
  SELECT *, (0.0 + {psum}) / 7 AS pinball FROM (
    SELECT store_id, {pcols}, AVG(POW(price - price_prev, 2)) AS aux_mse FROM (
      SELECT sku_id, store_id, date, sales, price, {qcols}, lag(price, 1) OVER ({FR}) AS price_prev FROM panel)
    WHERE q50 IS NOT NULL GROUP BY store_id))""")

# ================================================================= K06 normal equations
_X = ["1.0", "l1", "l2", "l7", "l14"]
_g = ", ".join(f"{R(f'SUM({_X[i]} * {_X[j]})')} AS g{i}{j}" for i in range(5) for j in range(i, 5))
_b = ", ".join(f"{R(f'SUM({_X[i]} * sales)')} AS b{i}" for i in range(5))
sql("K06_normal_equations", f"""
SELECT sku_id, {_g}, {_b}, {R('SUM(sales * sales)')} AS yty, COUNT(*) AS n FROM (
  SELECT sku_id, sales, lag(sales, 1) OVER w AS l1, lag(sales, 2) OVER w AS l2, lag(sales, 7) OVER w AS l7,
         lag(sales, 14) OVER w AS l14 FROM dense WINDOW w AS (PARTITION BY sku_id ORDER BY date))
WHERE l14 IS NOT NULL GROUP BY sku_id""", *DAILY_CTES)

_lagged = ", ".join(f"lag(e{i}, {l}) OVER w AS e{i}_{l}" for i in (0, 1) for l in range(1, 16))
_sums = ", ".join(f"SUM(e{i} * e{i}_{l}) AS g{i}_{l}" for i in (0, 1) for l in range(1, 16))


def _kpss(i: int) -> str:
    lags = f"FLOOR(4 * POW(n{i} / 100.0, 0.25))"
    spread = " + ".join([f"g{i}_0"] + [f"CASE WHEN {lags} >= {l} THEN 2 * (1 - {l} / ({lags} + 1)) * COALESCE(g{i}_{l}, 0) ELSE 0 END"
                                       for l in range(1, 16)])
    return f"CASE WHEN {spread} > 1e-9 THEN s{i} / (n{i} * ({spread})) ELSE 0 END AS kpss_{i}"


sql("K06_unit_root_tests", f"""
SELECT sku_id, n, {R('strength')} AS strength, seasonal_d, {R('kpss_0')} AS kpss_0, {R('kpss_1')} AS kpss_1,
       CASE WHEN kpss_0 <= 0.463 THEN 0 WHEN kpss_1 <= 0.463 THEN 1 ELSE 2 END AS d
FROM (SELECT sku_id, n, strength, seasonal_d, {_kpss(0)}, {_kpss(1)} FROM (
  SELECT sku_id, COUNT(*) AS n, MAX(strength) AS strength, MAX(seasonal_d) AS seasonal_d, COUNT(e0) AS n0, COUNT(e1) AS n1,
         SUM(c0 * c0) AS s0, SUM(c1 * c1) AS s1, SUM(e0 * e0) AS g0_0, SUM(e1 * e1) AS g1_0, {_sums}
  FROM (SELECT *, {_lagged}, CASE WHEN e0 IS NOT NULL THEN SUM(e0) OVER w END AS c0,
               CASE WHEN e1 IS NOT NULL THEN SUM(e1) OVER w END AS c1
        FROM (SELECT *, x0 - AVG(x0) OVER (PARTITION BY sku_id) AS e0, x1 - AVG(x1) OVER (PARTITION BY sku_id) AS e1 FROM steps)
        WINDOW w AS (PARTITION BY sku_id ORDER BY date ROWS UNBOUNDED PRECEDING)) GROUP BY sku_id))""",
    *DAILY_CTES,
    """strengths AS (SELECT sku_id, strength, CAST(strength > 0.64 AS INTEGER) AS seasonal_d FROM (
  SELECT sku_id, CASE WHEN SUM(q) - SUM(s) * SUM(s) / SUM(n) > 1e-9
                 THEN (SUM(s * s / n) - SUM(s) * SUM(s) / SUM(n)) / (SUM(q) - SUM(s) * SUM(s) / SUM(n)) ELSE 0 END AS strength
  FROM (SELECT sku_id, day, COUNT(*) AS n, SUM(x) AS s, SUM(x * x) AS q FROM (
    SELECT sku_id, dayofweek(date) AS day, sales - AVG(sales) OVER v AS x, COUNT(*) OVER v AS k FROM dense
    WINDOW v AS (PARTITION BY sku_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE k = 7 GROUP BY ALL)
  GROUP BY sku_id))""",
    """steps AS (SELECT *, x0 - lag(x0) OVER (PARTITION BY sku_id ORDER BY date) AS x1 FROM (
  SELECT sku_id, date, strength, seasonal_d, CASE WHEN seasonal_d = 1 THEN sales - lag(sales, 7) OVER (PARTITION BY sku_id ORDER BY date)
         ELSE sales END AS x0 FROM dense JOIN strengths USING (sku_id)))""")

sql("D18_interval_from_samples", f"""
SELECT sku_id, date, {R('AVG(sales)')} AS mean, {R('quantile_cont(sales, 0.025)')} AS lower,
       {R('quantile_cont(sales, 0.975)')} AS upper FROM panel GROUP BY sku_id, date""")
