"""DuckDB oracle SQL, one statement per registered query (same column names and rounding).

Every statement starts from the driver tables through the ``panel`` CTE, the SQL twin of
``skucast.sources.tables.demand_panel``.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

PANEL_CTE = """panel AS (
  SELECT sku_id, store_id, date, sales, promo, price,
         split_part(sku_id, '_', 1) AS category,
         split_part(sku_id, '_', 1) || '_' || split_part(sku_id, '_', 2) AS dept_id
  FROM (
    SELECT p.p_type || '_' || CAST(p.p_size % 3 + 1 AS VARCHAR) || '_001' AS sku_id,
           r.r_name AS store_id,
           CAST(l.l_shipdate AS DATE) AS date,
           SUM(l.l_quantity) AS sales,
           CAST(MAX(CASE WHEN l.l_discount >= 0.08 THEN 1 ELSE 0 END) AS INTEGER) AS promo,
           ROUND(CAST(SUM(CAST(ROUND(l.l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (SUM(l.l_quantity) * 100.0), 6) AS price
    FROM lineitem l
    JOIN part p ON l.l_partkey = p.p_partkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN nation n ON s.s_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey
    GROUP BY 1, 2, 3) x)"""

WK = "PARTITION BY sku_id, store_id ORDER BY date"


def with_panel(body: str, *ctes: str) -> str:
    extra = "".join(",\n" + c for c in ctes)
    return f"WITH {PANEL_CTE}{extra}\n{body}"


def sql(name: str, body: str, *ctes: str) -> None:
    ORACLE[name] = with_panel(body, *ctes)


def R(expr: str, d: int = 6) -> str:
    return f"ROUND({expr}, {d})"


# ================================================================= panel, B, C, D
sql("P00_panel", "SELECT sku_id, store_id, date, sales, promo, price, category, dept_id FROM panel")

sql("B01_B07_normalise", """
SELECT sku_id, store_id, date,
       GREATEST(COALESCE(TRY_CAST(CAST(sales AS VARCHAR) AS DOUBLE), 0.0), 0.0) AS sales,
       CAST(CASE WHEN promo = 1 THEN 1 ELSE 0 END AS INTEGER) AS promo,
       COALESCE(CASE WHEN promo = 0 THEN price END, 2.0) AS price,
       category, dept_id
FROM panel""")

sql("B08_filter_panel", "SELECT * FROM panel WHERE store_id = 'ASIA' AND category = 'ECONOMY'")

sql("B09_filter_or_all", """
SELECT store_id, COUNT(*) AS n, 'hit' AS "case" FROM panel
WHERE store_id = 'EUROPE' OR NOT EXISTS (SELECT 1 FROM panel WHERE store_id = 'EUROPE') GROUP BY store_id
UNION ALL
SELECT store_id, COUNT(*) AS n, 'miss' AS "case" FROM panel
WHERE store_id = 'NOWHERE' OR NOT EXISTS (SELECT 1 FROM panel WHERE store_id = 'NOWHERE') GROUP BY store_id""")

sql("B10_min_history", """
SELECT sku_id, store_id, COUNT(*) AS n_rows FROM panel GROUP BY sku_id, store_id HAVING COUNT(date) >= 400""")

sql("B11_top_skus", """
SELECT p.sku_id, SUM(sales) AS total_sales, COUNT(*) AS n_rows FROM panel p
WHERE p.sku_id IN (SELECT sku_id FROM panel GROUP BY sku_id ORDER BY SUM(sales) DESC, sku_id LIMIT 5)
GROUP BY p.sku_id""")

sql("B12_list_skus", """
SELECT DISTINCT sku_id FROM panel WHERE store_id = 'AFRICA' AND starts_with(sku_id, 'ECONOMY')
ORDER BY sku_id LIMIT 2""")

sql("B15_promo_days", "SELECT * FROM panel WHERE promo = 1")

sql("B16_winsorise", """
SELECT p.sku_id, p.store_id, p.date, LEAST(p.sales, c.cap) AS sales
FROM panel p JOIN (SELECT sku_id, quantile_cont(sales, 0.99) AS cap FROM panel GROUP BY sku_id) c
ON p.sku_id = c.sku_id""")

sql("B17_first_skus", """
SELECT sku_id, store_id, date, sales FROM panel
WHERE sku_id IN (SELECT DISTINCT sku_id FROM panel ORDER BY sku_id LIMIT 3)""")

HOLIDAY_CTES = ("""years AS (
  SELECT UNNEST(range(CAST(year(MIN(date)) AS BIGINT), CAST(year(MAX(date)) + 2 AS BIGINT))) AS y FROM panel)""",
                """rules AS (
  SELECT y, make_date(y, 1, 1) AS date, 'New Year''s Day' AS holiday, TRUE AS obs FROM years
  UNION ALL SELECT y, CAST(make_date(y, 1, 1) + CAST((1 - isodow(make_date(y, 1, 1)) + 7) % 7 + 14 AS INTEGER) AS DATE),
         'Martin Luther King Jr. Day', FALSE FROM years
  UNION ALL SELECT y, CAST(make_date(y, 2, 1) + CAST((1 - isodow(make_date(y, 2, 1)) + 7) % 7 + 14 AS INTEGER) AS DATE),
         'Washington''s Birthday', FALSE FROM years
  UNION ALL SELECT y, CAST(last_day(make_date(y, 5, 1)) - CAST((isodow(last_day(make_date(y, 5, 1))) - 1 + 7) % 7 AS INTEGER) AS DATE),
         'Memorial Day', FALSE FROM years
  UNION ALL SELECT y, make_date(y, 6, 19), 'Juneteenth National Independence Day', TRUE FROM years WHERE y >= 2021
  UNION ALL SELECT y, make_date(y, 7, 4), 'Independence Day', TRUE FROM years
  UNION ALL SELECT y, CAST(make_date(y, 9, 1) + CAST((1 - isodow(make_date(y, 9, 1)) + 7) % 7 AS INTEGER) AS DATE),
         'Labor Day', FALSE FROM years
  UNION ALL SELECT y, CAST(make_date(y, 10, 1) + CAST((1 - isodow(make_date(y, 10, 1)) + 7) % 7 + 7 AS INTEGER) AS DATE),
         'Columbus Day', FALSE FROM years
  UNION ALL SELECT y, make_date(y, 11, 11), 'Veterans Day', TRUE FROM years
  UNION ALL SELECT y, CAST(make_date(y, 11, 1) + CAST((4 - isodow(make_date(y, 11, 1)) + 7) % 7 + 21 AS INTEGER) AS DATE),
         'Thanksgiving', FALSE FROM years
  UNION ALL SELECT y, make_date(y, 12, 25), 'Christmas Day', TRUE FROM years)""",
                """holidays AS (SELECT * FROM (
  SELECT date, holiday FROM rules
  UNION ALL
  SELECT CASE WHEN isodow(date) = 6 THEN CAST(date - 1 AS DATE) ELSE CAST(date + 1 AS DATE) END AS date,
         holiday || ' (observed)' AS holiday
  FROM rules WHERE obs AND isodow(date) IN (6, 7))
  WHERE year(date) BETWEEN (SELECT MIN(y) FROM years) AND (SELECT MAX(y) - 1 FROM years))""")

sql("C06_holiday_dim", "SELECT date, holiday FROM holidays", *HOLIDAY_CTES)

sql("C06_holidays", """
SELECT store_id, CAST(CASE WHEN h.date IS NULL THEN 0 ELSE 1 END AS INTEGER) AS is_holiday,
       COUNT(*) AS n_rows, SUM(sales) AS sales
FROM panel p LEFT JOIN (SELECT DISTINCT date FROM holidays) h ON p.date = h.date
GROUP BY 1, 2""", *HOLIDAY_CTES)

sql("D01_daily_series", "SELECT sku_id, date, SUM(sales) AS sales FROM panel GROUP BY sku_id, date")

sql("D02_sku_stats", f"""
SELECT sku_id, {R('AVG(sales)')} AS sku_mean, {R('STDDEV_SAMP(sales)')} AS sku_std, MAX(sales) AS sku_max,
       {R('MEDIAN(sales)')} AS sku_median, {R('STDDEV_SAMP(sales) / (AVG(sales) + 1e-8)')} AS sku_cv
FROM panel GROUP BY sku_id""")

sql("D19_metadata", """
SELECT COUNT(*) AS n_rows, COUNT(DISTINCT sku_id) AS n_skus, COUNT(DISTINCT store_id) AS n_stores,
       COUNT(DISTINCT category) AS n_categories, MIN(date) AS date_min, MAX(date) AS date_max FROM panel""")

sql("D05_distinct_sorted", """
SELECT DISTINCT 'sku_id' AS kind, sku_id AS value FROM panel
UNION ALL SELECT DISTINCT 'store_id', store_id FROM panel
UNION ALL SELECT DISTINCT 'category', category FROM panel""")

DENSE_CTES = ("""span AS (SELECT sku_id, store_id, MIN(date) AS d0, MAX(date) AS d1 FROM panel GROUP BY 1, 2)""",
              """grid AS (SELECT sku_id, store_id,
                 CAST(UNNEST(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM span)""")

sql("K01_densify", """
SELECT g.sku_id, g.store_id, g.date, COALESCE(p.sales, 0.0) AS sales
FROM grid g LEFT JOIN panel p ON g.sku_id = p.sku_id AND g.store_id = p.store_id AND g.date = p.date""",
    *DENSE_CTES)

# ================================================================= E: features
DATE_FEATS = """CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
       CAST(weekofyear(date) AS INTEGER) AS week_of_year, CAST(month(date) AS INTEGER) AS month,
       CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year,
       CAST(CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
       CAST(CASE WHEN day(date) = 1 THEN 1 ELSE 0 END AS INTEGER) AS is_month_start,
       CAST(CASE WHEN last_day(date) = date THEN 1 ELSE 0 END AS INTEGER) AS is_month_end,
       ROUND(sin(CAST(date - (SELECT MIN(date) FROM panel) AS DOUBLE) * (2 * pi()) / 7), 6) AS sin_week,
       ROUND(cos(CAST(date - (SELECT MIN(date) FROM panel) AS DOUBLE) * (2 * pi()) / 7), 6) AS cos_week,
       ROUND(sin(CAST(date - (SELECT MIN(date) FROM panel) AS DOUBLE) * (2 * pi()) / 365.25), 6) AS sin_year,
       ROUND(cos(CAST(date - (SELECT MIN(date) FROM panel) AS DOUBLE) * (2 * pi()) / 365.25), 6) AS cos_year"""

sql("E01_E03_date_features", f"SELECT sku_id, store_id, date, sales, promo, price, {DATE_FEATS} FROM panel")


def lag_roll_cols(lags=(1, 7, 14, 28), windows=(7, 14, 28)) -> str:
    cols = [f"lag(sales, {n}) OVER ({WK}) AS lag_{n}" for n in lags]
    for w in windows:
        fr = f"({WK} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        cols.append(f"{R(f'AVG(sales) OVER {fr}')} AS roll_mean_{w}")
        cols.append(f"{R(f'COALESCE(STDDEV_SAMP(sales) OVER {fr}, 0.0)')} AS roll_std_{w}")
        cols.append(f"MAX(sales) OVER {fr} AS roll_max_{w}")
    return ",\n       ".join(cols)


PROMO_COLS = f"""CAST(COALESCE(lead(promo, 7) OVER ({WK}), 0) AS DOUBLE) AS promo_next_7,
       CAST(SUM(promo) OVER ({WK} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) AS promo_rolling,
       {R(f"COALESCE(CASE WHEN lag(price, 1) OVER ({WK}) = 0 THEN NULL ELSE (price - lag(price, 1) OVER ({WK})) / lag(price, 1) OVER ({WK}) END, 0.0)")} AS price_change_pct,
       {R(f"price / NULLIF(AVG(price) OVER ({WK} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 0)")} AS price_vs_mean"""

sql("E04_E07_lags_rolling", f"SELECT sku_id, store_id, date, sales,\n       {lag_roll_cols()} FROM panel")

sql("E08_E11_promo_price", f"SELECT sku_id, store_id, date, promo, price, {PROMO_COLS} FROM panel")

ENC_CTE = """enc AS (
  SELECT sku_id, CAST(DENSE_RANK() OVER (ORDER BY sku_id) - 1 AS INTEGER) AS sku_id_enc FROM (SELECT DISTINCT sku_id FROM panel)),
enc_s AS (
  SELECT store_id, CAST(DENSE_RANK() OVER (ORDER BY store_id) - 1 AS INTEGER) AS store_id_enc FROM (SELECT DISTINCT store_id FROM panel))"""

sql("E12_encode_ids", """
SELECT p.sku_id, p.store_id, p.date, e.sku_id_enc, s.store_id_enc
FROM panel p JOIN enc e ON p.sku_id = e.sku_id JOIN enc_s s ON p.store_id = s.store_id""", ENC_CTE)

sql("E13_E14_log_time_idx", f"""
SELECT sku_id, store_id, date, sales, {R('ln(1 + sales)')} AS sales_log,
       CAST(ROW_NUMBER() OVER ({WK}) - 1 AS INTEGER) AS time_idx FROM panel""")

sql("E15_group_stats", f"""
SELECT p.sku_id, p.store_id, p.date, p.sales, {R('g.m')} AS sales_mean, {R('g.s')} AS sales_std,
       {R('g.s / (g.m + 1e-8)')} AS sales_cv
FROM panel p JOIN (SELECT sku_id, AVG(sales) AS m, COALESCE(STDDEV_SAMP(sales), 1.0) AS s FROM panel GROUP BY sku_id) g
ON p.sku_id = g.sku_id""")

sql("E16_zscore", f"""
SELECT p.sku_id, p.store_id, p.date, p.price, {R('(p.price - g.m) / (g.s + 1e-8)')} AS price_norm
FROM panel p JOIN (SELECT sku_id, AVG(price) AS m, STDDEV_SAMP(price) AS s FROM panel GROUP BY sku_id) g
ON p.sku_id = g.sku_id""")

sql("E17_build_features", f"""
SELECT * FROM (
  SELECT f.*, {R('st.m')} AS sku_mean, {R('st.s')} AS sku_std, st.mx AS sku_max, {R('st.med')} AS sku_median,
         {R('st.s / (st.m + 1e-8)')} AS sku_cv, e.sku_id_enc, es.store_id_enc
  FROM (SELECT sku_id, store_id, date, sales, promo, price,
               {DATE_FEATS},
               {lag_roll_cols()},
               {PROMO_COLS}
        FROM panel) f
  JOIN (SELECT sku_id, AVG(sales) AS m, STDDEV_SAMP(sales) AS s, MAX(sales) AS mx, MEDIAN(sales) AS med
        FROM panel GROUP BY sku_id) st ON f.sku_id = st.sku_id
  JOIN enc e ON f.sku_id = e.sku_id JOIN enc_s es ON f.store_id = es.store_id) x
WHERE lag_28 IS NOT NULL""", ENC_CTE)

sql("E20_diffs", f"""
SELECT sku_id, store_id, date, sales,
       COALESCE(sales - lag(sales, 1) OVER ({WK}), 0.0) AS change,
       {R(f'COALESCE((sales - lag(sales, 1) OVER ({WK})) / (ABS(lag(sales, 1) OVER ({WK})) + 1e-8), 0.0)')} AS pct_change
FROM panel""")

sql("E21_tail_rows", """
SELECT * FROM (SELECT sku_id, store_id, date, sales,
  CAST(ROW_NUMBER() OVER (PARTITION BY sku_id, store_id ORDER BY date DESC) AS INTEGER) AS rn_desc FROM panel)
WHERE rn_desc <= 7""")

sql("E22_split_last", """
SELECT sku_id, store_id, is_test, COUNT(*) AS n_rows, MIN(date) AS first_date FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sku_id, store_id ORDER BY date DESC) <= 28 AS is_test FROM panel)
GROUP BY 1, 2, 3""")

sql("E23_split_fraction", f"""
SELECT is_train, COUNT(*) AS n_rows, MAX(date) AS last_date, 'global' AS variant FROM (
  SELECT p.*, COALESCE(p.date <= (SELECT MAX(date) FROM cum WHERE c <= FLOOR((SELECT COUNT(*) FROM panel) * 0.8)), FALSE) AS is_train
  FROM panel p) GROUP BY is_train
UNION ALL
SELECT is_train, COUNT(*) AS n_rows, MAX(date) AS last_date, 'per_series' AS variant FROM (
  SELECT *, ROW_NUMBER() OVER ({WK}) <= FLOOR(COUNT(*) OVER (PARTITION BY sku_id, store_id) * 0.8) AS is_train FROM panel)
GROUP BY is_train""",
    """cum AS (SELECT date, SUM(n) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
  FROM (SELECT date, COUNT(*) AS n FROM panel GROUP BY date))""")

sql("E24_split_cutoff", f"""
SELECT sku_id, store_id, is_train, COUNT(*) AS n_rows FROM (
  SELECT *, t <= MAX(t) OVER () - 14 AS is_train FROM (SELECT *, ROW_NUMBER() OVER ({WK}) - 1 AS t FROM panel))
GROUP BY 1, 2, 3""")


def _load_all():
    """Import the modules that add further oracle statements."""
    from skucast.plans import oracle_analytics, oracle_models, oracle_sources  # noqa: F401

sql("C01_C02_calendar_price_joins", f"""
SELECT p.sku_id, p.store_id, p.date, p.sales, CAST(COALESCE(c.promo, 0) AS INTEGER) AS promo, c.wm_yr_wk,
       {R('COALESCE(w.sell_price, 2.0)', 9)} AS price
FROM panel p
LEFT JOIN (SELECT date, CAST(year(date) * 100 + weekofyear(date) AS INTEGER) AS wm_yr_wk, MAX(promo) AS promo
           FROM panel GROUP BY date) c ON p.date = c.date
LEFT JOIN (SELECT store_id, sku_id, CAST(year(date) * 100 + weekofyear(date) AS INTEGER) AS wm_yr_wk,
                  AVG(price) AS sell_price FROM panel GROUP BY 1, 2, 3) w
  ON w.store_id = p.store_id AND w.sku_id = p.sku_id AND w.wm_yr_wk = c.wm_yr_wk""")
