"""DuckDB oracle SQL of the file sources and sinks: what the files must read back as."""

from __future__ import annotations

from skucast.plans.oracle import DENSE_CTES, R, sql  # noqa: F401
from skucast.plans.oracle_models import DAILY_CTES, H, fc_select, forecast_cte, summary_ctes

_SPAN = """span AS (SELECT MIN(date) AS d0, MAX(date) AS d1 FROM panel)"""
_GRID = """grid AS (SELECT k.sku_id, k.store_id, CAST(t.i AS INTEGER) AS i, COALESCE(CAST(p.sales AS INTEGER), 0) AS sales
  FROM (SELECT DISTINCT sku_id, store_id FROM panel) k CROSS JOIN span CROSS JOIN range(0, CAST(d1 - d0 AS INTEGER) + 1) t(i)
  LEFT JOIN panel p ON p.sku_id = k.sku_id AND p.store_id = k.store_id AND p.date = d0 + CAST(t.i AS INTEGER))"""
sql("A01_A06_load_m5", f"""
SELECT g.sku_id, g.store_id, DATE '2011-01-29' + i AS date, CAST(sales AS DOUBLE) AS sales,
       CASE WHEN i % 5 = 0 OR i % 7 = 0 THEN 1 ELSE 0 END AS promo, {R('COALESCE(w.price, 2.0)')} AS price,
       split_part(g.sku_id, '_', 1) AS category, split_part(g.sku_id, '_', 1) || '_' || split_part(g.sku_id, '_', 2) AS dept_id
FROM grid g LEFT JOIN (SELECT sku_id, store_id, CAST(date - d0 AS INTEGER) // 7 AS w, MAX(price) AS price FROM panel, span GROUP BY ALL) w
  ON w.sku_id = g.sku_id AND w.store_id = g.store_id AND w.w = i // 7
WHERE i > (SELECT MAX(i) FROM grid) - 365""", _SPAN, _GRID)
sql("A01_A04_wide_days", """
SELECT store_id, DATE '2011-01-29' + i AS date, SUM(sales) AS sales, COUNT_IF(sales > 0) AS n_sold,
       (SELECT SUM(sales) FROM grid WHERE store_id = 'ASIA' AND i > (SELECT MAX(i) FROM grid) - 30) AS asia_30_days
FROM grid GROUP BY ALL""", _SPAN, _GRID)
sql("A07_m5_sample", f"""
SELECT sku_id, store_id, date, GREATEST(sales - 20, 0.0) AS sales, CAST(promo AS INTEGER) AS promo,
       {R('CASE WHEN promo = 0 THEN price ELSE 2.0 END')} AS price, category, dept_id FROM panel""")

_FAV = """fav AS (SELECT CAST(length(split_part(sku_id, '_', 1)) * 100 + CAST(split_part(sku_id, '_', 2) AS INTEGER) AS VARCHAR) AS sku_id,
  CAST(length(store_id) AS VARCHAR) AS store_id, date, GREATEST(sales - 30, 0.0) AS sales, promo, category FROM panel)"""
sql("A08_A09_B06_favorita", f"""
SELECT sku_id, store_id, category, COUNT(*) AS n, {R('SUM(sales)')} AS sales, SUM(promo) AS promo, 1.0 AS price FROM fav GROUP BY ALL""", _FAV)
sql("A10_A11_mapped", f"""
SELECT sku_id, 'S1' AS store_id, 'General' AS category, COUNT(*) AS n, {R('SUM(sales)')} AS sales, {R('MAX(price)')} AS price, 0 AS promo
FROM panel GROUP BY sku_id""")
sql("A12_A14_cache", """
SELECT store_id, COUNT(*) AS n, COUNT(DISTINCT sku_id) AS n_skus, MAX(date) AS last_date, 0 AS dropped FROM panel GROUP BY store_id""")

_ERRORS = ("SELECT 'M5' AS dataset, '{m}' AS model, ROUND(AVG(ABS(sales - {p})), 4) AS MAE, ROUND(SQRT(AVG(POW(sales - {p}, 2))), 4) AS RMSE, "
           "COUNT(*) AS n_obs, ROUND(SUM(ABS(sales - {p})) / SUM(ABS(sales)) * 100, 4) AS headline_WMAPE FROM panel")
sql("A15_A16_Q10_Q11_reports", f"""
SELECT *, (SELECT ROUND(SUM(ABS(sales - sales * 0.9)) / SUM(ABS(sales)) * 100, 4) FROM panel) AS less_WMAPE
FROM ({_ERRORS.format(m='PRICE', p='price')} UNION ALL {_ERRORS.format(m='LESS', p='(sales * 0.9)')})""")
sql("A17_A18_registry", f"""
SELECT 'M5' AS dataset, 'model of ' || sku_id AS model, sku_id, {R('AVG(sales)')} AS WMAPE, COUNT(*) AS n_obs,
       (SELECT COUNT(*) FROM panel) AS logged_rows,
       'at ' || (SELECT arg_min(sku_id, (m, 'at ' || sku_id)) FROM (SELECT sku_id, AVG(sales) AS m FROM panel GROUP BY sku_id)) AS best
FROM panel GROUP BY sku_id""")
sql("A19_forecast_table", fc_select("all"), *DAILY_CTES, *summary_ctes("dense", "all"), forecast_cte("all", H))
_FR = "PARTITION BY sku_id, store_id ORDER BY date"
sql("B14_E18_feature_matrix", f"""
SELECT sku_id, {", ".join(f"ROUND(SUM(COALESCE({c}, 0.0)), 4) AS {c}" for c in ("lag_1", "lag_7", "lag_14", "lag_28", "promo", "price"))},
       COUNT(*) AS n, 6 AS n_columns, 38 AS n_catalogue
FROM (SELECT sku_id, promo, price, {", ".join(f"lag(sales, {n}) OVER ({_FR}) AS lag_{n}" for n in (1, 7, 14, 28))} FROM panel) GROUP BY sku_id""")
sql("F02_sort_panel", "SELECT COUNT(*) AS n_rows, 0 AS out_of_order FROM panel")
sql("F07_union_all", f"""
SELECT sku_id, store_id, COUNT(*) AS n, {R('SUM(sales)')} AS sales FROM (
  SELECT * FROM panel WHERE promo = 1 UNION ALL SELECT * FROM panel WHERE promo = 0 UNION ALL SELECT * FROM panel WHERE sales > 60) GROUP BY ALL""")
_META = ("COUNT(*) AS n_rows, COUNT(DISTINCT sku_id) AS n_skus, COUNT(DISTINCT store_id) AS n_stores, COUNT(DISTINCT category) AS n_categories, "
         "MIN(date) AS date_min, MAX(date) AS date_max")
sql("Q08_datasets", f"SELECT {_META}, 'M5' AS dataset FROM panel UNION ALL SELECT {_META}, 'FAVORITA' FROM fav", _FAV)
sql("Q09_sku_page", """
SELECT sku_id, COUNT(*) OVER () AS total FROM (SELECT DISTINCT sku_id FROM panel WHERE starts_with(sku_id, 'PROMO') AND store_id = 'ASIA')
ORDER BY sku_id LIMIT 2""")
