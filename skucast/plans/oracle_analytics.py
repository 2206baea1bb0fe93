"""DuckDB oracle SQL for planner analytics (Q), drift (L02-L07), anomalies (M), graph (N), signals (O)."""

from __future__ import annotations

from skucast.plans.oracle import DENSE_CTES, ORACLE, R, sql
from skucast.plans.oracle_models import DAILY_CTES, forecast_cte, summary_ctes

FR = "PARTITION BY sku_id, store_id ORDER BY date"
TREND_FC = (*DAILY_CTES, *summary_ctes("dense", "tr"), forecast_cte("tr", 14, ("trend_naive",)))

# ================================================================= Q
sql("Q01_kpis", f"""
SELECT sku_id, store_id, {R('avg_sales')} AS avg_sales, peak_sales, total_sales, n_days, {R('last7_avg')} AS last7_avg,
       {R('prev7_avg')} AS prev7_avg, {R('std / (avg_sales + 1e-8)')} AS cv, {R('tp')} AS trend_pct,
       CASE WHEN tp > 2 THEN 'up' WHEN tp < -2 THEN 'down' ELSE 'flat' END AS trend FROM (
  SELECT *, (last7_avg - prev7_avg) / (prev7_avg + 1e-8) * 100 AS tp FROM (
    SELECT sku_id, store_id, AVG(sales) AS avg_sales, MAX(sales) AS peak_sales, SUM(sales) AS total_sales,
           COUNT(DISTINCT date) AS n_days, STDDEV_SAMP(sales) AS std,
           AVG(CASE WHEN rn <= 7 THEN sales END) AS last7_avg,
           AVG(CASE WHEN rn > LEAST(n, 14) - 7 AND rn <= LEAST(n, 14) THEN sales END) AS prev7_avg
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sku_id, store_id ORDER BY date DESC) AS rn,
                 COUNT(*) OVER (PARTITION BY sku_id, store_id) AS n FROM panel)
    GROUP BY sku_id, store_id))""")

sql("Q02_history", """
SELECT sku_id, store_id, date, sales, promo, promo = 1 AS is_promo FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sku_id, store_id ORDER BY date DESC) AS rn FROM panel) WHERE rn <= 60""")

WD = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MO = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
buckets = ", ".join([f"('weekday', {i}, '{n}')" for i, n in enumerate(WD)] + [f"('month', {i}, '{n}')" for i, n in enumerate(MO)])
sql("Q03_seasonality", f"""
SELECT k.sku_id, b.profile, CAST(b.idx AS INTEGER) AS bucket_idx, b.name AS bucket, {R('COALESCE(s.avg_sales, 0.0)')} AS avg_sales
FROM (SELECT DISTINCT sku_id FROM panel) k CROSS JOIN (VALUES {buckets}) b(profile, idx, name)
LEFT JOIN (SELECT sku_id, 'weekday' AS profile, isodow(date) - 1 AS idx, AVG(sales) AS avg_sales FROM panel GROUP BY 1, 2, 3
           UNION ALL SELECT sku_id, 'month', month(date) - 1, AVG(sales) FROM panel GROUP BY 1, 2, 3) s
ON s.sku_id = k.sku_id AND s.profile = b.profile AND s.idx = b.idx""")

PORTFOLIO = "SELECT sku_id, AVG(sales) AS a, SUM(sales) AS t, STDDEV_SAMP(sales) AS s FROM panel GROUP BY sku_id"
sql("Q04_portfolio", f"""
SELECT sku_id, {R('a')} AS avg_sales, t AS total_sales, {R('s')} AS std_sales, {R('s / (a + 1e-8)')} AS cv
FROM ({PORTFOLIO})""")

sql("Q05_risk_bands", f"""
SELECT sku_id, {R('a')} AS avg_sales, {R('s')} AS std_sales, {R('cv')} AS cv,
       CASE WHEN cv IS NULL THEN NULL WHEN cv <= 0.3 THEN 'Low' WHEN cv <= 0.6 THEN 'Medium' ELSE 'High' END AS risk
FROM (SELECT *, s / (a + 1e-8) AS cv FROM ({PORTFOLIO}))""")

sql("Q06_insights", f"""
SELECT * FROM (SELECT 'high_demand' AS rule, sku_id, {R('a')} AS value FROM port ORDER BY t DESC, sku_id LIMIT 2)
UNION ALL SELECT * FROM (SELECT 'stockout_risk', sku_id, {R('s / (a + 1e-8)')} FROM port WHERE s / (a + 1e-8) > 0.5
                         ORDER BY sku_id LIMIT 2)
UNION ALL SELECT * FROM (SELECT 'slow_mover', sku_id, {R('a')} FROM port ORDER BY a, sku_id LIMIT 2)
UNION ALL SELECT 'demand_spike', NULL, {R('(f / s - 1) * 100')} FROM (
  SELECT (SELECT AVG(yhat) FROM fc_tr) AS f, (SELECT AVG(sales) FROM panel) AS s) WHERE f > s * 1.25""",
    *TREND_FC, f"port AS ({PORTFOLIO})")

sql("Q07_forecast_summary", f"""
SELECT sku_id, {R('AVG(yhat)')} AS avg_forecast, {R('MAX(yhat)')} AS max_forecast, MIN(model_used) AS model_used
FROM fc_tr GROUP BY sku_id""", *TREND_FC)


# ================================================================= L02-L07
def drift_ctes(ref_sql: str, cur_sql: str) -> tuple[str, ...]:
    qs = ", ".join(str(i / 10) for i in range(11))
    bucket = """CASE WHEN v IS NULL OR v < e[1] OR v > e[len(e)] THEN NULL WHEN v = e[len(e)] THEN len(e) - 2
                ELSE len(list_filter(e, lambda x: x <= v)) - 1 END"""
    return (
        f"r AS ({ref_sql})", f"c AS ({cur_sql})",
        f"edges AS (SELECT list_sort(list_distinct(quantile_cont(v, [{qs}]))) AS e FROM r)",
        "nr AS (SELECT COUNT(v) AS n FROM r)", "nc AS (SELECT COUNT(v) AS n FROM c)",
        f"rb AS (SELECT b, COUNT(*) AS cnt FROM (SELECT {bucket} AS b FROM r, edges) GROUP BY b)",
        f"cb AS (SELECT b, COUNT(*) AS cnt FROM (SELECT {bucket} AS b FROM c, edges) GROUP BY b)",
        "dim AS (SELECT UNNEST(range(0, len(e) - 1)) AS b FROM edges)",
        """psi AS (SELECT CASE WHEN (SELECT len(e) FROM edges) < 2 THEN 0.0
                    ELSE COALESCE(SUM((cp - rp) * ln(cp / rp)), 0.0) END AS psi FROM (
  SELECT GREATEST(COALESCE(rb.cnt, 0) / ((SELECT n FROM nr) + 1e-8), 1e-6) AS rp,
         GREATEST(COALESCE(cb.cnt, 0) / ((SELECT n FROM nc) + 1e-8), 1e-6) AS cp
  FROM dim LEFT JOIN rb ON dim.b = rb.b LEFT JOIN cb ON dim.b = cb.b))""",
        "va AS (SELECT v, COUNT(*) AS a FROM r WHERE v IS NOT NULL GROUP BY v)",
        "vb AS (SELECT v, COUNT(*) AS b FROM c WHERE v IS NOT NULL GROUP BY v)",
        """vc AS (SELECT COALESCE(va.v, vb.v) AS v, COALESCE(a, 0) AS a, COALESCE(b, 0) AS b
  FROM va FULL OUTER JOIN vb ON va.v = vb.v)""",
        """cum AS (SELECT SUM(a) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS ca,
  SUM(b) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cb FROM vc)""",
        "nn AS (SELECT CAST(SUM(a) AS DOUBLE) AS n1, CAST(SUM(b) AS DOUBLE) AS n2 FROM vc)",
        "kd AS (SELECT MAX(ABS(ca / n1 - cb / n2)) AS ks_d FROM cum, nn)",
        "kl AS (SELECT ks_d, ks_d * SQRT(n1 * n2 / (n1 + n2)) AS lam FROM kd, nn)",
        """ks AS (SELECT ks_d, CASE WHEN lam < 0.2 THEN 1.0 ELSE LEAST(1.0, GREATEST(0.0, 2 * (
  SELECT SUM(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) t(k))))
  END AS ks_p_value FROM kl)""",
        """st AS (SELECT (SELECT AVG(v) FROM r) AS rm, (SELECT AVG(v) FROM c) AS cm,
  (SELECT STDDEV_SAMP(v) FROM r) AS rsd, (SELECT STDDEV_SAMP(v) FROM c) AS csd)""",
        """drift AS (SELECT psi > 0.2 OR ks_p_value < 0.05 OR ABS(cm - rm) / (rm + 1e-8) > 0.3 AS drift_detected,
  ROUND(psi, 4) AS psi, ROUND(ks_p_value, 4) AS ks_p_value, ROUND(ABS(cm - rm) / (rm + 1e-8) * 100, 2) AS mean_change_pct,
  ROUND(ABS(csd - rsd) / (rsd + 1e-8) * 100, 2) AS std_change_pct, ROUND(rm, 3) AS ref_mean, ROUND(cm, 3) AS curr_mean,
  CAST(0.2 AS DOUBLE) AS threshold_psi, CAST(0.05 AS DOUBLE) AS threshold_ks FROM psi, ks, st)""",
    )


EV_REF = "SELECT value AS v FROM events WHERE ts < TIMESTAMP '2024-01-25 00:00:00'"
EV_CUR = "SELECT value AS v FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00'"
sql("L02_L04_drift_events", "SELECT * FROM drift", *drift_ctes(EV_REF, EV_CUR))
sql("L03_ks_events", f"SELECT {R('ks_d')} AS ks_d, {R('ks_p_value')} AS ks_p_value FROM ks", *drift_ctes(EV_REF, EV_CUR))

SPLIT_CTES = (
    """pcum AS (SELECT date, SUM(n) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnum
  FROM (SELECT date, COUNT(*) AS n FROM panel GROUP BY date))""",
    """psplit AS (SELECT p.*, COALESCE(p.date <= (SELECT MAX(date) FROM pcum
  WHERE cnum <= FLOOR((SELECT COUNT(*) FROM panel) * 0.8)), FALSE) AS is_train FROM panel p)""",
)
P_REF = "SELECT sales AS v FROM psplit WHERE is_train"
P_CUR = "SELECT sales AS v FROM psplit WHERE NOT is_train"
sql("L04_L05_drift_panel", "SELECT * FROM drift", *SPLIT_CTES, *drift_ctes(P_REF, P_CUR))

sql("D06_dist_stats", f"""
SELECT {R('AVG(sales)')} AS mean, {R('STDDEV_SAMP(sales)')} AS std, {R('quantile_cont(sales, 0.25)')} AS p25,
       {R('quantile_cont(sales, 0.5)')} AS p50, {R('quantile_cont(sales, 0.75)')} AS p75,
       {R('quantile_cont(sales, 0.95)')} AS p95 FROM panel""")

sql("L06_L07_retrain_plan", """
SELECT model, is_stale, last_trained_at, (SELECT drift_detected FROM drift) AS drift_detected,
       FALSE OR (SELECT drift_detected FROM drift) OR is_stale AS retrain FROM (
  SELECT category AS model,
         NOT BOOL_OR(epoch((SELECT MAX(date) FROM panel) + INTERVAL 1 DAY) - epoch(CAST(date AS TIMESTAMP) + INTERVAL 1 DAY)
                     < 24 * 3600) AS is_stale,
         MAX(CAST(date AS TIMESTAMP) + INTERVAL 1 DAY) AS last_trained_at
  FROM panel GROUP BY category)""", *SPLIT_CTES, *drift_ctes(P_REF, P_CUR))

# ================================================================= M
ANOM_FEATS = f"""SELECT sku_id, store_id, date, sales,
       COALESCE(lag(sales, 1) OVER ({FR}), 0.0) AS lag1, COALESCE(lag(sales, 7) OVER ({FR}), 0.0) AS lag7,
       AVG(sales) OVER ({FR} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS roll_mean_7,
       COALESCE(STDDEV_SAMP(sales) OVER ({FR} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0.0) AS roll_std_7,
       COALESCE(sales - lag(sales, 1) OVER ({FR}), 0.0) AS change,
       COALESCE((sales - lag(sales, 1) OVER ({FR})) / (ABS(lag(sales, 1) OVER ({FR})) + 1e-8), 0.0) AS pct_change,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month FROM panel"""
sql("M01_anomaly_features", f"""
SELECT sku_id, store_id, date, sales, lag1, lag7, {R('roll_mean_7')} AS roll_mean_7, {R('roll_std_7')} AS roll_std_7,
       {R('change')} AS change, {R('pct_change')} AS pct_change, day_of_week, month,
       {R('(sales - roll_mean_7) / (roll_std_7 + 1e-8)')} AS zscore FROM ({ANOM_FEATS})""")

STAT_CTE = """flag AS (
  SELECT p.sku_id, p.store_id, p.date, p.sales,
         ABS((p.sales - s.m) / (s.sd + 1e-8)) > 3 OR p.sales < s.q1 - 3 * (s.q3 - s.q1) OR p.sales > s.q3 + 3 * (s.q3 - s.q1)
           AS stat_anomaly
  FROM panel p JOIN (SELECT sku_id, store_id, AVG(sales) AS m, STDDEV_POP(sales) AS sd,
                            quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.75) AS q3
                     FROM panel GROUP BY 1, 2) s ON p.sku_id = s.sku_id AND p.store_id = s.store_id)"""
sql("M03_stat_anomaly", "SELECT * FROM flag", STAT_CTE)

sql("M05_anomaly_summary", """
SELECT CAST(SUM(n) AS BIGINT) AS total_points, CAST(SUM(a) AS BIGINT) AS anomalies_found,
       ROUND(SUM(a) / SUM(n) * 100, 2) AS anomaly_rate, COUNT_IF(anyf) AS skus_with_anomalies FROM (
  SELECT sku_id, COUNT(*) AS n, SUM(CAST(stat_anomaly AS BIGINT)) AS a, BOOL_OR(stat_anomaly) AS anyf
  FROM flag GROUP BY sku_id)""", STAT_CTE)

sql("M06_anomaly_report", """
SELECT sku_id, COUNT(*) AS n_anomalies, MIN(date) AS first_anomaly, MAX(date) AS last_anomaly,
       COUNT_IF(stat_anomaly) AS n_statistical, COUNT_IF(FALSE) AS n_isolation_forest
FROM flag WHERE stat_anomaly GROUP BY sku_id""", STAT_CTE)

sql("M06_anomaly_points", """
SELECT sku_id, store_id, strftime(date, '%Y-%m-%d') AS date, sales AS value, stat_anomaly, FALSE AS if_anomaly
FROM flag WHERE stat_anomaly""", STAT_CTE)

# The isolation forest as tables: the sample, ten levels of nodes, and the way of every row through every tree.
_F = ("sales", "lag1", "lag7", "roll_mean_7", "roll_std_7", "zscore", "change", "pct_change", "day_of_week", "month")
_DRAW = "list_reduce([seed, {c}, 0, 0], lambda a, b: (a * a + 48271 * a + b + 11) % 2147483647)"


def _level(k: int) -> tuple[str, ...]:
    lo, hi = ("[" + ", ".join(f"{fn}(x[{j}])" for j in range(1, len(_F) + 1)) + "]" for fn in ("MIN", "MAX"))
    draw = _DRAW.format(c="tree, node, j")
    return (
        f"""node{k} AS MATERIALIZED (SELECT *, CASE WHEN size > 1 AND {k} < depth THEN list_max([
      CASE WHEN hi[j] > lo[j] THEN {draw} * 16 + j - 1 ELSE -1 END for j in range(1, {len(_F) + 1})]) ELSE -1 END AS best FROM (
    SELECT s, seed, depth, tree, node, COUNT(*) AS size, {lo} AS lo, {hi} AS hi FROM lvl{k} JOIN rows USING (s, i) GROUP BY ALL))""",
        f"""cut{k} AS MATERIALIZED (SELECT s, tree, node, size, CASE WHEN best >= 0 THEN best % 16 + 1 END AS f,
    CASE WHEN best >= 0 THEN lo[best % 16 + 1] + ({_DRAW.format(c="tree, node, 100")} + 0.5::DOUBLE) / 2147483647::DOUBLE
      * (hi[best % 16 + 1] - lo[best % 16 + 1]) END AS t FROM node{k})""",
        f"""lvl{k + 1} AS MATERIALIZED (SELECT l.s, l.tree, 2 * l.node + CASE WHEN x[f] < t THEN 1 ELSE 2 END AS node, l.i
    FROM lvl{k} l JOIN cut{k} c USING (s, tree, node) JOIN rows USING (s, i) WHERE f IS NOT NULL)""",
    )


FOREST_CTES = (
    STAT_CTE,
    f"""rows AS MATERIALIZED (SELECT *, CAST(CEIL(LOG2(GREATEST(LEAST(n, 256), 2)) - 1e-9) AS INTEGER) AS depth,
    list_reduce([1] || [CAST(ord(c) AS BIGINT) for c in string_split(s, '')], lambda a, b: (a * 31 + b) % 2147483647) AS seed FROM (
  SELECT sku_id || '|' || store_id AS s, sku_id, store_id, date, ROW_NUMBER() OVER ({FR}) - 1 AS i,
         COUNT(*) OVER (PARTITION BY sku_id, store_id) AS n, [{", ".join(f"ROUND(CAST({c} AS DOUBLE), 6)" for c in _F)}] AS x
  FROM (SELECT *, (sales - roll_mean_7) / (roll_std_7 + 1e-8) AS zscore FROM ({ANOM_FEATS}))) WHERE n > 1)""",
    f"""lvl0 AS MATERIALIZED (SELECT s, tree, 0 AS node, i FROM (
  SELECT s, n, i, tree, {_DRAW.format(c="tree, i")} AS h FROM rows CROSS JOIN range(100) t(tree))
  QUALIFY ROW_NUMBER() OVER (PARTITION BY s, tree ORDER BY h, i) <= 256)""",
    *[c for k in range(9) for c in _level(k)],
    "cuts AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM cut{k}" for k in range(9)) + ")",
    "way0 AS (SELECT s, i, x, tree, 0 AS node FROM rows CROSS JOIN range(100) t(tree))",
    *[f"""way{k + 1} AS (SELECT s, i, x, tree, CASE WHEN f IS NULL THEN node WHEN x[f] < t THEN 2 * node + 1 ELSE 2 * node + 2 END AS node
  FROM way{k} LEFT JOIN cuts USING (s, tree, node))""" for k in range(8)],
    """paths AS MATERIALIZED (SELECT s, i, SUM(CAST(ROUND(1e6::DOUBLE * (FLOOR(LOG2(node + 1)) + CASE WHEN size > 2
    THEN 2.0::DOUBLE * (ln(size - 1) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * (size - 1) / size WHEN size = 2 THEN 1 ELSE 0 END)) AS BIGINT)) AS path
  FROM way8 JOIN cuts USING (s, tree, node) GROUP BY s, i)""",
    """verdicts AS MATERIALIZED (SELECT f.*, COALESCE(if_anomaly, FALSE) AS if_anomaly, stat_anomaly OR COALESCE(if_anomaly, FALSE) AS is_anomaly
  FROM flag f LEFT JOIN (SELECT sku_id, store_id, date, path < quantile_cont(path, 0.05) OVER (PARTITION BY s) AS if_anomaly
                         FROM rows JOIN paths USING (s, i)) g USING (sku_id, store_id, date))""",
)
sql("M02_M04_isolation_forest", """
SELECT sku_id, store_id, COUNT(*) AS n_rows, COUNT_IF(if_anomaly) AS n_isolation_forest, COUNT_IF(stat_anomaly) AS n_statistical,
       COUNT_IF(is_anomaly) AS n_anomalies FROM verdicts GROUP BY 1, 2""", *FOREST_CTES)
sql("M05_anomaly_summary_forest", """
SELECT CAST(SUM(n) AS BIGINT) AS total_points, CAST(SUM(a) AS BIGINT) AS anomalies_found,
       ROUND(SUM(a) / SUM(n) * 100, 2) AS anomaly_rate, COUNT_IF(anyf) AS skus_with_anomalies FROM (
  SELECT sku_id, COUNT(*) AS n, SUM(CAST(is_anomaly AS BIGINT)) AS a, BOOL_OR(is_anomaly) AS anyf
  FROM verdicts GROUP BY sku_id)""", *FOREST_CTES)
sql("M06_anomaly_report_forest", """
SELECT sku_id, COUNT(*) AS n_anomalies, MIN(date) AS first_anomaly, MAX(date) AS last_anomaly,
       COUNT_IF(stat_anomaly) AS n_statistical, COUNT_IF(if_anomaly) AS n_isolation_forest
FROM verdicts WHERE is_anomaly GROUP BY sku_id""", *FOREST_CTES)
sql("M06_anomaly_points_forest", """
SELECT sku_id, store_id, strftime(date, '%Y-%m-%d') AS date, sales AS value, stat_anomaly, if_anomaly
FROM verdicts WHERE is_anomaly""", *FOREST_CTES)

sql("M04_forest_counts", """
SELECT sku_id, store_id, COUNT(*) AS n_rows, COUNT_IF(stat_anomaly) AS n_statistical, TRUE AS share_kept
FROM flag GROUP BY 1, 2""", STAT_CTE)

sql("M07_zero_runs", f"""
SELECT sku_id, store_id, MIN(date) AS start, COUNT(*) AS length_days, MAX(island) = MAX(mx) AS is_open FROM (
  SELECT *, MAX(island) OVER (PARTITION BY sku_id, store_id) AS mx FROM (
    SELECT *, SUM(CASE WHEN sales <> 0 THEN 1 ELSE 0 END) OVER ({FR} ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT g.sku_id, g.store_id, g.date, COALESCE(p.sales, 0.0) AS sales FROM grid g
      LEFT JOIN panel p ON g.sku_id = p.sku_id AND g.store_id = p.store_id AND g.date = p.date)))
WHERE sales = 0 GROUP BY sku_id, store_id, island HAVING COUNT(*) >= 3""", *DENSE_CTES)

# ================================================================= N
def graph_ctes(cut: float) -> tuple[str, ...]:
    return (
        "dm AS (SELECT sku_id, date, AVG(sales) AS x FROM panel GROUP BY 1, 2)",
        "nodes AS (SELECT sku_id, CAST(ROW_NUMBER() OVER (ORDER BY sku_id) - 1 AS INTEGER) AS node FROM (SELECT DISTINCT sku_id FROM dm))",
        "nd AS (SELECT COUNT(DISTINCT date) AS d FROM panel)",
        """nst AS (SELECT n.node, n.sku_id, COALESCE(SUM(x), 0.0) AS sx, COALESCE(SUM(x * x), 0.0) AS sxx
  FROM nodes n LEFT JOIN dm ON dm.sku_id = n.sku_id GROUP BY 1, 2)""",
        """sxy AS (SELECT a.sku_id AS si, b.sku_id AS sj, SUM(a.x * b.x) AS sxy FROM dm a JOIN dm b
  ON a.date = b.date AND a.sku_id < b.sku_id GROUP BY 1, 2)""",
        """corr AS (SELECT i.node AS i, j.node AS j, i.sku_id AS sku_i, j.sku_id AS sku_j,
  ((SELECT d FROM nd) * COALESCE(s.sxy, 0.0) - i.sx * j.sx) /
  NULLIF(SQRT(((SELECT d FROM nd) * i.sxx - POW(i.sx, 2)) * ((SELECT d FROM nd) * j.sxx - POW(j.sx, 2))), 0) AS corr
  FROM nst i JOIN nst j ON i.node < j.node LEFT JOIN sxy s ON s.si = i.sku_id AND s.sj = j.sku_id)""",
        f"""edges0 AS (SELECT i AS src, j AS dst, sku_i AS src_sku, sku_j AS dst_sku, corr AS weight FROM corr WHERE ABS(corr) >= {cut}
  UNION ALL SELECT j, i, sku_j, sku_i, corr FROM corr WHERE ABS(corr) >= {cut})""",
        """edges AS (SELECT * FROM edges0 UNION ALL
  SELECT a.node, b.node, a.sku_id, b.sku_id, 1.0 FROM nodes a JOIN nodes b ON a.node <> b.node
  WHERE NOT EXISTS (SELECT 1 FROM edges0))""",
    )


GRAPH_CTES, LOW_CTES, HIGH_CTES = graph_ctes(0.5), graph_ctes(0.02), graph_ctes(0.12)
for _name, _ctes in (("N01_correlation_edges", GRAPH_CTES), ("N01_correlation_edges_low", LOW_CTES)):
    sql(_name, f"SELECT src, dst, src_sku, dst_sku, {R('weight')} AS weight FROM edges", *_ctes)

NODE_FEATS = (
    """nf AS (SELECT n.node, s.sku_id, s.mean, COALESCE(s.std, 0.0) AS std, s.mn AS min, s.mx AS max, s.q25, s.q75,
  COALESCE(CASE WHEN isnan(a.ac) THEN 0.0 ELSE a.ac END, 0.0) AS autocorr
  FROM (SELECT sku_id, AVG(sales) AS mean, STDDEV_SAMP(sales) AS std, MIN(sales) AS mn, MAX(sales) AS mx,
               quantile_cont(sales, 0.25) AS q25, quantile_cont(sales, 0.75) AS q75 FROM panel GROUP BY 1) s
  JOIN nodes n ON n.sku_id = s.sku_id
  LEFT JOIN (SELECT sku_id, CORR(x, prev) AS ac FROM (
    SELECT sku_id, x, lag(x, 1) OVER (PARTITION BY sku_id ORDER BY date) AS prev FROM dm) GROUP BY 1) a
  ON a.sku_id = s.sku_id)""",
)
FEATS = ["mean", "std", "min", "max", "q25", "q75", "autocorr"]
sql("N03_node_features", "SELECT node, sku_id, " + ", ".join(f"{R(c)} AS {c}" for c in FEATS) + " FROM nf",
    *GRAPH_CTES, *NODE_FEATS)

sql("N02_complete_graph_sums", f"""
SELECT dst AS node, {R('SUM(weight * mean)')} AS mean, {R('SUM(weight)')} AS degree FROM edges JOIN nf ON nf.node = src GROUP BY dst""",
    *GRAPH_CTES, *NODE_FEATS)

hop = lambda src, dst: f"""{dst} AS (SELECT c.dst AS node, """ + ", ".join(
    f"SUM(c.c * x.{k}) AS {k}" for k in FEATS) + f""" FROM coef c JOIN {src} x ON x.node = c.src GROUP BY c.dst)"""
for _name, _ctes in (("N04_propagate", GRAPH_CTES), ("N04_propagate_low", LOW_CTES)):
    sql(_name, "SELECT node, " + ", ".join(f"{R(k)} AS {k}" for k in FEATS) + " FROM h2",
        *_ctes, *NODE_FEATS,
        "e AS (SELECT src, dst, weight FROM edges UNION ALL SELECT node, node, 1.0 FROM nodes)",
        "deg AS (SELECT dst AS node, CASE WHEN SUM(weight) > 0 THEN POW(SUM(weight), -0.5) ELSE 0.0 END AS dinv FROM e GROUP BY dst)",
        """coef AS (SELECT e.src, e.dst, e.weight * s.dinv * d.dinv AS c FROM e
  JOIN deg s ON s.node = e.src JOIN deg d ON d.node = e.dst)""",
        hop("nf", "h1"), hop("h1", "h2"))

# ================================================================= O
POS = ["good", "great", "excellent", "strong", "growth", "gain", "gains", "rise", "rising", "up", "high", "best",
       "positive", "success", "successful", "win", "improve", "improved", "boost", "record", "profit", "happy",
       "love", "benefit", "demand", "increase", "increased", "surge", "robust", "better"]
NEG = ["bad", "poor", "weak", "loss", "losses", "fall", "falling", "down", "low", "worst", "negative", "fail",
       "failure", "decline", "declined", "drop", "risk", "crisis", "shortage", "delay", "problem", "sad", "hate",
       "damage", "decrease", "decreased", "slump", "worse", "error", "recall"]
pos_list = "[" + ", ".join(f"'{w}'" for w in POS) + "]"
neg_list = "[" + ", ".join(f"'{w}'" for w in NEG) + "]"
sql("O04_lexicon_scores", f"""
SELECT doc_id, display, n_pos, n_neg, CASE WHEN n_pos >= n_neg THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
       {R('(GREATEST(n_pos, n_neg) + 1) / (n_pos + n_neg + 2)')} AS score FROM (
  SELECT doc_id, "left"(text, 60) AS display,
         CAST(len(list_filter(tok, lambda t: list_contains({pos_list}, t))) AS INTEGER) AS n_pos,
         CAST(len(list_filter(tok, lambda t: list_contains({neg_list}, t))) AS INTEGER) AS n_neg FROM (
    SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda t: length(t) > 0) AS tok
    FROM documents))""")

SCORED = """scored AS (SELECT CAST(ts AS DATE) AS date,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
  LEAST(value / 500.0, 1.0) AS score FROM events)"""
SIGNAL = """sig AS (SELECT date, LEAST(1.3, GREATEST(0.7, 1 + 0.3 * AVG(CASE WHEN label = 'POSITIVE' THEN score ELSE -score END)))
  AS demand_sentiment FROM scored GROUP BY date)"""
sql("O01_sentiment_signal", f"SELECT date, {R('demand_sentiment')} AS demand_sentiment FROM sig", SCORED, SIGNAL)
sql("O02_O03_enrich_sentiment", f"""
SELECT d.date, {R('COALESCE(s.demand_sentiment, 1.0)')} AS demand_sentiment FROM (
  SELECT CAST(UNNEST(generate_series(MIN(date), MAX(date) + 2, INTERVAL 1 DAY)) AS DATE) AS date FROM scored) d
LEFT JOIN sig s ON s.date = d.date""", SCORED, SIGNAL)

sql("O03_enrich_panel", """
SELECT e.event_type, e.date, e.n_events, ROUND(e.total_value, 4) AS total_value,
       ROUND(COALESCE(g.demand_sentiment, 1.0), 4) AS demand_sentiment FROM (
  SELECT event_type, CAST(ts AS DATE) AS date, COUNT(*) AS n_events, SUM(value) AS total_value FROM events GROUP BY 1, 2) e
LEFT JOIN sig g ON g.date = e.date""", SCORED, SIGNAL)

# exact p for two samples of n values: 2 * sum (-1)^(k-1) C(2n, n - kh) / C(2n, n), h = n * D
sql("L03_ks_by_sku", f"""
SELECT sku_id, 28 AS n1, 28 AS n2, {R('h / 28.0')} AS ks_d, {R('LEAST(1.0, CASE WHEN h = 0 THEN 1.0 ELSE p END)')} AS ks_p_value FROM (
  SELECT sku_id, h, (SELECT 2 * SUM(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(2 * lgamma(29) - lgamma(29 - k * h) - lgamma(29 + k * h)))
                     FROM range(1, 29) t(k) WHERE k * h <= 28) AS p FROM (
    SELECT sku_id, MAX(ABS(c)) AS h FROM (
      SELECT sku_id, sales, SUM(SUM(CASE WHEN age > 28 THEN 1 ELSE -1 END)) OVER (PARTITION BY sku_id ORDER BY sales) AS c FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY sku_id ORDER BY date DESC) AS age FROM dense) WHERE age <= 56 GROUP BY sku_id, sales)
    GROUP BY sku_id))""", *DAILY_CTES)

sql("O05_commentary", f"""
SELECT sku_id, horizon, model, {R('avg_forecast')} AS avg_forecast, trend, volatility,
  printf('Forecast Summary for %s (%d-day horizon). Model Used: %s. Avg Forecast: %s units/day. Demand Trend: %s. Insight: %s. Risk: %s.',
         sku_id, horizon, model, CAST(ROUND(avg_forecast, 1) AS VARCHAR), upper(left(trend, 1)) || substr(trend, 2),
         CASE trend WHEN 'increasing' THEN 'Plan for increased inventory' WHEN 'decreasing' THEN 'Consider reducing safety stock'
              ELSE 'Maintain current inventory levels' END,
         CASE WHEN volatility = 'high' THEN 'High volatility detected - widen safety stock buffer'
              ELSE 'Normal volatility - standard reorder point recommended' END) AS commentary FROM (
  SELECT f.*, CASE WHEN rel > 0.05 THEN 'increasing' WHEN rel < -0.05 THEN 'decreasing' ELSE 'stable' END AS trend,
         CASE WHEN k.cv > 0.5 THEN 'high' ELSE 'low' END AS volatility FROM (
    SELECT sku_id, AVG(yhat) AS avg_forecast, CAST(MAX(h) AS INTEGER) AS horizon, MIN(model_used) AS model,
           (arg_max(yhat, h) - arg_min(yhat, h)) / NULLIF(ABS(arg_min(yhat, h)), 0) AS rel
    FROM fc_tr GROUP BY sku_id) f
  LEFT JOIN (SELECT sku_id, STDDEV_SAMP(sales) / (AVG(sales) + 1e-8) AS cv FROM panel GROUP BY sku_id) k
  ON k.sku_id = f.sku_id)""", *TREND_FC)

sql("O02_O04_conversation_signal", f"""
SELECT conv_id, COUNT(*) AS n_texts, COUNT_IF(label = 'POSITIVE') AS n_positive,
       CAST(MIN(length("left"(text, 60))) AS INTEGER) AS min_display_len,
       {R("LEAST(1.3, GREATEST(0.7, 1 + 0.3 * AVG(CASE WHEN label = 'POSITIVE' THEN score ELSE -score END)))")}
         AS demand_sentiment FROM (
  SELECT conv_id, text, CASE WHEN n_pos >= n_neg THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
         (GREATEST(n_pos, n_neg) + 1) / (n_pos + n_neg + 2) AS score FROM (
    SELECT conv_id, text,
           len(list_filter(tok, lambda t: list_contains({pos_list}, t))) AS n_pos,
           len(list_filter(tok, lambda t: list_contains({neg_list}, t))) AS n_neg FROM (
      SELECT conv_id, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda t: length(t) > 0) AS tok
      FROM conversations)))
GROUP BY conv_id""")


# ================================================================= wide twins: every part is a SKU
sql("N01_correlation_edges_wide", f"SELECT src, dst, src_sku, dst_sku, {R('weight')} AS weight FROM edges0", *HIGH_CTES)


def wide(text: str) -> str:
    narrow = "|| '_001' AS sku_id"
    if narrow not in text:
        raise ValueError("no panel in this statement")
    return text.replace(narrow, "|| '_' || lpad(CAST(p.p_partkey AS VARCHAR), 9, '0') AS sku_id")


ORACLE["N01_correlation_edges_wide"] = wide(ORACLE["N01_correlation_edges_wide"])
for _name in ("E12_encode_ids", "K02_K07_baselines"):
    ORACLE[f"{_name}_wide"] = wide(ORACLE[_name])
