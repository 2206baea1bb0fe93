"""Registered queries for planner analytics (Q), drift (L02-L07), anomalies (M), graph (N), signals (O)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skucast.plans.catalog import finish, panel, query
from skucast.plans.catalog_models import daily_dense
from skucast.sources.tables import read_table

KEYS = ["sku_id", "store_id"]
EVENT_SPLIT = "2024-01-25"  # events: first 24 days are the reference, the last 6 the current window


def _trend_forecast(spark, sf):
    from skucast.operators.forecast import forecast_all
    return forecast_all(daily_dense(spark, sf), 14, ("trend_naive",))


# ================================================================= Q
@query("Q01_kpis")
def q_kpis(spark, sf):
    from skucast.operators.analytics import kpis
    return finish(kpis(panel(spark, sf)))


@query("Q02_history")
def q_history(spark, sf):
    from skucast.operators.analytics import history
    return finish(history(panel(spark, sf).select(*KEYS, "date", "sales", "promo"), 60))


@query("Q03_seasonality")
def q_seasonality(spark, sf):
    from skucast.operators.analytics import seasonality
    return finish(seasonality(panel(spark, sf)))


@query("Q04_portfolio")
def q_portfolio(spark, sf):
    from skucast.operators.analytics import portfolio
    return finish(portfolio(panel(spark, sf)))


@query("Q05_risk_bands")
def q_risk(spark, sf):
    from skucast.operators.analytics import risk_bands
    return finish(risk_bands(panel(spark, sf)))


@query("Q06_insights")
def q_insights(spark, sf):
    from skucast.operators.analytics import insights
    return finish(insights(panel(spark, sf), forecast=_trend_forecast(spark, sf)))


@query("Q07_forecast_summary")
def q_forecast_summary(spark, sf):
    from skucast.operators.analytics import forecast_summary
    return finish(forecast_summary(_trend_forecast(spark, sf)))


# ================================================================= L02-L07
def _events_split(spark, sf):
    ev = read_table(spark, sf, "events").select("ts", "value")
    split = F.lit(EVENT_SPLIT).cast("timestamp_ntz")  # ts is timestamp_ntz: no session time zone involved
    return ev.where(F.col("ts") < split), ev.where(F.col("ts") >= split)


@query("L02_L04_drift_events")
def q_drift_events(spark, sf):
    from skucast.operators.drift import detect_drift
    ref, cur = _events_split(spark, sf)
    return detect_drift(ref, cur, "value", exact_up_to=0)  # asymptotic at every size, as its SQL


@query("L03_ks_events")
def q_ks_events(spark, sf):
    from skucast.operators.drift import ks_two_sample
    ref, cur = _events_split(spark, sf)
    return finish(ks_two_sample(ref, cur, "value", exact_up_to=0))


@query("L04_L05_drift_panel")
def q_drift_panel(spark, sf):
    from skucast.operators.drift import detect_drift, reference_current
    from skucast.session import cut_lineage
    ref, cur = reference_current(cut_lineage(panel(spark, sf).select(*KEYS, "date", "sales")), 0.8)
    return detect_drift(ref, cur, "sales", exact_up_to=0)


@query("D06_dist_stats")
def q_dist_stats(spark, sf):
    from skucast.operators.drift import dist_stats
    return finish(dist_stats(panel(spark, sf), "sales"))


@query("L06_L07_retrain_plan")
def q_retrain(spark, sf):
    from skucast.operators.drift import detect_drift, is_stale, retrain_plan
    from skucast.operators.features import split_fraction
    p = panel(spark, sf, reuse=True)
    # registry: one artifact per category, "trained" at the end of its last sales day
    registry = p.groupBy(F.col("category").alias("model")).agg(
        F.max(F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).alias("trained_at"))
    now = p.select(F.max("date").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).scalar()
    stale = is_stale(registry, now, 24)
    from skucast.session import cut_lineage
    s = cut_lineage(split_fraction(p.select(*KEYS, "date", "sales"), 0.8))
    drift = detect_drift(s.where("is_train"), s.where("NOT is_train"), "sales", exact_up_to=0)
    return retrain_plan(drift, stale)


# ================================================================= M
@query("M01_anomaly_features")
def q_anomaly_features(spark, sf):
    from skucast.operators.anomaly import anomaly_features
    return finish(anomaly_features(panel(spark, sf).select(*KEYS, "date", "sales")))


@query("M03_stat_anomaly")
def q_stat_anomaly(spark, sf):
    from skucast.operators.anomaly import stat_anomaly
    return stat_anomaly(panel(spark, sf).select(*KEYS, "date", "sales"))


@query("M05_anomaly_summary")
def q_anomaly_summary(spark, sf):
    from skucast.operators.anomaly import anomaly_summary, detect_anomalies
    flagged = detect_anomalies(panel(spark, sf).select(*KEYS, "date", "sales"), with_forest=False)
    return finish(anomaly_summary(flagged))


@query("M06_anomaly_report")
def q_anomaly_report(spark, sf):
    from skucast.operators.anomaly import anomaly_report, detect_anomalies
    flagged = detect_anomalies(panel(spark, sf).select(*KEYS, "date", "sales"), with_forest=False)
    return anomaly_report(flagged)


@query("M06_anomaly_points")
def q_anomaly_points(spark, sf):
    from skucast.operators.anomaly import anomaly_points, detect_anomalies
    flagged = detect_anomalies(panel(spark, sf).select(*KEYS, "date", "sales"), with_forest=False)
    return finish(anomaly_points(flagged))


@query("M02_M04_isolation_forest")
def q_isolation_forest(spark, sf):
    from skucast.operators.anomaly import detect_anomalies
    flagged = detect_anomalies(panel(spark, sf).select(*KEYS, "date", "sales"), with_forest=True)
    return flagged.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"),
                                      F.count_if("if_anomaly").alias("n_isolation_forest"),
                                      F.count_if("stat_anomaly").alias("n_statistical"),
                                      F.count_if("is_anomaly").alias("n_anomalies"))


def _forest(spark, sf):
    """M04 as the pipeline runs it: both detectors, materialised."""
    from skucast.operators.anomaly import detect_anomalies
    from skucast.session import cut_lineage
    return cut_lineage(detect_anomalies(panel(spark, sf).select(*KEYS, "date", "sales"), with_forest=True))


@query("M04_forest_counts")
def q_forest_counts(spark, sf):
    """The part of M04 that SQL can state: rows and statistical flags, and that the forest flags its 5 % share."""
    t = _forest(spark, sf).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("stat_anomaly").alias("n_statistical"),
        F.count_if("if_anomaly").alias("_f"), F.count_if("is_anomaly").alias("_a"))
    share = (F.col("_f") <= F.ceil(F.col("n_rows") * 0.05)) & (F.col("_a") <= F.col("_f") + F.col("n_statistical"))
    return t.select(*KEYS, "n_rows", "n_statistical", (share & (F.col("_a") >= F.greatest("_f", "n_statistical"))).alias("share_kept"))


@query("M05_anomaly_summary_forest")
def q_anomaly_summary_forest(spark, sf):
    from skucast.operators.anomaly import anomaly_summary
    return finish(anomaly_summary(_forest(spark, sf)))


@query("M06_anomaly_report_forest")
def q_anomaly_report_forest(spark, sf):
    from skucast.operators.anomaly import anomaly_report
    return anomaly_report(_forest(spark, sf))


@query("M06_anomaly_points_forest")
def q_anomaly_points_forest(spark, sf):
    from skucast.operators.anomaly import anomaly_points
    return finish(anomaly_points(_forest(spark, sf)))


@query("M07_zero_runs")
def q_zero_runs(spark, sf):
    from skucast.operators.anomaly import zero_runs
    from skucast.operators.panel import densify
    dense = densify(panel(spark, sf).select(*KEYS, "date", "sales"), KEYS)
    return zero_runs(dense, 3, KEYS, include_open=True)


# ================================================================= N
@query("N01_correlation_edges")
def q_edges(spark, sf):
    """Edges; where no pair passes, all edges of the complete graph."""
    from skucast.operators.graph import correlation_edges
    return finish(correlation_edges(panel(spark, sf, reuse=True), 0.5, fallback=True))


@query("N02_complete_graph_sums")
def q_complete_sums(spark, sf):
    """Joined and added up without its edges: each node's degree and the sum of its neighbours' mean sales."""
    from skucast.operators.graph import correlation_graph, node_features
    p = panel(spark, sf, reuse=True)
    graph = correlation_graph(p, 0.5)
    return finish(graph.neighbour_sums(node_features(p), ["mean"]).join(graph.degrees(), "node"))


@query("N01_correlation_edges_low")
def q_edges_low(spark, sf):
    """A threshold that pairs of these tables pass (at 0.5 none does: the complete graph)."""
    from skucast.operators.graph import correlation_edges
    return finish(correlation_edges(panel(spark, sf, reuse=True), 0.02, fallback=False))


@query("N03_node_features")
def q_nodes(spark, sf):
    from skucast.operators.graph import node_features
    return finish(node_features(panel(spark, sf, reuse=True)))


@query("N04_propagate")
def q_propagate(spark, sf):
    from skucast.operators.graph import correlation_graph, node_features, propagate
    p = panel(spark, sf, reuse=True)
    graph = correlation_graph(p, 0.5)
    return finish(propagate(node_features(p), None if graph.complete else graph.edges, hops=2))


@query("N04_propagate_low")
def q_propagate_low(spark, sf):
    from skucast.operators.graph import correlation_edges, node_features, propagate
    p = panel(spark, sf, reuse=True)
    return finish(propagate(node_features(p), correlation_edges(p, 0.02, fallback=False), hops=2))


# ================================================================= O
@query("O04_lexicon_scores")
def q_lexicon(spark, sf):
    from skucast.operators.signals import DISPLAY_CHARS, lexicon_score
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    s = lexicon_score(docs)
    return finish(s.select("doc_id", F.left("text", F.lit(DISPLAY_CHARS)).alias("display"),
                           "n_pos", "n_neg", "label", "score"))


@query("O01_sentiment_signal")
def q_signal(spark, sf):
    from skucast.operators.signals import events_scored, sentiment_signal
    return finish(sentiment_signal(events_scored(read_table(spark, sf, "events"))))


@query("O02_O03_enrich_sentiment")
def q_enrich(spark, sf):
    from skucast.operators.signals import enrich_sentiment, events_scored, sentiment_signal
    scored = events_scored(read_table(spark, sf, "events"))
    sig = sentiment_signal(scored)
    days = scored.agg(F.min("date").alias("d0"), F.max("date").alias("d1")).select(
        F.explode(F.sequence("d0", F.date_add("d1", 2))).alias("date"))
    return finish(enrich_sentiment(days, sig))


@query("O03_enrich_panel")
def q_enrich_panel(spark, sf):
    """O03 on a panel: events by type and day, with the signal of all scored events of the day."""
    from skucast.operators.signals import enrich_sentiment, events_scored, sentiment_signal
    events = read_table(spark, sf, "events")
    by_day = events.groupBy("event_type", F.col("ts").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total_value"))
    return finish(enrich_sentiment(by_day, sentiment_signal(events_scored(events))), 4)


@query("L03_ks_by_sku")
def q_ks_by_sku(spark, sf):
    """The last 28 days of every SKU against the 28 before, with exact p-values."""
    from skucast.operators.drift import ks_by_key
    from skucast.plans.catalog_models import daily_dense
    daily = daily_dense(spark, sf)
    age = F.row_number().over(Window.partitionBy("sku_id").orderBy(F.desc("date")))
    tail = daily.withColumn("_age", age).where("_age <= 56")
    return finish(ks_by_key(tail.where("_age > 28"), tail.where("_age <= 28"), ["sku_id"], "sales"))


@query("O05_commentary")
def q_commentary(spark, sf):
    from skucast.operators.analytics import kpis
    from skucast.operators.signals import commentary
    return finish(commentary(_trend_forecast(spark, sf), kpis(panel(spark, sf), ["sku_id"])))


@query("O02_O04_conversation_signal")
def q_conversation_signal(spark, sf):
    """O02 + O04 + O01 on the conversations table: the texts of a conversation play the role of a
    day's headlines (conv_id as the grouping key)."""
    from skucast.operators.signals import explode_headlines, lexicon_score, sentiment_signal
    conv = read_table(spark, sf, "conversations")
    # text lists per conversation, at most 8 texts per list, so a long conversation never becomes
    # one huge array in one task; the signal aggregates all lists of a conversation
    lists = (conv.groupBy("conv_id", F.floor(F.col("turn") / 8).alias("_bucket"))
                 .agg(F.collect_list("text").alias("headlines")))
    texts = lexicon_score(explode_headlines(lists, "headlines", "conv_id"))
    sig = sentiment_signal(texts, "conv_id")
    stats = texts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_texts"),
                                         F.count_if(F.col("label") == "POSITIVE").alias("n_positive"),
                                         F.min(F.length("display")).alias("min_display_len"))
    return finish(stats.join(sig, "conv_id"))
