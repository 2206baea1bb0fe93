"""Daily text / external demand signals and forecast commentary (survey O01-O05, C07).

Text scoring is a word-list classifier written with built-in array functions over the whole
text (tokenise -> intersect with the word lists), so it stays inside whole-stage codegen.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Multiplier scale and clip range of the sentiment signal, display length of a text.
SIGNAL_SCALE, SIGNAL_MIN, SIGNAL_MAX, SIGNAL_DEFAULT = 0.3, 0.7, 1.3, 1.0
DISPLAY_CHARS = 60

# Word lists of the lexicon scorer (lower case).
POSITIVE_WORDS = [
    "good", "great", "excellent", "strong", "growth", "gain", "gains", "rise", "rising", "up", "high", "best",
    "positive", "success", "successful", "win", "improve", "improved", "boost", "record", "profit", "happy",
    "love", "benefit", "demand", "increase", "increased", "surge", "robust", "better",
]
NEGATIVE_WORDS = [
    "bad", "poor", "weak", "loss", "losses", "fall", "falling", "down", "low", "worst", "negative", "fail",
    "failure", "decline", "declined", "drop", "risk", "crisis", "shortage", "delay", "problem", "sad", "hate",
    "damage", "decrease", "decreased", "slump", "worse", "error", "recall",
]


def _word_pattern(words: Sequence[str]) -> str:
    """Whole-word alternation: a listed word not preceded or followed by a letter."""
    return r"(?<!\p{L})(?:" + "|".join(re.escape(w) for w in words) + r")(?!\p{L})"


def lexicon_score(df: DataFrame, text_col: str = "text", pos: Sequence[str] = POSITIVE_WORDS,
                  neg: Sequence[str] = NEGATIVE_WORDS) -> DataFrame:
    """Label and score per text. Hits = occurrences of a listed word as a whole letter run of
    the lower-cased text (the whole text, every occurrence counts); label POSITIVE when positive
    hits >= negative hits; score = (winning hits + 1) / (all hits + 2) in [0.5, 1).

    One regex pass extracts all lexicon hits; only that short hit list is classified."""
    hits = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(_word_pattern(list(pos) + list(neg))), 0)
    pos_a = F.array(*[F.lit(w) for w in pos])
    t = df.withColumn("_hits", hits)
    n_pos = F.size(F.filter("_hits", lambda w: F.array_contains(pos_a, w)))
    t = t.withColumns({"n_pos": n_pos, "n_neg": F.size("_hits") - n_pos}).drop("_hits")
    win = F.greatest("n_pos", "n_neg")
    return t.withColumns({
        "label": F.when(F.col("n_pos") >= F.col("n_neg"), F.lit("POSITIVE")).otherwise(F.lit("NEGATIVE")),
        "score": (win + 1) / (F.col("n_pos") + F.col("n_neg") + 2),
    })


def explode_headlines(df: DataFrame, list_col: str = "headlines", by: str = "date") -> DataFrame:
    """One row per text of a (date, array<string>) table; ``display`` holds the first 60
    characters for display (scoring always uses the whole ``text``)."""
    t = df.select(by, F.explode(list_col).alias("text"))
    return t.withColumn("display", F.left(F.col("text"), F.lit(DISPLAY_CHARS)))


def sentiment_signal(scored: DataFrame, by: str = "date") -> DataFrame:
    """Daily multiplier clip(1 + 0.3 * mean(+score for POSITIVE, -score otherwise), 0.7, 1.3)."""
    signed = F.when(F.col("label") == "POSITIVE", F.col("score")).otherwise(-F.col("score"))
    return scored.groupBy(by).agg(
        F.least(F.lit(SIGNAL_MAX), F.greatest(F.lit(SIGNAL_MIN), 1 + SIGNAL_SCALE * F.avg(signed)))
        .alias("demand_sentiment"))


def enrich_sentiment(df: DataFrame, signal: DataFrame, by: str = "date") -> DataFrame:
    """Left join the signal by date; days without texts get 1.0."""
    from skucast.operators.panel import join_external
    return join_external(df, signal, by, {"demand_sentiment": SIGNAL_DEFAULT})


def commentary(forecast: DataFrame, kpis: DataFrame | None = None, key: str = "sku_id",
               trend_cut: float = 0.05, cv_cut: float = 0.5) -> DataFrame:
    """Templated commentary per SKU from its forecast rows: average forecast, horizon, model,
    trend (last vs first step beyond +-5 % -> increasing / decreasing, else stable) and volatility
    (KPI cv > 0.5 -> high)."""
    f = forecast.groupBy(key).agg(
        F.avg("yhat").alias("avg_forecast"), F.max("h").alias("horizon"), F.max_by("model_used", "h").alias("model"),
        F.min_by("yhat", "h").alias("_first"), F.max_by("yhat", "h").alias("_last"))
    rel = F.try_divide(F.col("_last") - F.col("_first"), F.abs(F.col("_first")))
    f = f.withColumn("trend", F.when(rel > trend_cut, "increasing").when(rel < -trend_cut, "decreasing")
                     .otherwise("stable"))
    if kpis is not None:
        f = f.join(kpis.select(key, "cv"), key, "left")
        f = f.withColumn("volatility", F.when(F.col("cv") > cv_cut, "high").otherwise("low")).drop("cv")
    else:
        f = f.withColumn("volatility", F.lit("low"))
    # fixed values: the sentences of the report
    action = (F.when(F.col("trend") == "increasing", "Plan for increased inventory")
               .when(F.col("trend") == "decreasing", "Consider reducing safety stock")
               .otherwise("Maintain current inventory levels"))
    risk = (F.when(F.col("volatility") == "high", "High volatility detected - widen safety stock buffer")
             .otherwise("Normal volatility - standard reorder point recommended"))
    text = F.format_string(
        "Forecast Summary for %s (%d-day horizon). Model Used: %s. Avg Forecast: %s units/day. "
        "Demand Trend: %s. Insight: %s. Risk: %s.",
        F.col(key), F.col("horizon"), F.col("model"), F.round("avg_forecast", 1).cast("string"),
        F.initcap("trend"), action, risk)
    return f.select(key, "horizon", "model", "avg_forecast", "trend", "volatility", text.alias("commentary"))


def events_scored(events: DataFrame) -> DataFrame:
    """Map the events table onto scored texts: purchases and sign-ups are POSITIVE, other events
    NEGATIVE, score = value / 500 (capped at 1); one row per event, dated by its day."""
    return events.select(F.col("ts").cast("date").alias("date"),
                         F.when(F.col("event_type").isin("purchase", "signup"), "POSITIVE")
                          .otherwise("NEGATIVE").alias("label"),
                         F.least(F.col("value") / 500.0, F.lit(1.0)).alias("score"))
