"""Operator 4: quality rules with risk-controlled thresholds (DataFrame functions only).

Every rule is a ratio of a text with a fixed grid of cutoffs; it rejects texts above its cutoff. Cutoffs are
chosen per stratum from labelled holdouts: of the n different good holdout texts of a stratum, k lie above a cutoff
(copies of a text are no independent trials, so they count once). The verdict rejects what any rule rejects, so
each rule may lose ``max_loss`` divided by the number of rules. A cutoff is certified if the exact binomial tail
P(Bin(n, share) <= k) is at most the test level, that is, if the exact upper bound of its false-rejection rate is at
most that share. The test level is ``risk`` divided by the number of all tests (strata x rules x cutoffs), so with
probability 1 - risk the verdict of every stratum rejects at most ``max_loss`` of its good texts. The lowest certified
cutoff of a stratum and rule is used; a rule without one rejects nothing there.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: a null or empty text has no words, fails the base rule and is
not kept; a null stratum is a stratum of its own; repeated ids keep a row each, and a label counts for every different
text of its id; without labels only the base rule decides. Further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skucast.llm.common import written

SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rule -> (numerator, denominator) columns and its cutoffs.
RULES = {
    "symbols_per_word": ("n_symbols", "n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2)),
    "repeated_words": ("n_repeat_words", "n_words", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)),
    "repeated_lines": ("n_dup_lines", "n_lines", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)),
    "upper_case": ("n_upper", "word_chars", (0.1, 0.15, 0.2, 0.3, 0.4, 0.5)),
    "exclamations_per_word": ("n_exclaim", "n_words", (0.05, 0.1, 0.2, 0.3, 0.5)),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, every occurrence included."""
    windows = F.when(F.size(words) < 3, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))),
                    lambda i: F.concat_ws(" ", F.slice(words, i, 3))))
    return windows


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts of every whole text beside the columns ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("_t"))
    df = df.select(*keep, "_t", F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"),
                   F.filter(F.split("_t", "\n"), lambda x: F.length(_without(x, SPACES)) > 0).alias("_l"))
    df = df.withColumn("_g", _repeat_words(F.col("_w")))
    # Windows sorted with their positions: equal windows are neighbours. Sorted only where some window repeats.
    ordered = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), ordered))
    at = F.array_sort(F.filter(F.transform("_s", lambda s, j: F.when(
        (s["g"] == F.get(F.col("_s"), j - 1)["g"]) | (s["g"] == F.get(F.col("_s"), j + 1)["g"]), s["i"])),
        lambda i: i.isNotNull()))
    df = df.withColumn("_p", at)
    # A repeated window at position p covers p, p+1 and p+2: three words, less those the window before covers.
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(
        F.lit(3), F.coalesce(p - F.get(F.col("_p"), j - 1), F.lit(3)))), F.lit(0), lambda a, n: a + n)
    n_chars, bare = F.length("_t"), _without(F.col("_t"), SPACES)
    return df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (n_chars - F.length(_without(F.col("_t"), "#*$%&|<>"))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (n_chars - F.length(_without(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_upper"),
        (n_chars - F.length(_without(F.col("_t"), "!"))).cast("long").alias("n_exclaim"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _ratio(rule: str) -> Column:
    top, bottom, _ = RULES[rule]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


def _log_factorial(n: Column) -> Column:
    """log(n!): exact to 20, then Stirling's series (its next term is under 1e-12)."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = (x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k up to the mean: the terms fall from k downwards and are summed until they vanish,
    a number in proportion to the root of n."""
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    odds = (1 - p) / p
    width = F.ceil(F.lit(64) + 12 * F.sqrt(n * p)).cast("long")
    terms = F.when(k >= 1, F.sequence(k, F.greatest(k - width, F.lit(1).cast("long")), F.lit(-1).cast("long"))).otherwise(
        F.array().cast("array<bigint>"))

    def add(a, i):
        t = a["t"] * i / (n - i + 1) * odds
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    start = F.struct(first.alias("t"), first.alias("s"))
    return F.aggregate(terms, start, add, lambda a: F.least(a["s"], F.lit(1.0)))


def certified_cutoffs(good: DataFrame, stratum: str, max_loss: float, risk: float) -> DataFrame:
    """(stratum, rule, cutoff) from the counts of the different labelled good holdout texts: strata x rules rows."""
    share = max_loss / len(RULES)
    tried = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _ratio(r).alias("x"), F.lit(c).alias("cutoff"))
                                for r in RULES for c in RULES[r][2]])).alias("e")
    per = (good.select(F.col(stratum).alias("stratum"), tried)
           .groupBy("stratum", "e.rule", "e.cutoff")
           .agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("e.x") > F.col("e.cutoff")).cast("long")).alias("k")))
    tests = per.select(F.count(F.lit(1))).scalar()
    # The tail at k = n * share is about one half: counts beyond cannot pass, so no longer sum is needed.
    tail = F.when(F.col("k") > F.col("n") * share, F.lit(1.0)).otherwise(
        binomial_tail(F.col("n"), F.col("k"), share))
    return (per.where(tail <= F.lit(risk) / tests)
            .groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff")))


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_loss: float = 0.02,
                     risk: float = 0.05, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, ``text_hash``, counts, base_failed, kept and the rules that reject it.

    Holdouts: every different labelled good text that passes the base rule. Rules and grids are fixed beforehand and
    nothing is fitted on labels, so no label is spent before the test. The counts of all texts are written once
    (a few numbers a text) and read for the holdouts and for the verdicts."""
    counts = written(text_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(stratum).alias("_stratum"), "text",
                                             F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")),
                                 "doc_id", "_stratum", "text_hash"), "rules")
    counts = counts.withColumn("base_failed", base_failed())
    good = labels.where(F.col("quality") == 1).select(F.col(id_col).alias("doc_id")).distinct()
    hold = counts.where(~F.col("base_failed")).join(good, "doc_id", "left_semi").dropDuplicates(["_stratum", "text_hash"])
    cuts = certified_cutoffs(hold, "_stratum", max_loss, risk).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    out = counts.join(cuts, counts["_stratum"].eqNullSafe(cuts["stratum"]), "left")
    hits = F.filter(F.array(*[F.when(_ratio(r) > F.element_at("cuts", F.lit(r)), F.lit(r)) for r in RULES]),
                    lambda r: r.isNotNull())
    out = out.withColumn("rejected_by", hits)
    return out.select("doc_id", "text_hash", *BASE, "base_failed",
                      (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")
