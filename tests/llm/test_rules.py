"""Quality rules: counts and verdicts against plain Python, exact binomial tails, defined results."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from skucast.llm import rules


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered))


TEXTS = ["", None, "one", "a b c a b c a b c", "a a a a a", "x # * $ % & | < > y", "l\nl\n\n \nl\nm", "é\x85ü \x0bb\x0cc\r\nd",
         "word " * 60, "🙂 smile 🙂 smile 🙂 smile", " ".join(f"w{i}" for i in range(80)), "a b c d a b c e a b c " * 9000]


def test_counts_match_plain(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS kept")
    got = {r.doc_id: tuple(r)[1:6] for r in rules.text_counts(df.select("doc_id", "text"), "doc_id").collect()}
    assert got == {i: counts(t) for i, t in enumerate(TEXTS)}


def test_binomial_tail(spark):
    cases = [(n, k, p) for n in (1, 7, 300, 5000, 90000) for k in (0, 1, 3, 19, 22, 250) for p in (0.004, 0.2) if k <= n * p]
    for n, k, p in cases:
        (got,) = spark.range(1).select(rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()
        want = sum(math.exp(math.log(math.comb(n, i)) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-300)


def make(n, bad, lang, start):
    return [(start + i, " ".join(f"{lang}{i}w{k}" + "###" * (i < bad) for k in range(60)), lang) for i in range(n)]


def test_cutoffs_hold_their_promise_by_stratum(spark):
    # en: no good text has signs; de: every third has, so no cutoff may reject them; fr: too few labels to certify
    docs = make(2400, 0, "en", 0) + make(900, 300, "de", 2500) + make(5, 0, "fr", 4000)
    docs += [(5000 + k, make(1, 1, f"{lang}x", 0)[0][1], lang) for k, lang in enumerate(("en", "de", "fr", None))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d[0], 1) for d in docs if d[0] < 5000], "doc_id long, quality int")
    got = {r.doc_id: (r.kept, r.rejected_by) for r in rules.quality_verdicts(df, labels).collect()}
    assert got[5000] == (False, ["symbols_per_word"])
    assert [got[i][0] for i in (5001, 5002, 5003)] == [True] * 3
    assert all(got[d[0]][0] for d in docs if d[0] < 5000)


def test_defined_results(spark):
    schema = "doc_id long, text string, lang string"
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(None, long, None), (1, None, "en"), (1, long, "en"), (1, long, "en"), (2, "", None)]
    df = spark.createDataFrame(docs, schema).withColumn("n_words", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, None), (None, 1), (1, 0)], "doc_id long, quality int")
    for labels in (none, odd):
        got = sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in rules.quality_verdicts(df, labels).collect())
        assert got == [("1", 0, True, False), ("1", 60, False, True), ("1", 60, False, True), ("2", 0, True, False),
                       ("None", 60, False, True)]
    assert rules.quality_verdicts(spark.createDataFrame([], schema), none).count() == 0


def test_the_verdict_of_all_rules_keeps_the_promise(spark):
    """Four rules that each reject 1.3 % of the good texts, others each: none may, together they reject 5.2 %."""
    rng = random.Random(2)

    def text(i):
        words = [f"t{i}w{k}" for k in range(60)]
        kind = i // 65 if i < 4 * 65 else None
        if kind == 0:
            words = [w + "###" for w in words]
        elif kind == 1:
            words = [w + "!" for w in words]
        elif kind == 2:
            words = [w.upper() + "ABCDEF" for w in words]
        elif kind == 3:
            words = words[:40] + words[:20]
        return " ".join(words)

    docs = [(i, text(i), "en") for i in range(5000)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(5000)], "doc_id long, quality int")
    assert rules.quality_verdicts(df, labels).where("NOT kept").count() <= 100


def test_copies_are_no_trials(spark):
    good = " ".join(f"w{k}" for k in range(60))
    noisy = " ".join(f"w{k}###" for k in range(60))
    df = spark.createDataFrame([(i, good, "en") for i in range(6000)] + [(9999, noisy, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(6000)], "doc_id long, quality int")
    assert rules.quality_verdicts(df, labels).where("doc_id = 9999").first().kept
