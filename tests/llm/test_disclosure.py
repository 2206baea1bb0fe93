"""Disclosure: patterns against plain regular expressions, counts and verdicts against a plain program."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skucast.llm import disclosure

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        total = sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return True


def plain_spans(text):
    found = [(m.start(), k, m.end()) for k, p in enumerate(PLAIN.values()) for m in re.finditer(p, text)
             if passes(disclosure.BASE[k], m[0])]
    return [(s, e, disclosure.BASE[k]) for s, k, e in sorted(found)]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([*"@@..a1+- ()_%é0", "25", "255.", "256", "4111111111111111", "+12345678901", "x@y.z", "\n"]), max_size=30))
def test_patterns(parts):
    text = "".join(parts)
    assert disclosure.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a@", "@a", "+1", "1 ", "+", "a.", "1-"])
def test_long_runs_take_linear_time(unit):
    assert isinstance(disclosure.base_spans(unit * 200_000), list)


def plain(rows):
    """(base, spans, sanitised) by text, from counts over all different texts."""
    texts = {x or "" for x in rows}
    near = {x: disclosure.near_terms(x) for x in texts}
    words = {x: {m.lower() for m in re.findall(r"[^\W_]+", x)} for x in texts}
    held = {x: w | {t[:4] + "*" for t in w} for x, w in words.items()}

    def discloses(e, t):
        entity = [x for x in texts if e in near[x]]
        both = [x for x in entity if t in near[x][e] or (t.endswith("*") and any(w[:4] + "*" == t for w in near[x][e]))]
        if len(entity) < 3 or len(both) < 3:
            return False
        pmi = math.log2(len(both) * len(texts) / (len(entity) * sum(t in held[x] for x in texts)))
        return pmi >= 0.8 * math.log2(len(texts) / len(entity)) - 1e-9 and len(both) * pmi >= 24 - 1e-9

    out, cache = {}, {}
    told = lambda e, t: cache.setdefault((e, t), discloses(e, t))
    for x in texts:
        base, action = plain_spans(x), {}
        for e, terms in near[x].items():
            for t in terms:
                if told(e, t):
                    action[t] = action.get(t, False) or len(t) <= 4 or told(e, t[:4] + "*")
        extra = []
        for m in re.finditer(r"[^\W_]+", x):
            if m[0].lower() in action and all(m.end() <= s or m.start() >= e for s, e, _ in base):
                extra.append((m.start(), m.end(), "remove" if action[m[0].lower()] else "generalise"))
        spans = sorted(base + extra, key=lambda s: (s[0], disclosure.KINDS.index(s[2])))
        text = lambda s: ",".join(f"{k}:{a}:{b}" for a, b, k in s)
        out[x] = text(base), text(spans), disclosure.sanitised_text(x, spans)
    return out


def corpus():
    rng, texts = random.Random(4), []
    vocabulary = [f"{a}{b}{c}" for a in ("re", "thor", "un") for b in ("in", "a", "est") for c in ("ing", "o", "er", "al")]
    filler = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    for i in range(600):
        texts.append(filler(rng.randrange(5, 40)))
    for i in range(6):  # two words that only ever stand near one address; one with a common class
        texts.append(f"{filler(10)} Zanzibar, {filler(3)} boss@corp.example.com Reinhold {filler(20)} zanzibar {filler(60)}")
    for i in range(5):
        texts.append(f"reinette {filler(9)} call +1 (555) 123-4567 {i} Qyx {filler(30 + i)} far away zanzibar")
    texts += [f"reins {i} {filler(4)}" for i in range(40)]
    texts += ["once only seldom@corp.example.com hapax"] * 50  # copies are one text
    return texts + ["", None, "x" * 100_000, " 4111 1111 1111 1111 1.2.3.4"]


def test_against_plain_counts(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, x, "z") for i, x in enumerate(texts)], "doc_id long, text string, digest string").repartition(7)
    want = plain(texts)
    got = {r.doc_id: r for r in disclosure.sanitise(docs).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        assert (got[i].base, got[i].spans, got[i].sanitised) == want[x or ""]
        assert [got[i][f"n_{k}"] for k in disclosure.BASE] == [sum(s[2] == k for s in plain_spans(x or "")) for k in disclosure.BASE]
    kinds = {s.split(":")[0] for r in got.values() for s in r.spans.split(",")}
    assert {"remove", "generalise", "email", "phone"} <= kinds
    boss = next(r for r in got.values() if "<EMAIL>" in r.sanitised and "<REMOVED>" in r.sanitised)
    assert "anzibar" not in boss.sanitised


def test_texts_without_entities_and_copies_stay(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in disclosure.sanitise(docs).collect():
        text = texts[r.doc_id] or ""
        if not plain_spans(text):
            assert r.spans == "" and r.sanitised == text
        if "seldom" in text:
            assert r.spans.count(":") == 2


def test_empty_table_null_ids_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert disclosure.sanitise(empty).count() == 0
    rows = [(None, "a@b.cd"), (1, "a@b.cd"), (1, "a@b.cd"), (2, None)]
    got = disclosure.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), False).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.spans) for r in got) == [(0, 1, "email:0:6"), (1, 1, "email:0:6"), (1, 1, "email:0:6"), (2, 0, "")]
