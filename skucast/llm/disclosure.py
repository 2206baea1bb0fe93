"""Operator 12: personal data, and the terms that give it away, by information-theoretic sanitisation.

Protected entities are e-mail and IP addresses, card and phone numbers, found by patterns. A term t (a word, case
ignored) near an entity e (within ``WINDOW`` words) discloses it if knowing t says most of what e says:

    PMI(e; t) = log2(n(e, t) N / (n(e) n(t)))  >=  ``SHARE`` * IC(e),    IC(e) = log2(N / n(e))

where N, n(e), n(t) and n(e, t) count the different texts of the whole corpus (in all, with e, with t, with t near
e); and if that is no chance, n(e, t) >= ``SUPPORT`` texts and n(e, t) * PMI >= ``EVIDENCE`` bits. In texts that hold
e, a disclosing term is generalised to the class of words that open with the same ``CLASS`` characters, if that class
does not disclose e itself by the same counts; else it is removed. Texts without entities are left as they are.

All counts are sums over Spark groups: a text of many copies counts once through the digest it is grouped by (in the
term counts by a weight of one over its copies), entity and term meet as rows of their own, no document's or
entity's rows are gathered. A task's Python worker holds one chunk of texts. The patterns take time in proportion to
the text whatever it holds: an e-mail's local part is read backwards from its ``@``, dotted numbers are cut in fours.

Defined results: a null text is empty; repeated rows are rows of their own; an empty table gives no rows; further
columns are ignored. Spans are code points, end exclusive, ordered by start, then kind as in ``KINDS``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skucast.llm.common import chunks, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "generalise", "remove")
WINDOW, SHARE, SUPPORT, EVIDENCE, CLASS = 30, 0.8, 3, 24.0, 4
CHUNK_BYTES = 8 << 20

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")
_NO_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    out, low = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        start = low + len(text[low:at].rstrip(_LOCAL))
        low = at + 1
        if start < at:
            out.append((start, m.end()))
            low = m.end()
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def _luhn(digits: str) -> bool:
    twice = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (twice + sum(int(d) for d in digits[::-2])) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all entities, ordered by start, then kind."""
    found = [(s, BASE.index(kind), e) for kind, find in zip(BASE, (emails, ips, cards, phones)) for s, e in find(text)]
    return [(s, e, BASE[k]) for s, k, e in sorted(found)]


def entity_name(kind: str, value: str) -> str:
    """What equal entities share, however they are written."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _NO_DIGIT.sub('', value)}"


def class_of(term: str) -> str:
    return term[:CLASS] + "*"


def terms_outside(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the words that touch no span."""
    covered, out, i = [], [], 0
    for s, e, _ in spans:  # merged: kinds may overlap
        if covered and s < covered[-1][1]:
            covered[-1][1] = max(e, covered[-1][1])
        else:
            covered.append([s, e])
    for m in _TERM.finditer(text):
        s, e = m.span()
        while i < len(covered) and covered[i][1] <= s:
            i += 1
        if i == len(covered) or e <= covered[i][0]:
            out.append((s, e, m[0].lower()))
    return out


def near_terms(text: str, window: int = WINDOW) -> dict[str, set[str]]:
    """The terms within ``window`` words of each entity of the text."""
    spans = base_spans(text)
    if not spans:
        return {}
    terms = terms_outside(text, spans)
    starts = [t[0] for t in terms]
    out: dict[str, set[str]] = defaultdict(set)
    for s, e, kind in spans:
        before, after = bisect_left(starts, s), bisect_left(starts, e)
        out[entity_name(kind, text[s:e])].update(t[2] for t in terms[max(before - window, 0):before] + terms[after:after + window])
    return out


def _digest() -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("digest")


def mentions(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(digest, entity, terms): a row for each text and entity that it holds, copies of a text counted once."""

    def work(batches):
        for b in chunks(batches, "text", CHUNK_BYTES):
            out = []
            for digest, text in zip(b["digest"].to_pylist(), b["text"].to_pylist()):
                out += [(digest, e, sorted(t)) for e, t in near_terms(text, window).items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string()),
                 pa.array([o[2] for o in out], pa.list_(pa.string()))], names=["digest", "entity", "terms"])

    src = docs.select(_digest(), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(work, "digest binary, entity string, terms array<string>").groupBy("digest", "entity").agg(
        F.first("terms").alias("terms"))


def term_counts(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(term, weight) of terms and classes, to be summed by term: the different texts that hold them. ``copies`` has
    the digests of texts that occur more than once with their number of rows."""

    def work(batches):
        for b in chunks(batches, "text", CHUNK_BYTES):
            counts: dict[str, float] = defaultdict(float)
            for text, n in zip(b["text"].to_pylist(), b["n"].to_pylist()):
                held = {t.lower() for t in set(_TERM.findall(text))}
                for t in held | {class_of(t) for t in held}:
                    counts[t] += 1 / (n or 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.float64())],
                                             names=["term", "weight"])

    src = docs.select(_digest(), F.coalesce("text", F.lit("")).alias("text")).join(copies, "digest", "left")
    return src.select("text", "n").mapInArrow(work, "term string, weight double")


def disclosing_terms(docs: DataFrame, said: DataFrame) -> DataFrame:
    """(entity, term) of the disclosing terms and classes of ``mentions`` rows, with n_both, n_entity, n_term, pmi
    and ic."""
    groups = docs.select(_digest()).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    texts = written(groups, "texts")
    total = texts.count()
    known = said.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= SUPPORT)
    each = said.join(known.select("entity"), "entity", "left_semi").select("entity", F.explode(F.array_distinct(F.concat(
        "terms", F.transform("terms", lambda t: F.concat(F.substring(t, 1, CLASS), F.lit("*")))))).alias("term"))
    pairs = each.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= SUPPORT)
    pairs = written(pairs.join(known, "entity"), "pairs")
    counted = term_counts(docs, texts.where("n > 1")).join(pairs.select("term").distinct(), "term", "left_semi")
    n_term = counted.groupBy("term").agg(F.round(F.sum("weight")).cast("long").alias("n_term"))
    pmi = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    rated = pairs.join(n_term, "term").withColumns({"pmi": pmi, "ic": F.log2(F.lit(float(total)) / F.col("n_entity"))})
    return rated.where((F.col("pmi") >= SHARE * F.col("ic") - 1e-9) & (F.col("n_both") * F.col("pmi") >= EVIDENCE - 1e-9))


def term_actions(said: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(digest, terms, actions): what is done with the disclosing terms of each text that has some."""
    rows = said.select("digest", "entity", F.explode("terms").alias("term"))
    hits = rows.join(disclosing.select("entity", "term"), ["entity", "term"])
    classes = disclosing.where(F.col("term").endswith("*")).select("entity", F.col("term").alias("class"), F.lit(True).alias("told"))
    named = hits.withColumn("class", F.concat(F.substring("term", 1, CLASS), F.lit("*"))).join(classes, ["entity", "class"], "left")
    gone = F.coalesce("told", F.lit(False)) | (F.length("term") <= CLASS)
    per = named.groupBy("digest", "term").agg(F.max(gone).alias("gone"))
    return per.groupBy("digest").agg(F.collect_list(F.struct("term", "gone")).alias("actions")).select(
        "digest", F.col("actions.term").alias("terms"), F.col("actions.gone").alias("gone"))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def sanitised_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Entities become their kind in capitals, terms their class or ``<REMOVED>``; of overlapping spans the first."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            new = class_of(text[s:e]) if kind == "generalise" else "<REMOVED>" if kind == "remove" else f"<{kind.upper()}>"
            out += [text[at:s], new]
            at = e
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """A row a row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, ``base`` (the entities' spans) and ``spans``
    (those and the terms') as ``kind:start:end`` lists, and with ``with_text`` the sanitised text."""
    said = written(mentions(docs), "mentions")
    marks = written(term_actions(said, written(disclosing_terms(docs, said), "disclosing")), "marks")

    def work(batches):
        for b in chunks(batches, "text", CHUNK_BYTES):
            base, every, texts = [], [], []
            for text, terms, gone in zip(b["text"].to_pylist(), b["terms"].to_pylist(), b["gone"].to_pylist()):
                spans = base_spans(text)
                base.append(spans)
                if terms:
                    action = dict(zip(terms, gone))
                    spans = sorted(spans + [(s, e, "remove" if action[t] else "generalise")
                                            for s, e, t in terms_outside(text, spans) if t in action],
                                   key=lambda x: (x[0], KINDS.index(x[2])))
                every.append(spans)
                texts.append(sanitised_text(text, spans) if with_text else None)
            counts = [pa.array([sum(x[2] == k for x in s) for s in base], pa.int64()) for k in BASE]
            strings = [pa.array([_joined(s) for s in x], pa.string()) for x in (base, every)]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], *counts, *strings, pa.array(texts, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base", "spans", "sanitised"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(), F.coalesce("text", F.lit("")).alias("text"))
    kinds = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base string, spans string, sanitised string"
    out = src.join(marks, "digest", "left").select("doc_id", "text", "terms", "gone").mapInArrow(work, kinds)
    return out if with_text else out.drop("sanitised")
