"""The bigram model against a plain dictionary version, and its defined results."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from skucast.llm import kneser_ney

DOCS = [(1, "the cat sat on the mat"), (2, "the cat ate the rat\nand the cat sat"), (3, "A dog sat on the MAT"),
        (4, ""), (5, None), (6, "the the the the"), (7, "x\x0by\x0cz é\x85à the cat"), (None, "the cat sat"),
        (10, "on the mat the dog ate"), (10, "on the mat the dog ate"), (13, "rat and cat and dog and mat " * 30)]


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain(docs):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in docs]
    pairs, count = Counter(), Counter()
    for (_, t), h in zip(docs, held):
        if not h:
            seq = words(t) + ["</s>"]
            count.update(seq)
            pairs.update(zip(["<s>"] + seq, seq))
    n, v = sum(count.values()), len(count)
    follow, contexts, total = defaultdict(list), Counter(), Counter()
    for (c, w), k in pairs.items():
        follow[c].append(k)
        contexts[w] += 1
        total[c] += k

    def discount(values):
        return [0, *kneser_ney._discounts(*[sum(x == i for x in values) for i in (1, 2, 3, 4)])]

    d, e = discount(pairs.values()), discount(contexts.values())
    over = sum(e[min(x, 3)] for x in contexts.values()) / max(len(pairs), 1) if n else 1.0

    def p(c, w):
        low = max(contexts[w] - e[min(contexts[w], 3)], 0) / max(len(pairs), 1) + over / (v + 1)
        if not total[c]:
            return low
        back = sum(d[min(x, 3)] for x in follow[c]) / total[c]
        return max(pairs[c, w] - d[min(pairs[c, w], 3)], 0) / total[c] + back * low

    out = []
    for (i, t), h in zip(docs, held):
        seq = words(t) + ["</s>"]
        out.append((i, h, len(seq), sum(count[w] > 0 for w in seq), n,
                    sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in seq),
                    sum(math.log10(p(c, w)) for c, w in zip(["<s>"] + seq, seq))))
    vocabulary = set(count)
    return out, p, vocabulary


def run(spark, docs, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return df.selectExpr("*", "1 AS held_out", "2 AS n_tokens").transform(kneser_ney.model_scores)


def key(r):
    return (r[0] is not None, r[0] or 0, r[2])


def test_matches_plain_version(spark):
    want, p, vocabulary = plain(DOCS)
    got = sorted((tuple(r)[:7] for r in run(spark, DOCS).collect()), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:])
    for c in ("the", "cat", "never seen"):
        assert sum(p(c, w) for w in vocabulary) + p(c, "unknown word") == pytest.approx(1)


def test_empty_table_and_no_training_rows(spark):
    assert run(spark, []).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = run(spark, [(held, "a b")]).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0)
    assert row.score == 0 and row.base_score == pytest.approx(0)


def test_real_texts(spark):
    from tests.conftest import SF001
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    want = {w[0]: w for w in plain(docs)[0]}
    for r in run(spark, docs, 5).collect():
        assert tuple(r)[1:5] == want[r.doc_id][1:5]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][5:])
