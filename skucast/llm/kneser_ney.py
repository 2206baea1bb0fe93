"""Operator 7: interpolated modified Kneser-Ney bigram model, counted in Spark, memory-mapped by workers.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, then one end per text. Words are known by 64-bit hashes.
Counting: tasks count the distinct (context, word) pairs of a chunk of text and deal them to a grid of buckets,
the row named by top bits of the context's hash and the column by top bits of the word's, so pairs of one frequent
context spread over a whole row of buckets and those of one frequent word over a column. A bucket merges its
counts and stores them as a sorted array of pair hashes with counts; its partial statistics of contexts and
words (counts, numbers of followers with count 1, 2, 3+, numbers of contexts) go to word buckets, as many as there
are pair buckets, which store sorted arrays of word hashes. Only sums (token and word totals, counts of counts) reach the driver.
Scoring: tasks map the arrays into memory, look up the sorted distinct pairs of a chunk and add logarithms.

The store is a folder under the shared checkpoint folder, which must be a mounted file system; files appear by
atomic renames, so repeated tasks are harmless. The grid grows with the input's partitions, a bucket's size does
not. The order is two: a trigram's records alone would pass the disk budget (see README).

Defined results: a null text is empty (its only token is the end); an empty training set gives a score of 0 and
the base score of an empty count table; a null id counts as held out; repeated rows count as often as they
occur. Further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skucast.llm.common import chunks, fold_of, hashed_words, mix64, mounted, shared_folder, store_array

BOS, EOS = np.uint64(0x8F1BBCDC5A827999), np.uint64(0x6ED9EBA1CA62C1D6)  # hashes of text start and end
CHUNK_BYTES = 8 << 20
COUNTS = "bucket int, contexts binary, runs binary, words binary, counts binary"
STATS = "kind string, bucket int, hashes binary, sums binary"
TOTALS = "kind string, bucket int, totals array<long>"


def _pairs(texts: pa.Array):
    """Hashes of all local tokens (ascending), token numbers of contexts and words in text order, tokens a text."""
    ids, counts, hashes = hashed_words(texts, by_hash=True)
    all_hashes = np.concatenate((hashes, [BOS, EOS]))
    order = np.argsort(all_hashes)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    lens = counts + 1
    ends = np.cumsum(lens) - 1
    word = np.empty(int(lens.sum()), np.int32)
    is_end = np.zeros(len(word), bool)
    is_end[ends] = True
    word[~is_end] = rank[ids]
    del ids, is_end
    word[ends] = rank[-1]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[ends - counts] = rank[-2]
    return all_hashes[order], context, word, lens


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(context * np.uint64(0x9E3779B97F4A7C15) ^ mix64(word))


def _count_chunks(batches, bits: int):
    for b in chunks(batches, "text", CHUNK_BYTES):
        hashes, context, word, _ = _pairs(b["text"])
        pair, n = np.unique(context.astype(np.int64) * len(hashes) + word, return_counts=True)  # ascending (context, word) hashes
        c, w = hashes[pair // len(hashes)], hashes[pair % len(hashes)]
        bucket = (_top(c, bits) << bits) + _top(w, bits)
        order = np.argsort(bucket, kind="stable")
        bucket, c, w, n = bucket[order], c[order], w[order], n[order].astype(np.uint32)
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rows = []
        for lo, hi in zip(starts, np.append(starts[1:], len(bucket))):
            cc = c[lo:hi]
            at = np.flatnonzero(np.concatenate(([True], cc[1:] != cc[:-1])))
            runs = np.diff(np.append(at, hi - lo)).astype(np.uint32)
            rows.append((int(bucket[lo]), cc[at].tobytes(), runs.tobytes(), w[lo:hi].tobytes(), n[lo:hi].tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary())
                                                           for i in range(1, 5)]],
            names=["bucket", "contexts", "runs", "words", "counts"])


def _joined(blobs, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype)


def _sums_by(keys: np.ndarray, *columns: np.ndarray):
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], [np.add.reduceat(c[order], at) if len(at) else c[:0] for c in columns], order[at]


def _count_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == i).sum()) for i in (1, 2, 3, 4)]


def _merge_pairs(pdf: pd.DataFrame, folder: str, bits: int) -> pd.DataFrame:
    bucket = int(pdf["bucket"].iloc[0])
    c = np.repeat(_joined(pdf["contexts"], np.uint64), _joined(pdf["runs"], np.uint32))
    w = _joined(pdf["words"], np.uint64)
    keys, (n,), first = _sums_by(_pair_key(c, w), _joined(pdf["counts"], np.uint32).astype(np.int64))
    c, w = c[first], w[first]
    store_array(folder, f"pair-{bucket}-keys", keys)
    store_array(folder, f"pair-{bucket}-counts", n.astype(np.uint32) if n.max(initial=0) < 2**32 else n)
    one, two = (n == 1).astype(np.int64), (n == 2).astype(np.int64)
    ctx, ctx_sums, _ = _sums_by(c, n, one, two, 1 - one - two)
    words, (conts,), _ = _sums_by(w, np.ones(len(w), np.int64))
    none = np.zeros(len(words), np.int64)
    rows = [("pairs", -1, b"", np.array(_count_of_counts(n) + [len(n)]).tobytes())]
    for hashes, sums in ((ctx, [*ctx_sums, np.zeros(len(ctx), np.int64)]), (words, [none, none, none, none, conts])):
        of, sums = _top(hashes, 2 * bits), np.stack(sums)  # hashes ascend, so a bucket's are neighbours
        at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))[:len(of)]
        rows += [("word", int(of[lo]), hashes[lo:hi].tobytes(), sums[:, lo:hi].tobytes()) for lo, hi in zip(at, np.append(at[1:], len(of)))]
    return pd.DataFrame(rows, columns=["kind", "bucket", "hashes", "sums"])


def _merge_words(pdf: pd.DataFrame, folder: str) -> pd.DataFrame:
    """Word arrays of a bucket: hash, count, numbers of followers with count 1, 2, 3+, number of contexts."""
    kind, bucket = pdf["kind"].iloc[0], int(pdf["bucket"].iloc[0])
    if kind == "pairs":
        totals = _joined(pdf["sums"], np.int64).reshape(-1, 5).sum(axis=0).tolist()
        return pd.DataFrame({"kind": [kind], "bucket": [bucket], "totals": [totals]})
    sums = np.concatenate([np.frombuffer(s, np.int64).reshape(5, -1) for s in pdf["sums"]], axis=1)
    hashes, cols, _ = _sums_by(_joined(pdf["hashes"], np.uint64), *sums)
    store_array(folder, f"word-{bucket}-keys", hashes)
    store_array(folder, f"word-{bucket}-sums", np.stack(cols))
    real = (hashes != BOS) & (hashes != EOS)
    conts = cols[4][hashes != BOS]
    texts = int(cols[0][hashes == BOS].sum())  # a start is followed by one token: its count is the number of texts
    return pd.DataFrame({"kind": [kind], "bucket": [bucket], "totals": [
        [int(cols[0][real].sum()), int(real.sum()), texts, *_count_of_counts(conts)]]})


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts for counts 1, 2 and 3+ (0 to the count); a missing count of counts leaves one half of a step."""
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return [min(max(d, 0.0), i + 1.0) for i, d in enumerate(raw)]


def train(docs: DataFrame, folder: str | None = None) -> dict:
    """Counts the texts of ``docs`` (column text) into a store; returns the model's few numbers and its folder."""
    uri = folder or shared_folder(docs.sparkSession, "bigrams")
    path = mounted(uri)
    bits = max(2, math.ceil(math.log2(2 * docs.rdd.getNumPartitions()) / 2))
    grid = 1 << bits
    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        lambda it: _count_chunks(it, bits), COUNTS)
    parts = counted.repartition(grid * grid, "bucket")
    stats = parts.groupBy("bucket").applyInPandas(lambda p: _merge_pairs(p, path, bits), STATS)
    rows = stats.groupBy("kind", "bucket").applyInPandas(lambda p: _merge_words(p, path), TOTALS).collect()
    pair = [sum(r["totals"][i] for r in rows if r["kind"] == "pairs") for i in range(5)]
    word = [sum(r["totals"][i] for r in rows if r["kind"] == "word") for i in range(7)]
    tokens, texts = word[0] + word[2], word[2]
    model = {"path": path, "bits": bits, "tokens": tokens, "vocabulary": word[1] + (texts > 0), "texts": texts,
             "pairs": pair[4], "pair_discounts": _discounts(*pair[:4]), "word_discounts": _discounts(*word[3:7]),
             "word_counts": word[3:7]}
    return model


@functools.lru_cache(maxsize=2048)
def _mapped(path: str, name: str) -> np.ndarray | None:
    """An array of the store, memory-mapped; None for a bucket that got no pairs."""
    file = f"{path}/{name}.npy"
    return np.load(file, mmap_mode="r") if os.path.exists(file) else None


def _look_up(path: str, kind: str, bucket: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """Values (width x keys) of sorted-array look-ups bucket by bucket, zeros where a key is missing."""
    out = np.zeros((width, len(keys)), np.int64)
    order = np.lexsort((keys, bucket))
    starts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0))) if len(keys) else []
    for lo, hi in zip(starts, np.append(starts[1:], len(keys))):
        at = order[lo:hi]
        there = _mapped(path, f"{kind}-{bucket[at[0]]}-keys")
        if there is None or not len(there):
            continue
        values = _mapped(path, f"{kind}-{bucket[at[0]]}-{'counts' if kind == 'pair' else 'sums'}")
        pos = np.minimum(np.searchsorted(there, keys[at]), len(there) - 1)
        hit = there[pos] == keys[at]
        out[:, at[hit]] = values[..., pos[hit]]
    return out


def _score_chunks(batches, model: dict):
    path, bits, n, v = model["path"], model["bits"], model["tokens"], model["vocabulary"]
    d, e = np.array([0, *model["pair_discounts"]]), np.array([0, *model["word_discounts"]])
    pairs, (m1, m2, m3, m4) = max(model["pairs"], 1), model["word_counts"]
    for b in chunks(batches, "text", CHUNK_BYTES):
        hashes, context, word, lens = _pairs(b["text"])
        total, f1, f2, f3, conts = _look_up(path, "word", _top(hashes, 2 * bits), hashes, 5)
        count = np.where(hashes == EOS, model["texts"], np.where(hashes == BOS, 0, total))
        # lower order: contexts of a word, interpolated with the uniform share of V + 1 words
        over = (e[1] * m1 + e[2] * m2 + e[3] * max(model["types"] - m1 - m2, 0)) / pairs if n else 1.0
        low = np.maximum(conts - e[np.minimum(conts, 3)], 0) / pairs + over / (v + 1)
        pair, inverse = np.unique(context.astype(np.int64) * len(hashes) + word, return_inverse=True)
        c, w = pair // len(hashes), pair % len(hashes)
        bucket = (_top(hashes[c], bits) << bits) + _top(hashes[w], bits)
        (both,) = _look_up(path, "pair", bucket, _pair_key(hashes[c], hashes[w]), 1)
        base = np.maximum(total[c], 1)
        back = np.where(total[c] > 0, (d[1] * f1[c] + d[2] * f2[c] + d[3] * f3[c]) / base, 1.0)
        p = np.maximum(both - d[np.minimum(both, 3)], 0) / base + back * low[w]
        starts = np.cumsum(lens) - lens
        score = np.add.reduceat(np.log10(p)[inverse], starts)
        plain = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
        known = np.add.reduceat((count > 0).astype(np.int64)[word], starts)
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["held_out"], pa.array(lens), pa.array(known), pa.array(np.full(len(lens), n)),
             pa.array(np.add.reduceat(plain[word], starts)), pa.array(score), pa.array(10 ** (-score / lens))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of ``docs`` (doc_id, held_out, text): token counts, base score, score, perplexity."""
    model = dict(model, types=model["vocabulary"])
    src = docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(
        lambda it: _score_chunks(it, model),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double, perplexity double")


def model_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Trains on all texts outside crc32 fold 0 of ``folds`` and scores every text."""
    df = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", fold_of(folds) == 0)
    return score(df, train(df.where(~F.col("held_out"))))
