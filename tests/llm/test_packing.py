"""Packing: ids against the other tokenizer library, a plain check of every sequence, bin counts, search steps."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skucast.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ADDED = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def pack(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS length", "'x' AS shard")
    return [r.asDict() for r in packing.pack_documents(df, PATH, public_tokenizers.PATTERN, added=ADDED, **kw).collect()]


def whole(rows, docs, size):
    """Checks pieces against the tokenizers library and sequences for gapless offsets; returns the sequences."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for doc, text in docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % size or size if len(ids) > size else len(ids)
        starts = [0, *range(first, len(ids), size)]
        for k, (s, e) in enumerate(zip(starts, starts[1:] + [len(ids)])):
            want[doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes())] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= size
    return sequences


def test_edge_cases(spark):
    docs = [(1, "one two three"), (2, ""), (3, None), (None, "no id"), (4, "long text here " * 900), (5, "x" * 9000),
            (6, "same"), (6, "same"), (7, "a<|endoftext|>b <|endoftext|> <|endoftext"), (9, "<|endoftext|>"), (8, "é\x85ß　日本 \n\n\t end ")]
    whole(pack(spark, docs, size=64), docs, 64)
    whole(pack(spark, docs, size=64, shard=2), docs, 64)
    assert pack(spark, []) == []


def test_real_texts_near_the_bound(spark):
    from tests.conftest import SF001
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    rows = pack(spark, docs)
    bound = math.ceil(sum(r["length"] for r in rows) / packing.SIZE)
    assert len(whole(rows, docs, packing.SIZE)) <= bound + 2


@pytest.mark.parametrize("seed", range(3))
def test_search_improves_hard_lengths(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(200, 520) for _ in range(800)]
    bins = packing.best_fit(lengths, 1024)
    after = packing.local_search([list(b) for b in bins], lengths, 1024)
    assert sorted(i for b in after for i in b) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in b) for b in after) <= 1024
    assert len(after) < len(bins)


def test_search_exchanges_two_for_one():
    lengths = [500, 300, 250, 240, 90]
    after = packing.local_search([[0, 1], [2, 3, 4]], lengths, 1380)
    assert len(after) == 1 and sorted(after[0]) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("seed, low, high", [(1, 200, 520), (2, 300, 400), (3, 1, 1023), (4, 500, 530)])
def test_no_bin_allows_a_step(seed, low, high):
    """Brute force over the result: no move, and no exchange of one or two pieces for one, raises the squares."""
    draw = random.Random(seed)
    lengths = [draw.randint(low, high) for _ in range(120)]
    after = packing.local_search(packing.best_fit(lengths, 1024), lengths, 1024)
    assert sorted(i for b in after for i in b) == list(range(len(lengths)))
    if len(after) == math.ceil(sum(lengths) / 1024):
        return
    fill = [sum(lengths[i] for i in b) for b in after]
    for s, t in ((s, t) for s in range(len(after)) for t in range(len(after)) if s != t and max(fill[s], fill[t]) < 1024):
        groups = [(i,) for i in after[s]] + [(i, j) for i in after[s] for j in after[s] if i < j]
        for g in groups:
            for back in [0] * (len(g) == 1) + [lengths[i] for i in after[t]]:
                delta = sum(lengths[i] for i in g) - back
                if 0 < delta <= 1024 - fill[t]:
                    assert (fill[t] + delta) ** 2 + (fill[s] - delta) ** 2 <= fill[t] ** 2 + fill[s] ** 2
