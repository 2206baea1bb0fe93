"""Separator scan against a plain scan, across block and run borders, and token counts of real texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from skucast.llm import packing, separators

SEP = 9


def plain(ids):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == SEP:
            out.append((len(out), start, i - start, True))
            start = i + 1
    return out + ([(len(out), start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("block, run", [(1, 1), (4, 2), (7, 3), (1000, 10)])
def test_matches_plain_scan(spark, tmp_path, monkeypatch, block, run):
    monkeypatch.setattr(separators, "RUN", run)
    rng, files = random.Random(block), {}
    for k, chance in enumerate((0.5, 0.05, 0.0, 1.0)):
        files[f"f{k}.bin"] = [SEP if rng.random() < chance else rng.randrange(SEP) for _ in range(60)]
    files |= {"empty.bin": [], "one.bin": [SEP], "open.bin": [1, 2, SEP, 3]}
    for name, ids in files.items():
        raw = np.array(ids, "<u2").tobytes()
        (tmp_path / name).write_bytes(raw)
        (tmp_path / f"{name}.z").write_bytes(zlib.compress(raw))
    files |= {f"{name}.z": ids for name, ids in files.items()}
    got = sorted(tuple(r) for r in separators.document_tokens(
        separators.read_files(spark, str(tmp_path)), SEP, block=block).collect())
    assert got == sorted((n, *row) for n, ids in files.items() for row in plain(ids))
    for size in (1, 50, 1 << 20):  # ranges of a few bytes: one file is scanned by many tasks
        ranges = separators.read_ranges(spark, str(tmp_path), block=block, range_bytes=size)
        assert ranges.where("file = 'f0.bin'").count() == -(-120 // (max(1, size // (2 * block)) * 2 * block))
        got = sorted(tuple(r) for r in separators.document_tokens(ranges, SEP, block=block).collect())
        assert got == sorted((n, *row) for n, ids in files.items() if n.endswith(".bin") for row in plain(ids))


def test_writes_and_counts_real_texts(spark, monkeypatch):
    from tests.conftest import SF001
    df = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "no id"), (-1, None), (-1, ""), (-2, "twice"), (-2, "twice")], df.schema)
    docs = df.union(extra).repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    uri, names = separators.write_token_files(docs, path, public_tokenizers.PATTERN, 50256)
    counts = separators.document_tokens(separators.read_ranges(spark, uri, block=500, range_bytes=4000), 50256, block=500)
    rows = counts.join(names, ["file", "ordinal"]).collect()
    code = packing.encoder(path, public_tokenizers.PATTERN)
    want = sorted((str(r.doc_id), len(code.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == want and all(r.closed for r in rows)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    uri, names = separators.write_token_files(none, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                              public_tokenizers.PATTERN, 50256)
    assert names.count() == 0
    assert separators.document_tokens(separators.read_files(spark, uri), 50256).count() == 0
    assert separators.document_tokens(separators.read_ranges(spark, uri), 50256).count() == 0
