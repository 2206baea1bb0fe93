"""Byte-level BPE against the tiktoken library, decoding, long pieces, defined results."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from skucast.llm import bpe
from skucast.llm.common import shuffles_dropped

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH),
                             special_tokens={})


def check(spark, docs, library):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS pieces").repartition(2)
    rows = bpe.encode_documents(df, PATH, public_tokenizers.PATTERN).collect()
    got = sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in rows)
    want = sorted((str(i), np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode())
                  for i, t in docs)
    assert got == want


def test_matches_library(spark, library):
    texts = ["", None, "Hello world, it's 2024!", "naïve café — ça va? Straße", "日本語のテキスト、漢字", "🙂👩‍👩‍👧‍👦 emoji",
             " \n\n\t  spaces \x0b\x85 end ", "\x00\x01\x7f ", "don't DON'T we'll", "a" * 300, "<|endoftext|>",
             "пример текста и العربية ไทย", "x" * 4000 + " tail", "ab" * 900, "same", "same"]
    check(spark, [(i if i % 5 else None, t) for i, t in enumerate(texts)], library)


def test_empty_table(spark, library):
    check(spark, [], library)


def test_real_texts(spark, library):
    from tests.conftest import SF001
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs, library)


def test_heap_merges_like_the_library(library):
    ranks = bpe.read_ranks(PATH)
    rng = np.random.default_rng(3)
    for _ in range(200):
        word = "".join(rng.choice(list("abcdeéñlnrst"), rng.integers(1, 60)))
        assert bpe._merge_long(word.encode(), ranks) == library.encode_ordinary(word)


def cut(texts, pattern=public_tokenizers.PATTERN):
    """The pieces of every text as ``_cut`` numbers them, of one chunk."""
    (row,) = pa.Table.from_batches(bpe._cut([pa.record_batch(
        [pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])], pattern)).to_pylist()
    pieces = bpe._unblob(row["pieces"], row["lens"])
    assert len(set(pieces)) == len(pieces) and len(row["counts"]) == len(texts)
    numbers = np.frombuffer(row["low"], "<u2") + (np.frombuffer(row["high"], "<u2").astype(int) << 16)
    ends = np.cumsum(row["counts"])
    assert ends[-1] == len(numbers)
    return [[pieces[i].decode() for i in numbers[e - n:e]] for e, n in zip(ends, row["counts"])]


def test_only_distinct_units_are_searched(monkeypatch):
    searched, compiled = [], regex.compile

    class Counting:
        def __init__(self, pattern):
            self.find = compiled(pattern).findall

        def findall(self, text):
            searched.append(len(text))
            return self.find(text)

    monkeypatch.setattr(regex, "compile", Counting)
    texts = ["one two, three's  four\n five" * 500, "two, three's" * 300]
    assert cut(texts) == [compiled(public_tokenizers.PATTERN).findall(t) for t in texts]
    assert sum(searched) < 100


def test_units_keep_the_pieces():
    rng = np.random.default_rng(8)
    parts = [*" \t\n\r\x0b\x0c\x1c\x1f\x00\x7f\x85\xa0\u1680\u2003\u2028\u205f\u3000\u200b\u1681\u3042", *"é'“ab1٣🙂ếỪ!.s", "'s", "'ll", " 't",
             *[" "] * 12]
    for pattern in (public_tokenizers.PATTERN, r"\w+", r"\s?\S+"):
        find = regex.compile(pattern).findall
        for _ in range(300):
            texts = ["".join(rng.choice(parts, rng.choice([0, 1, 2, 3, 9, 40]))) for _ in range(rng.integers(1, 12))]
            assert cut(texts, pattern) == [find(t) for t in texts]


def test_no_cut_before_whitespace():
    space = regex.compile(r"\s")
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if space.match(c):
            assert not len(bpe._cuts(np.frombuffer(f"a {c}b".encode(), np.uint8)[:2 + len(c.encode())]))
    assert bpe._cuts(np.frombuffer("a b  é ế 日".encode(), np.uint8)).tolist() == [1, 4, 7, 11]


def test_blocks_of_units(monkeypatch):
    monkeypatch.setattr(bpe, "BYTES_AT_ONCE", 16)
    monkeypatch.setattr(bpe, "UNITS_AT_ONCE", 3)
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 2)
    texts = ["", "one two, three's  four\n five six seven" * 9, "x", "", "two,   日本語 の ", ""]
    assert cut(texts) == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


def test_only_empty_texts(spark, library):
    check(spark, [(1, ""), (2, None), (2, "")], library)


def test_session_keeps_its_shuffle_setting(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
        raise ValueError
    assert spark.conf.get(key) == before
