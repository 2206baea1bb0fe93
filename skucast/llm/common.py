"""Helpers shared by the corpus operators: shared folders, Arrow chunks, word hashing."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skucast.session import shared_folder, shuffles_dropped, written  # noqa: F401 - used through this module

CHUNK_BYTES = 16 << 20  # text held at once by a task's Python worker (one longer text is a chunk of its own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mounted(uri: str) -> str:
    """Path of a shared folder for ``open`` and memory maps; the folder must be a mounted file system."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped arrays need a mounted shared folder, not {uri}")
    return parts.path


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores before it until no column of ``df`` has it."""
    while name.lower() in [c.lower() for c in df.columns]:
        name = f"_{name}"
    return name


def fold_of(n: int, col: str = "doc_id") -> Column:
    """crc32 of the id's text modulo ``n``; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def chunks(batches: Iterator[pa.RecordBatch], col: str, max_bytes: int = CHUNK_BYTES,
           max_rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_bytes`` of text in ``col`` and ``max_rows`` rows, one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch[col]), 0).to_numpy(zero_copy_only=False)
        ends, lo = np.cumsum(size, dtype=np.int64), 0
        while lo < batch.num_rows:
            done = ends[lo - 1] if lo else 0
            hi = min(max(lo + 1, int(np.searchsorted(ends, done + max_bytes, side="right"))), lo + max_rows)
            # copied: string kernels of the Arrow library misread arrays that start at an offset
            yield batch if hi - lo == batch.num_rows else batch.take(pa.array(np.arange(lo, hi)))
            lo = hi


def store_array(folder: str, name: str, array: np.ndarray) -> None:
    """Writes under a name of its own, then renames: readers and repeated tasks see whole files only."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{folder}/{name}.npy")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of unsigned 64-bit integers over all others."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed_words(texts: pa.Array, by_hash: bool = False, lower: bool = True, with_words: bool = False) -> tuple:
    """Words (``[^\\x20\\x09-\\x0D]+``, A-Z lowered unless told otherwise) of every text: local word numbers of
    all words in order, words per text, the 64-bit hash of each local number (ascending with ``by_hash``), and
    with ``with_words`` the word of each local number."""
    import xxhash

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        at = np.concatenate(([0], np.cumsum(counts)))
        run = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
        counts = run[at[1:]] - run[at[:-1]]
        flat = flat.filter(full)
    coded = flat.cast(pa.large_binary()).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    if by_hash:
        order = np.argsort(hashes)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        ids, hashes = rank[ids], hashes[order]
    return (ids, counts, hashes, coded.dictionary.cast(pa.large_string())) if with_words else (ids, counts, hashes)
