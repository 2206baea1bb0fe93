"""Operator 8: token counts of documents in flat, unindexed token files, by a separator scan.

A token file is a flat array of little-endian unsigned integers; documents follow each other, each closed by the
separator id, and nothing says where. Files are cut into ranges of about ``RANGE_BYTES``, each read by itself from the
mounted folder, so that one large file is scanned by many tasks, in blocks of ``BLOCK`` tokens; a vectorised search
finds the separators of each block, on its own. A document that spans blocks is stitched by a prefix scan over the
block summaries (number of separators, last separator): within runs of ``RUN`` blocks, then over the runs of a file,
so neither a file's documents nor a run of blocks without a separator is gathered. Tokens after the last separator are
an open document. A task holds one range. Files on other stores, or zlib-compressed (a name ending in ``.z``), come
whole from Spark's binary reader instead (``read_files``), up to 2 GB each.

Defined results: a document without tokens counts 0; an empty file has no documents; ``closed`` is false for the
tokens after the last separator only. Writing: null texts are empty documents, null ids and repeated rows are
documents of their own; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skucast.llm.common import chunks, mounted, shared_folder, written
from skucast.llm.packing import encoder

BLOCK, RUN = 1 << 16, 1 << 10
RANGE_BYTES, CHUNK_BYTES = 8 << 20, 8 << 20
FILE_BYTES = 64 << 20  # a file is closed after the document that passes this size
NAMES = "file string, ordinal long, doc_id long"


def _write(batches, folder: str, path: str, pattern: str, separator: int, dtype: str):
    code, task = encoder(path, pattern), TaskContext.get().partitionId()
    os.makedirs(folder, exist_ok=True)
    number, ordinal, out, size = 0, 0, None, 0

    def name() -> str:
        return f"tokens-{task:06d}-{number:06d}.bin"

    def close():
        out.close()
        os.replace(out.name, f"{folder}/{name()}")

    for b in chunks(batches, "text", CHUNK_BYTES):
        files, ordinals = [], []
        for text in b["text"].to_pylist():
            if out is None:
                out = open(f"{folder}/.tokens-{task}-{os.urandom(6).hex()}", "wb")
                size = 0
            tokens = np.array([*code.encode_ordinary(text), separator], dtype).tobytes()
            out.write(tokens)
            size += len(tokens)
            files.append(name())
            ordinals.append(ordinal)
            ordinal += 1
            if size >= FILE_BYTES:
                close()
                number, ordinal, out = number + 1, 0, None
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(ordinals, pa.int64()), b["doc_id"]],
                                         names=["file", "ordinal", "doc_id"])
    if out is not None:
        close()


def write_token_files(docs: DataFrame, path: str, pattern: str, separator: int, dtype: str = "<u2",
                      folder: str | None = None) -> tuple[str, DataFrame]:
    """Encodes every text into flat token files in a shared folder; returns its URI and, apart from the files,
    the documents in writing order (file, ordinal, doc_id). Files appear by atomic renames under names that
    depend on the task alone, so a repeated task replaces them by the same content."""
    uri = folder or shared_folder(docs.sparkSession, "tokens")
    os.makedirs(mounted(uri), exist_ok=True)
    where = mounted(uri)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return uri, written(rows.mapInArrow(lambda it: _write(it, where, path, pattern, separator, dtype), NAMES), "names")


def _listed(spark: SparkSession, uri: str, names: str) -> DataFrame:
    files = (spark.read.format("binaryFile").option("pathGlobFilter", names)
             .schema("path string, modificationTime timestamp, length long, content binary").load(uri))
    return files.withColumn("file", F.regexp_extract("path", "[^/]+$", 0))


def read_files(spark: SparkSession, uri: str) -> DataFrame:
    """(file, content) of the token files below ``uri``, flat or compressed, each held whole by a task."""
    return _listed(spark, uri, "*.{bin,bin.z}").select("file", "content")


def read_ranges(spark: SparkSession, uri: str, dtype: str = "<u2", block: int = BLOCK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, path, offset, length) of ranges of the flat files below the mounted folder ``uri``, whole blocks but for a
    file's last; a file's bytes are not read here."""
    size = max(1, range_bytes // (block * np.dtype(dtype).itemsize)) * block * np.dtype(dtype).itemsize
    files = _listed(spark, uri, "*.bin").where("length > 0")
    ranges = files.select("file", "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("offset"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.select("file", "path", "offset", F.least(F.lit(size), F.col("length") - F.col("offset")).alias("length")).repartition(parts)


def document_tokens(files: DataFrame, separator: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document of every file, given as ranges (``read_ranges`` with
    the same ``block``) or whole (``read_files``)."""
    whole, width = "content" in files.columns, np.dtype(dtype).itemsize

    def pieces(b):
        if whole:
            for file, content in zip(b["file"].to_pylist(), b["content"]):
                raw = content.as_buffer()
                yield file, 0, np.frombuffer(zlib.decompress(raw) if file.endswith(".z") else raw, dtype)
        else:
            for r in b.to_pylist():
                yield r["file"], r["offset"] // width, np.fromfile(mounted(r["path"]), dtype, r["length"] // width, offset=r["offset"])

    def scan(batches):
        for b in batches:
            for file, first, ids in pieces(b):
                parts = [ids[i:i + block] for i in range(0, len(ids), block)]
                ends = [np.flatnonzero(p == separator) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(parts), pa.string()), pa.array(range(first // block, first // block + len(parts)), pa.int64()),
                     pa.array([len(p) for p in parts], pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                    names=["file", "block", "size", "ends"])

    found = files.mapInArrow(scan, "file string, block long, size long, ends array<long>")
    base = F.col("block") * block
    found = found.select("file", "block", (base + F.col("size")).alias("stop"), F.size("ends").alias("n"),
                         F.transform("ends", lambda e: e + base).alias("ends"),
                         F.floor(F.col("block") / RUN).alias("run"))
    found = found.withColumn("last", F.when(F.col("n") > 0, F.get("ends", F.col("n") - 1)))
    # prefix scan: separators before a block, and the place of the last of them
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = found.withColumns({"n_in": F.coalesce(F.sum("n").over(inside), F.lit(0)), "last_in": F.max("last").over(inside)})
    runs = found.groupBy("file", "run").agg(F.sum("n").alias("n_run"), F.max("last").alias("last_run"),
                                            F.max("stop").alias("stop_run"))
    before = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select("file", "run", F.coalesce(F.sum("n_run").over(before), F.lit(0)).alias("n_before"),
                          F.max("last_run").over(before).alias("last_before"),
                          F.max("stop_run").over(Window.partitionBy("file")).alias("file_stop"))
    known = local.join(carried, ["file", "run"]).select(
        "file", "stop", "file_stop", "ends", (F.col("n_before") + F.col("n_in")).alias("first"),
        (F.coalesce("last_in", "last_before", F.lit(-1)) + 1).alias("open"), "last")
    closed = known.select("file", "first", "open", "ends", F.posexplode("ends").alias("k", "end")).select(
        "file", (F.col("first") + F.col("k")).alias("ordinal"),
        F.coalesce(F.get("ends", F.col("k") - 1) + 1, "open").alias("start"), "end", F.lit(True).alias("closed"))
    tail = F.coalesce(F.col("last") + 1, F.col("open"))
    rest = known.where((F.col("stop") == F.col("file_stop")) & (tail < F.col("stop"))).select(
        "file", (F.col("first") + F.size("ends")).alias("ordinal"), tail.alias("start"), F.col("stop").alias("end"),
        F.lit(False).alias("closed"))
    return closed.union(rest).select("file", F.col("ordinal").cast("long"), "start",
                                     (F.col("end") - F.col("start")).alias("n_tokens"), "closed")
