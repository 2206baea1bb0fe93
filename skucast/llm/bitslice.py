"""Operator 2: exact top-k inner products by a bit-sliced index.

Index: rows are dealt to blocks of ``BLOCK``; a block holds, for every dimension, the bit slices of its quantised
values above the dimension's smallest (slice j: bit j of all rows, as a bitmap), without the lowest ``DROP``
slices, and the exact integers. A query adds slices with bitmap arithmetic: the score is a sum of slices weighted
by powers of two (bit i of the query's absolute component times bit j of the value; for a negative component the
complement of the slice), and all bitmaps of one weight are summed by carry-save adders, three bitmaps into a sum
and a carry of the next weight, which leaves the bit slices of the quantised score. The top rows are then selected
from the most significant slice downward. Dropped slices change a score by at most ``slack``, so the rows at most
``slack`` below the k-th quantised score are the boundary: they are scored exactly, which gives the block's exact
top k. Blocks of rows and sets of queries are packed in the smallest integers that hold them and meet in the cells of a
grid of about ``TASKS`` cells a core: a task holds the query sets of its cell (``HELD`` bytes at most), streams its
blocks, each indexed once, and keeps the k best of every query over all of them. So a query set is copied once for each
group of blocks, not once for each block, a block once for each group of query sets, and k rows a query and group go to
the window per query.

Defined results: rows whose vector is null, or holds null or non-finite components, or whose id is null, take no
part; an empty vector has score 0 with all; vectors of different length are compared on the dimensions of both;
rows that repeat an id are candidates each, a query's candidates are all rows of other ids; of several queries
with one id the first in order of vector stands; ties go to smaller ids; an empty table gives no rows. Finite components
that are too large are an error: 2**53 or more after scaling, or a query and rows whose scores could leave 62 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES, DROP, TASKS, HELD = 1 << 13, 1 << 9, 2, 4, 128 << 20
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: str | Column) -> Column:
    """floor(256 * x) of every component as double; null if the vector takes no part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    def scaled(x: Column) -> Column:
        y = F.floor(x.cast("double") * 256).cast("long")
        return F.when(F.abs(x.cast("double")) * 256 < 2.0**53, y).otherwise(
            F.raise_error(F.lit("a vector component is too large for integer scores")).cast("long"))

    return F.when(F.coalesce(finite, F.lit(False)), F.transform(v, scaled))


class Block:
    """Bit slices of a block of rows (ids, integer matrix)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, drop: int = DROP):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.n, self.dims = rows.shape
        self.low = self.rows.min(axis=0) if self.n else np.zeros(self.dims, np.int64)
        above = self.rows - self.low
        self.largest = max(int(above.max(initial=0)), abs(int(self.rows.max(initial=0))), abs(int(self.rows.min(initial=0))))
        self.bits = max(int(above.max(initial=0)).bit_length(), 1)
        self.drop = min(drop, self.bits - 1)
        self.words = -(-self.n // 64)
        self.slices = np.stack([self._bitmap((above >> j) & 1) for j in range(self.drop, self.bits)], axis=1)
        self.all = self._bitmap(np.ones((self.n, 1), np.int64))[0]

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        """(dims, words) from a 0/1 matrix (rows, dims)."""
        packed = np.packbits(flags.astype(np.uint8).T, axis=1, bitorder="little")
        out = np.zeros((flags.shape[1], self.words * 8), np.uint8)
        out[:, :packed.shape[1]] = packed
        return out.view("<u8")

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Bit slices, lowest first, of sum |q_d| * (value_d or its complement) >> drop over the kept slices."""
        size = np.abs(query)
        weights: dict[int, list[np.ndarray]] = {}
        flip = np.where(query < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        for i in range(int(size.max(initial=0)).bit_length()):
            dims = np.flatnonzero((size >> i) & 1)
            if len(dims):
                chosen = self.slices[dims] ^ flip[dims, None, None]
                for j in range(chosen.shape[1]):
                    weights.setdefault(i + j, []).append(chosen[:, j])
        out, w = [], 0
        while weights:
            maps = np.concatenate(weights.pop(w)) if w in weights else np.zeros((0, self.words), np.uint64)
            while len(maps) > 1:
                m = len(maps) // 3
                if m:
                    a, b, c = maps[:m], maps[m:2 * m], maps[2 * m:3 * m]
                    half = a ^ b
                    carry, total, rest = (a & b) | (half & c), half ^ c, maps[3 * m:]
                else:
                    carry, total, rest = maps[:1] & maps[1:], maps[:1] ^ maps[1:], maps[2:]
                weights.setdefault(w + 1, []).append(carry)
                maps = np.concatenate((total, rest)) if len(rest) else total
            out.append(maps[0] & self.all if len(maps) else np.zeros(self.words, np.uint64))
            w += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows of other ids, best first."""
        query = np.concatenate((query, np.zeros(max(0, self.dims - len(query)), np.int64)))[:self.dims]
        if self.largest * sum(map(abs, query.tolist())) >= 1 << 62:
            raise ValueError(f"scores of query {query_id} can leave 62 bits")
        live = self.all.copy()
        lo, hi = np.searchsorted(self.ids, [query_id, query_id + 1])
        for r in range(lo, hi):
            live[r >> 6] &= ~np.uint64(1 << (r & 63))
        slices = self.score_slices(query)
        sure, ties, n_sure, kth = np.zeros_like(live), live, 0, 0
        for w in range(len(slices) - 1, -1, -1):  # rows above the k-th score so far, and rows equal to it
            ones = ties & slices[w]
            n_ones = int(np.bitwise_count(ones).sum())
            if n_sure + n_ones >= k:
                ties, kth = ones, kth | (1 << w)
            else:
                sure, ties, n_sure = sure | ones, ties & ~slices[w], n_sure + n_ones
        # slack in units of the kept slices: what the dropped slices of all dimensions can add
        slack = -(-int(np.abs(query).sum()) * ((1 << self.drop) - 1) // (1 << self.drop))
        rows = np.flatnonzero(np.unpackbits(self._at_least(slices, kth - slack, live).view(np.uint8),
                                            bitorder="little"))
        score = self.rows[rows] @ query
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]

    @staticmethod
    def _at_least(slices: list[np.ndarray], bound: int, live: np.ndarray) -> np.ndarray:
        """Bitmap of the live rows whose sliced score is at least ``bound``."""
        if bound <= 0:
            return live
        if bound >> len(slices):
            return np.zeros_like(live)
        above, equal = np.zeros_like(live), live
        for w in range(len(slices) - 1, -1, -1):
            if bound >> w & 1:
                equal = equal & slices[w]
            else:
                above, equal = above | (equal & slices[w]), equal & ~slices[w]
        return above | equal


PACKED = "no int, ids binary, matrix binary, dims int, kind string"
PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]


def _blocks(df: DataFrame, n: int) -> DataFrame:
    """(no, ids, matrix, dims, kind): rows dealt at random but repeatably to ``n`` blocks, integers of type ``kind``."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        dims = max(len(v) for v in pdf["v"])
        matrix = np.zeros((len(pdf), dims), "<i8")
        for r, v in enumerate(pdf["v"]):  # shorter vectors are padded with zeros
            matrix[r, :len(v)] = v
        low, high = matrix.min(initial=0), matrix.max(initial=0)
        kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        return pd.DataFrame({"no": [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()],
                             "matrix": [matrix.astype(kind).tobytes()], "dims": [dims], "kind": [kind]})

    dealt = df.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInPandas(work, PACKED)


def grid(n_rows: int, n_queries: int, n_blocks: int, n_sets: int, dims: int, tasks: int) -> tuple[int, int]:
    """Groups of blocks and of query sets, whose cells are about ``tasks``: what is copied is least where the groups are
    in proportion to the rows; the queries of a group take ``HELD`` bytes at most (eight a component)."""
    sides = math.ceil(math.sqrt(tasks * n_rows / max(1, n_queries)))
    rows = max(1, min(sides, tasks, n_blocks))
    held = math.ceil(n_queries * max(1, dims) * 8 / HELD)
    sets = max(1, min(n_sets, max(math.ceil(tasks / rows), held)))
    return max(1, min(n_blocks, math.ceil(tasks / sets))), sets


class Queries:
    """A query set (ids, integer matrix) and the k best rows of each query so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)

    def meet(self, block: Block) -> None:
        for i, query in enumerate(self.rows):
            ids, score = block.top(int(self.ids[i]), query.astype(np.int64), self.k)
            if self.best[i] is not None:
                ids, score = np.concatenate((self.best[i][0], ids)), np.concatenate((self.best[i][1], score))
                first = np.lexsort((ids, -score))[:self.k]
                ids, score = ids[first], score[first]
            self.best[i] = ids, score

    def found(self) -> pa.RecordBatch:
        some = [(i, *b) for i, b in zip(self.ids, self.best) if b is not None and len(b[0])]
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array([s[0] for s in some], np.int64), [len(s[1]) for s in some])),
             *[pa.array(np.concatenate([none, *[s[j] for s in some]])) for j in (1, 2)]],
            names=["query_id", "vec_id", "score"])


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every query; both inputs have (vec_id, v) with ``v``
    integer arrays or null."""
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select("vec_id", "v")
    asked = (queries.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
             .groupBy("vec_id").agg(F.min("v").alias("v")))
    n_rows, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_queries = asked.count()
    n_blocks, n_sets = max(1, math.ceil(n_rows / block)), max(1, math.ceil(n_queries / QUERIES))
    tasks = TASKS * rows.sparkSession.sparkContext.defaultParallelism
    across, down = grid(n_rows, n_queries, n_blocks, n_sets, dims or 0, tasks)
    sets = _blocks(asked, n_sets).select(F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("r"),
                                         (F.col("no") % down).alias("c"), F.lit(False).alias("indexed"), *PACKED_NAMES)
    index = _blocks(rows, n_blocks).select((F.col("no") % across).alias("r"),
                                           F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("c"),
                                           F.lit(True).alias("indexed"), *PACKED_NAMES)
    cells = (sets.unionByName(index).repartitionById(across * down, (F.col("r") * down + F.col("c")).cast("int"))
             .sortWithinPartitions("r", "c", "indexed", "no"))

    def search(batches):
        cell, held = None, []
        for b in batches:  # a cell's query sets, then its blocks
            for i in range(b.num_rows):
                row = {name: b[name][i].as_py() for name in ("r", "c", "indexed", *PACKED_NAMES)}
                if cell != (row["r"], row["c"]):
                    yield from (q.found() for q in held)
                    cell, held = (row["r"], row["c"]), []
                ids = np.frombuffer(row["ids"], "<i8")
                matrix = np.frombuffer(row["matrix"], row["kind"]).reshape(len(ids), row["dims"])
                if row["indexed"]:
                    one = Block(ids, matrix.astype(np.int64))
                    for q in held:
                        q.meet(one)
                else:
                    held.append(Queries(ids, matrix, k))
        yield from (q.found() for q in held)

    found = cells.mapInArrow(search, FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
