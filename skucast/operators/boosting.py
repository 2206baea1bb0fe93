"""Regularised gradient boosting over histograms, as DataFrame jobs (survey K08, K09, D17).

Squared loss with second-order leaf values: a leaf of gradient sum G over H rows gets -T(G) / (H + lambda), where T
shrinks by alpha, and a split gains (T(Gl)^2 / (Hl + lambda) + T(Gr)^2 / (Hr + lambda) - T(G)^2 / (H + lambda)) / 2.

1. Cut points of every column are exact quantiles of all training rows. Tasks sort runs of ``RUN`` rows and keep each
   column's different values with their counts; the driver brings bounds around the ranks closer by a few jobs that count
   the values up to some probes, so no task holds a column and nothing is shuffled.
2. Rows become bins, a byte a column, in chunks of ``CHUNK`` rows that are dealt to as many partitions as there are
   cores and kept there (in memory, else on disk).
3. A level of a tree is one job of one stage: each task adds up gradients and rows by (column, node, bin) over its
   chunks. The sums, whose size does not depend on the rows, are added up in the driver, or by tasks first where there
   are more than ``DIRECT``, and searched there for the best splits.
4. The first level of a tree also gives the validation error of the trees before it, so one fit tells when to stop.

Trees are small and live in the driver; a task gets them all and works out its rows' margins from them. A Python
worker keeps the margins of chunks that it has seen (``KEEP`` bytes at most) and adds only the trees since; after
a lost executor they are made anew from the trees. Rows are sampled by a hash of their keys, so the model does not
depend on where rows lie.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Sequence
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skucast.session import cut_lineage

CHUNK, KEEP, RUN, PROBES, DIRECT = 1 << 15, 256 << 20, 1 << 17, 32, 32
CHUNKS = "chunk string, n int, bins binary, target binary, train binary, hash binary"
PARAMS = dict(maxIter=300, maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubset=0.8, regLambda=1.0, regAlpha=0.1,
              minChildWeight=1.0, maxBins=64, seed=42)


@dataclass
class Tree:
    """Nodes by heap index: the column and the last bin that goes left, or column -1 and a value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def leaf_of(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row (a column of ``bins``) ends at, or is at after so many ``levels``."""
        n, flat = bins.shape[1], bins.ravel()
        at, rows = np.zeros(n, np.int64), np.arange(n)
        start = np.maximum(self.feature, 0).astype(np.int64) * n  # where a node's column begins in ``flat``
        first = np.where(self.feature >= 0, 2 * np.arange(len(self.feature)) + 1, np.arange(len(self.feature)))
        cut = np.where(self.feature >= 0, self.cut, 255).astype(np.int16)  # no bin is beyond: a leaf stays where it is
        for _ in range((len(self.feature) + 1).bit_length() - 2 if levels is None else levels):
            at = first[at] + (flat[start[at] + rows] > cut[at])
        return at


@dataclass
class BoostedTrees:
    columns: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)
    gains: list[list[tuple[int, float]]] = field(default_factory=list)  # (column, gain) of the splits of each tree
    errors: list[float] = field(default_factory=list)  # validation error of each number of trees

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - the name that MLlib models have
        return len(self.trees)

    def binned(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        out = np.empty((len(self.columns), len(columns[0]) if columns else 0), np.uint8)
        for i, (values, edges) in enumerate(zip(columns, self.edges)):
            out[i] = np.searchsorted(edges, values, side="left")
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.base)
        for tree in self.trees:
            out += tree.value[tree.leaf_of(bins)]
        return out

    def importances(self) -> dict[str, float]:
        """Shares of all gain."""
        total = dict.fromkeys(range(len(self.columns)), 0.0)
        for of_tree in self.gains:
            for feature, gain in of_tree:
                total[feature] += gain
        all_gain = sum(total.values()) or 1.0
        return {c: total[i] / all_gain for i, c in enumerate(self.columns)}

    def to_json(self) -> str:
        trees = [[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in self.trees]
        return json.dumps({"columns": self.columns, "edges": self.edges, "base": self.base, "trees": trees, "gains": self.gains,
                           "errors": self.errors})

    @classmethod
    def from_json(cls, text: str) -> BoostedTrees:
        d = json.loads(text)
        d["trees"] = [Tree(np.array(f, np.int32), np.array(c, np.int32), np.array(v)) for f, c, v in d["trees"]]
        d["gains"] = [[tuple(g) for g in of_tree] for of_tree in d["gains"]]
        return cls(**d)


def shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def signif(x: np.ndarray, digits: int = 9) -> np.ndarray:
    """Rounded to so many digits: equal gains stay equal in whatever order their sums were added up."""
    some = np.where(x > 1e-200, x, 1.0)
    scale = 10.0 ** (digits - 1 - np.floor(np.log10(some)))
    return np.where(x > 1e-200, np.round(some * scale) / scale, 0.0)


def best_splits(g: np.ndarray, h: np.ndarray, lam: float, alpha: float, least: float) -> tuple[np.ndarray, ...]:
    """(last bin to the left, gain, left G, left H) over the last axis, the bins; bin -1 without a split that gains."""
    left_g, left_h = np.cumsum(g, axis=-1)[..., :-1], np.cumsum(h, axis=-1)[..., :-1]
    total_g, total_h = g.sum(axis=-1, keepdims=True), h.sum(axis=-1, keepdims=True)
    if not left_g.shape[-1]:
        nothing = np.zeros(g.shape[:-1])
        return nothing.astype(int) - 1, nothing, nothing, nothing

    def score(a, b):
        return np.divide(shrunk(a, alpha) ** 2, b + lam, out=np.zeros_like(a), where=b + lam != 0)

    gain = 0.5 * (score(left_g, left_h) + score(total_g - left_g, total_h - left_h) - score(total_g, total_h))
    gain = np.where((left_h >= least) & (total_h - left_h >= least), signif(gain), 0)
    at = gain.argmax(axis=-1)
    best, left_g, left_h = (np.take_along_axis(x, at[..., None], -1)[..., 0] for x in (gain, left_g, left_h))
    some = best > 0
    return np.where(some, at, -1), np.where(some, best, 0.0), np.where(some, left_g, 0.0), np.where(some, left_h, 0.0)


def best_split(g: np.ndarray, h: np.ndarray, lam: float, alpha: float, least: float) -> tuple[int, float, float, float]:
    """``best_splits`` of one column."""
    at, gain, left_g, left_h = best_splits(g, h, lam, alpha, least)
    return int(at), float(gain), float(left_g), float(left_h)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; -0 is 0, NaN comes last."""
    bits = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def of_ordered(keys: np.ndarray) -> np.ndarray:
    """The doubles of ``ordered``."""
    keys = np.asarray(keys, np.uint64)
    return np.where(keys >> np.uint64(63), keys & np.uint64((1 << 63) - 1), ~keys).view(np.float64)


def value_runs(rows: DataFrame, cols: Sequence[str]) -> RDD:
    """(number of the column, its different values as ``ordered`` bytes, ascending, and how many rows have one up to each)
    for every run of ``RUN`` rows, kept; nulls are left out."""

    def work(batches):
        held, n = [], 0

        def packed():
            t = pa.Table.from_batches(held)
            for i, c in enumerate(t.columns):
                keys, count = np.unique(ordered(c.drop_null().to_numpy()), return_counts=True)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (
                        keys, np.cumsum(count).astype("<i4"))]], names=["i", "keys", "upto"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= RUN:
                yield from packed()
                held, n = [], 0
        if n:
            yield from packed()

    src = rows.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    runs = src.mapInArrow(work, "i int, keys binary, upto binary").rdd.map(tuple)
    return runs.persist(StorageLevel.MEMORY_AND_DISK_DESER)


def added_up(parts: RDD, add) -> object:
    """The sum of the rows, in the driver, or by tasks first where there are more than ``DIRECT`` partitions."""
    return parts.treeReduce(add, 1 if parts.getNumPartitions() <= DIRECT else 2)


def values_at(runs: RDD, ends: Sequence[tuple[int, int, int]], wanted: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The values at the ``wanted`` ranks of each column, from 0, of which ``ends`` has the rows and the least and largest
    key: every rank lies between two keys, which ``PROBES`` counts a job bring closer until they are one."""
    low = [np.full(len(w), r[1], np.uint64) for r, w in zip(ends, wanted)]
    high = [np.full(len(w), r[2], np.uint64) for r, w in zip(ends, wanted)]
    while any((a < b).any() for a, b in zip(low, high)):
        probes = {}
        for i, (a, b) in enumerate(zip(low, high)):
            a, b = a[a < b], b[a < b]
            if len(a):
                step = np.maximum((b - a) // np.uint64(PROBES), np.uint64(1))
                at = a[:, None] + step[:, None] * np.arange(min(PROBES, int((b - a).max())), dtype=np.uint64)
                probes[i] = np.unique(np.minimum(at, (b - np.uint64(1))[:, None]))

        def count(rows, probes=probes):
            found = {i: np.zeros(len(p), np.int64) for i, p in probes.items()}
            for i, keys, upto in rows:
                if i in probes:
                    at = np.searchsorted(np.frombuffer(keys, np.uint64), probes[i], side="right")
                    found[i] += np.concatenate(([0], np.frombuffer(upto, "<i4")))[at]
            yield found

        found = added_up(runs.mapPartitions(count), lambda a, b: {i: a[i] + b[i] for i in a})
        for i, p in probes.items():
            at = np.searchsorted(found[i], wanted[i], side="right")  # the first probe with more rows than the rank
            first, last = np.concatenate(([low[i].min()], p + np.uint64(1))), np.concatenate((p, [high[i].max()]))
            low[i], high[i] = np.maximum(low[i], first[at]), np.minimum(high[i], last[at])
    return [of_ordered(a) for a in low]


def edges_of(samples: DataFrame, cols: Sequence[str], bins: int) -> list[list[float]]:
    """Cut points of every column, ``bins`` - 1 at most: exact quantiles of all training rows."""
    runs = value_runs(samples.where(~F.col("is_val")), cols)
    try:
        def ends(rows):
            found = {}
            for i, keys, upto in rows:
                n, least, most = found.get(i, (0, 2**64, 0))
                keys = np.frombuffer(keys, np.uint64)
                found[i] = n + int(np.frombuffer(upto, "<i4")[-1]), min(least, int(keys[0])), max(most, int(keys[-1]))
            yield found

        def both(a, b):
            return {i: (a[i][0] + b[i][0], min(a[i][1], b[i][1]), max(a[i][2], b[i][2])) if i in a and i in b else a.get(i) or b[i]
                    for i in {*a, *b}}

        found = added_up(runs.mapPartitions(ends), both) if runs.getNumPartitions() else {}
        ends_of = [found.get(i, (0, 0, 0)) for i in range(len(cols))]
        places = [np.arange(1, bins) / bins * (n - 1) if n else np.zeros(0) for n, _, _ in ends_of]
        wanted = [np.unique(np.concatenate((np.floor(p), np.ceil(p)))).astype(np.int64) for p in places]
        values = values_at(runs, ends_of, wanted)
    finally:
        runs.unpersist()
    out = []
    for p, want, value in zip(places, wanted, values):
        down, up = np.floor(p), np.ceil(p)
        a, b = value[np.searchsorted(want, down)], value[np.searchsorted(want, up)]
        out.append(sorted(set(np.where((a == b) | (down == up), a, (up - p) * a + (p - down) * b).tolist())))
    return out


def chunk_table(samples: DataFrame, model: BoostedTrees, keys: Sequence[Column], target: str) -> DataFrame:
    """The samples as written chunks of bins, targets, training flags and hashes of ``keys``."""

    def work(batches):
        part, made, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            nonlocal made
            b = pa.Table.from_batches(held).combine_chunks()
            columns = [b[c].to_numpy() for c in model.columns]
            made += 1
            cells = [f"{part}-{made}", b.num_rows, model.binned(columns).tobytes(), b["_y"].to_numpy().astype("<f8").tobytes(),
                     b["_train"].to_numpy(zero_copy_only=False).tobytes(), b["_hash"].to_numpy().astype("<i8").tobytes()]
            kinds = [pa.string(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)],
                                              names=[c.split()[0] for c in CHUNKS.split(", ")])

        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                held.append(b.slice(at, CHUNK))
                rows += held[-1].num_rows
                if rows >= CHUNK:
                    yield packed()
                    held, rows = [], 0
        if rows:
            yield packed()

    src = samples.select(*model.columns, F.col(target).cast("double").alias("_y"), (~F.col("is_val")).alias("_train"),
                         F.xxhash64(*keys).alias("_hash"))
    return cut_lineage(src.mapInArrow(work, CHUNKS))


def dealt_chunks(table: DataFrame) -> RDD:
    """The chunks, dealt evenly to at most as many partitions as there are cores, and kept."""
    rdd = table.rdd.map(tuple).zipWithIndex().map(lambda row: (row[1], row[0]))
    parts = max(1, min(table.count(), table.sparkSession.sparkContext.defaultParallelism))
    return rdd.partitionBy(parts, lambda i: i % parts).values().persist(StorageLevel.MEMORY_AND_DISK_DESER)


_SEEN: OrderedDict[tuple[str, str], tuple[int, np.ndarray]] = OrderedDict()


def known_margins(run: str, chunk: str, bins: np.ndarray, model: BoostedTrees) -> np.ndarray:
    """The margins of a chunk under all trees, from those this worker last had."""
    done, margin = _SEEN.pop((run, chunk), (0, None))
    if margin is None:
        margin = np.full(bins.shape[1], model.base)
    for tree in model.trees[done:]:
        margin = margin + tree.value[tree.leaf_of(bins)]
    _SEEN[run, chunk] = (len(model.trees), margin)
    while sum(m.nbytes for _, m in _SEEN.values()) > KEEP and len(_SEEN) > 1:
        _SEEN.popitem(last=False)
    return margin


def level_sums(chunks: RDD, run: str, model: BoostedTrees, grown: Tree | None, level: int, features: list[int], share: float,
               seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and numbers of rows (2 x nodes of the tree at ``level`` x features x bins), and the squared
    validation error of ``model`` with its rows (level 0)."""
    number, columns, bins_of = len(model.trees), len(model.columns), max(map(len, model.edges), default=0) + 1
    limit = np.uint64(min(int(share * 2.0**64), 2**64 - 1))
    nodes = 2**level

    def work(rows):
        sums, error = np.zeros((2, len(features), nodes * bins_of)), np.zeros(2)
        for chunk, n, packed, target, trains, hashes in rows:
            bins = np.frombuffer(packed, np.uint8).reshape(columns, n)
            y, train = np.frombuffer(target, "<f8"), np.frombuffer(trains, bool)
            margin = known_margins(run, chunk, bins, model)
            if level == 0:
                error += ((margin - y)[~train] ** 2).sum(), (~train).sum()
            if grown is None:
                continue
            draw = mixed(np.frombuffer(hashes, "<u8") + mixed(np.array([seed * 1000003 + number], np.uint64)))
            node = grown.leaf_of(bins, level) - (nodes - 1)
            use = np.flatnonzero(train & (draw <= limit) & (node >= 0))
            node, pull = node[use].astype(np.int64) * bins_of, (margin - y)[use]
            for i, f in enumerate(features):
                cell = node + bins[f][use]
                sums[0, i] += np.bincount(cell, pull, nodes * bins_of)
                sums[1, i] += np.bincount(cell, minlength=nodes * bins_of)
        yield sums, error

    sums, error = added_up(chunks.mapPartitions(work), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return sums.reshape(2, len(features), nodes, bins_of).swapaxes(1, 2), error


@dataclass
class Split:
    """The best split of a node: bin -1 if none gains."""

    node: int
    feature: int
    bin: int
    gain: float
    left_g: float
    left_h: float
    g: float
    h: float


def level_splits(sums: np.ndarray, features: list[int], lam: float, alpha: float, least: float) -> list[Split]:
    """The best split of every node that has rows; equal gains go to the first column."""
    g, h = sums
    at, gain, left_g, left_h = best_splits(g, h, lam, alpha, least)
    out = []
    for k, i in enumerate(gain.argmax(axis=1).tolist()):
        if h[k, i].any():
            out.append(Split(k, features[i], int(at[k, i]), *(float(x[k, i]) for x in (gain, left_g, left_h)),
                             float(g[k, i].sum()), float(h[k, i].sum())))
    return out


def fit(samples: DataFrame, cols: Sequence[str], keys: Sequence[str], params: dict | None = None, patience: int = 20,
        target: str = "target") -> BoostedTrees:
    """The model of ``samples`` (columns, ``target``, ``is_val``), cut to the trees of lowest validation error once
    ``patience`` more had none lower; without validation rows all trees are grown."""
    o = {**PARAMS, **(params or {})}
    model = BoostedTrees(list(cols), edges_of(samples, cols, o["maxBins"]), 0.0)
    model.base = float(samples.where(~F.col("is_val")).agg(F.avg(target)).first()[0] or 0.0)
    chunks = dealt_chunks(chunk_table(samples, model, [F.col(k) for k in keys], target))
    try:
        return grow(model, chunks, o, patience)
    finally:
        chunks.unpersist()


def grow(model: BoostedTrees, chunks: RDD, o: dict, patience: int) -> BoostedTrees:
    """The trees of ``fit``."""
    run, cols = uuid4().hex, model.columns
    while True:
        number = len(model.trees)
        growing = number < o["maxIter"]
        tree = Tree.empty(o["maxDepth"]) if growing else None
        ranks = mixed(np.arange(len(cols), dtype=np.uint64) + mixed(np.array([o["seed"] * 7919 + number], np.uint64)))
        features = sorted(np.argsort(ranks)[:max(1, round(o["featureSubset"] * len(cols)))].tolist())
        gains: list[tuple[int, float]] = []
        for level in range(o["maxDepth"] if growing else 1):
            sums, error = level_sums(chunks, run, model, tree, level, features, o["subsamplingRate"], o["seed"])
            if level == 0:
                squares, rows = error.tolist()
                if number and rows:
                    model.errors.append(squares / rows)
                    best = int(np.argmin(model.errors)) + 1
                    if number - best >= patience or not growing:
                        model.trees, model.gains = model.trees[:best], model.gains[:best]
                        return model
                if not growing:
                    return model
            found = level_splits(sums, features, o["regLambda"], o["regAlpha"], o["minChildWeight"])

            def leaf(g: float, h: float) -> float:
                return float(-shrunk(g, o["regAlpha"]) / (h + o["regLambda"]) * o["stepSize"])

            for r in found:
                at = 2**level - 1 + r.node
                tree.value[at] = leaf(r.g, r.h)
                if r.bin >= 0:
                    tree.feature[at], tree.cut[at] = r.feature, r.bin
                    tree.value[2 * at + 1] = leaf(r.left_g, r.left_h)
                    tree.value[2 * at + 2] = leaf(r.g - r.left_g, r.h - r.left_h)
                    gains.append((r.feature, r.gain))
            if not any(r.bin >= 0 for r in found):
                break
        model.trees.append(tree)
        model.gains.append(gains)


def predicted(model: BoostedTrees, df: DataFrame) -> Column:
    """The model's prediction for each row of ``df``."""

    @F.pandas_udf("double")
    def margin(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.margins(model.binned([x[c].to_numpy(np.float64) for c in x.columns])))

    return margin(F.struct(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(model.columns)]))
