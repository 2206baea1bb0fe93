"""Operator 1: near-duplicate groups by DartMinHash signatures, banding and exact verification.

Elements are the five-word shingles of a text (words ``[^\\x20\\x09-\\x0D]+``, A-Z lowered; a text of one to four
words is one shingle). Every element owns a strip of its weight; darts fall on the strip as a Poisson process of
rate one in the rank axis, drawn from hashes of (element, unit of weight, dart number), so equal strips get equal
darts in every text. A text of total weight W looks only at ranks under t / W, t = k ln k + 2k, about t darts
whatever its length. Each dart names one of k coordinates; the earliest dart of a coordinate is its signature
value, so two texts agree on a coordinate with probability equal to their weighted Jaccard similarity. A text
with an empty coordinate throws on to twice the rank.

Weights are the numbers of times that a shingle occurs, so a text is a set of cells (shingle, occurrence), and the
similarity, estimated and exact, is the weighted Jaccard similarity of the counts.

Groups: equal texts are one node. Nodes that share a band of the signature are compared with the bucket's hub
(its member that meets most others): if their signatures agree about enough, a pair is linked if its exact
similarity reaches the threshold. Buckets that then hold several components are searched: every member outside the
bucket's most frequent component meets all members of other components, first by signature, which only tells the
members that have a likely partner, then those by their cells, in the same task, which keeps the components that it
joins and emits a link only where it joins two. So pairs are tested where they meet, and never become rows; what
leaves a bucket is less than its members. A pair that shares several buckets is tested in the first. Buckets over
``PART`` members, or ``PART_BYTES`` of cells, are searched part by part, each part being met by the members outside.

Defined results: null and empty texts are equal texts without shingles, one group of their own; rows with a
repeated id stay rows; a null id takes part, a group's class is its smallest id that is not null; an empty table
gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skucast.llm.common import chunks, hashed_words, mix64, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5  # a pair at similarity 0.8 shares no band with probability 5e-5
PART, PART_BYTES, SLACK = 8192, 32 << 20, 0.15
CHUNK_BYTES, CHUNK_TEXTS = 4 << 20, 1000  # a text throws about t darts however short it is


def _throw(element: np.ndarray, unit: np.ndarray, room: np.ndarray, owner: np.ndarray, phi: np.ndarray, k: int,
           best: np.ndarray, mark: np.ndarray) -> None:
    """Throws the darts of all cells with ranks under ``phi`` of their owner; keeps the earliest by coordinate.

    A cell is one unit of an element's weight, ``room`` the part of it that the weight covers."""
    cell = mix64(element + mix64(unit + np.uint64(1)))
    rank, n = np.zeros(len(cell)), 0
    while len(cell):
        n += 1
        draw = mix64(cell + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        rank = rank - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
        live = rank < phi[owner]
        cell, rank, owner, draw, room = cell[live], rank[live], owner[live], draw[live], room[live]
        dart = mix64(draw ^ np.uint64(0xD1B54A32D192ED03))
        hit = (dart >> np.uint64(40)).astype(np.float64) * 2.0 ** -24 < room
        at = owner[hit] * k + ((dart[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
        ranks, marks = rank[hit], dart[hit]
        order = np.argsort(ranks)  # so the first of a coordinate is its earliest dart
        at, ranks, marks = at[order], ranks[order], marks[order]
        uniq, first = np.unique(at, return_index=True)
        better = ranks[first] < best[uniq]
        best[uniq[better]], mark[uniq[better]] = ranks[first][better], marks[first][better]


def dart_signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """Signatures (n_sets x k, uint64) of weighted sets given as parallel arrays of element hash, weight and set
    number. Sets without weight keep zeros. Equal elements of one set must not repeat unless their weights are
    equal (they throw equal darts)."""
    best, mark = np.full(n_sets * k, np.inf), np.zeros(n_sets * k, np.uint64)
    units = np.maximum(np.ceil(weight).astype(np.int64), 0)
    total = np.bincount(owner, weight, n_sets)
    cell = np.repeat(np.arange(len(element)), units)
    unit = np.arange(len(cell)) - np.repeat(np.cumsum(units) - units, units)
    room = np.minimum(1.0, weight[cell] - unit)
    element, owner = element[cell], owner[cell]
    phi = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(n_sets), where=total > 0)
    todo = total > 0
    while todo.any():
        own = todo[owner]
        _throw(element[own], unit[own].astype(np.uint64), room[own], owner[own], np.where(todo, phi, 0), k, best, mark)
        todo &= np.isinf(best.reshape(n_sets, k)).any(axis=1)
        phi = phi * 2
    return mark.reshape(n_sets, k)


def shingle_hashes(ids: np.ndarray, counts: np.ndarray, hashes: np.ndarray, size: int = WORDS):
    """(hash, text number) of all shingles of all texts; a text with fewer words than ``size`` is one shingle."""
    h, n = hashes[ids], len(ids)
    owner = np.repeat(np.arange(len(counts)), counts)
    last = np.repeat(np.cumsum(counts), counts)
    short = np.repeat(counts < size, counts)
    at = np.arange(n)
    with np.errstate(over="ignore"):
        value = np.zeros(n, np.uint64)
        for j in range(size):
            there = at + j < last
            value = value * np.uint64(0x9E3779B97F4A7C15) + np.where(there, h[np.minimum(at + j, n - 1)] if n else h,
                                                                     np.uint64(0))
        value = mix64(value + np.uint64(size))
    first = at == last - np.repeat(counts, counts)
    use = np.where(short, first, at + size <= last)
    return value[use], owner[use]


def counted(element: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every element of every set once: (element, times, owner), by owner and element."""
    order = np.lexsort((element, owner))
    element, owner = element[order], owner[order]
    first = np.ones(len(element), bool)
    first[1:] = (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return element[at], np.diff(np.append(at, len(element))), owner[at]


def cell_hashes(element: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of all cells (element, occurrence), by owner and hash."""
    element, times, owner = counted(element, owner)
    unit = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    cell, owner = mix64(np.repeat(element, times) + mix64(unit.astype(np.uint64) + np.uint64(1))), np.repeat(owner, times)
    order = np.lexsort((cell, owner))
    return cell[order], owner[order]


def band_table(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, node, bands, sketch): two hashes of the text, the 128-bit one naming its node, its band
    hashes (null without shingles) and a byte of every signature value."""
    k = bands * rows

    def work(batches):
        for b in chunks(batches, "text", CHUNK_BYTES, CHUNK_TEXTS):
            ids, counts, hashes = hashed_words(b["text"])
            element, owner = shingle_hashes(ids, counts, hashes)
            element, times, owner = counted(element, owner)
            sig = dart_signatures(element, times.astype(np.float64), owner, b.num_rows, k).reshape(-1, bands, rows)
            value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2])
            for j in range(rows):
                value = mix64(value + sig[:, :, j] * np.uint64(0x9E3779B97F4A7C15))
            sketch = (sig.reshape(b.num_rows, k) & np.uint64(0xFF)).astype(np.uint8)
            some = np.bincount(owner, minlength=b.num_rows) > 0
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * bands
            lists = pa.ListArray.from_arrays(offsets, pa.array(value.reshape(-1).view(np.int64)),
                                             mask=pa.array(~some))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["text_hash"], b["node"], lists, pa.array([r.tobytes() for r in sketch], pa.binary())],
                names=["doc_id", "text_hash", "node", "bands", "sketch"])

    text = F.coalesce("text", F.lit(""))
    src = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"),
                      F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))
    return src.mapInArrow(work, "doc_id long, text_hash long, node binary, bands array<long>, sketch binary")


def _shingle_set(text: str) -> frozenset:
    """The cells of a text: its shingles, each with the number of its occurrence."""
    words = text.encode().lower().split()
    if len(words) < WORDS:
        return frozenset([(tuple(words), 1)])
    shingles = list(zip(*(words[i:] for i in range(WORDS))))
    single = frozenset(shingles)
    if len(single) == len(shingles):
        return frozenset(zip(single, repeat(1)))
    seen, out = Counter(), []
    for s in shingles:
        seen[s] += 1
        out.append((s, seen[s]))
    return frozenset(out)


def _small(df: DataFrame, label: str) -> DataFrame:
    """A written table of links or labels in few files: a small table of many files costs more than its rows."""
    return written(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism), label)


def _both_sides(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """``pairs`` (a, b) with the value of both nodes. The value of ``b`` joins first: ``a`` is the node with many
    partners, whose value then moves once and not once a partner."""
    with_b = pairs.join(values.select(F.col("node").alias("b"), F.col(name).alias("y")), "b")
    both = with_b.join(values.select(F.col("node").alias("a"), F.col(name).alias("x")), "a")
    return both.select("a", "b", "x", "y")


def likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose signatures agree on a share of coordinates not far below ``similarity``: a pair that reaches
    it falls out with a probability of about 1e-5 (``SLACK`` is over four standard deviations)."""

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in "xy")
                share = ((x == y).mean(axis=1) * 256 - 1) / 255
                keep = pa.array(share >= similarity - SLACK)
                yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return _both_sides(pairs, sketches, "sketch").mapInArrow(work, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, same): whether the texts reach the exact Jaccard similarity of their shingle sets. Rows arrive grouped
    by ``a`` after a sort-merge join, so a hub's set is built once for its run of partners."""

    def work(batches):
        key, left = None, frozenset()
        for batch in batches:
            keep = []
            for a, x, y in zip(batch["a"].to_pylist(), batch["x"].to_pylist(), batch["y"].to_pylist()):
                if a != key:
                    key, left = a, _shingle_set(x)
                right = _shingle_set(y)
                small, large = sorted((len(left), len(right)))
                both = len(left & right) if small >= similarity * large - 1e-9 else -1
                keep.append(both >= 0 and both >= similarity * (small + large - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(keep, pa.bool_())], names=["a", "b", "same"])

    return _both_sides(pairs, texts, "text").mapInArrow(work, "a binary, b binary, same boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the connected component of every node in ``links`` (a, b).

    Every round a node takes the smallest label among its own, its neighbours' and its label's label; rounds are
    written to the shared folder and end when no label changes."""
    both = _small(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = _small(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        over = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
        said = (labels.select("node", "label", F.col("label").alias("old"))
                .union(heard.select("node", "label", F.lit(None).cast("binary")))
                .union(over.select("node", F.col("next"), F.lit(None).cast("binary"))))
        new = _small(said.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")), "labels")
        labels = new.select("node", "label")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def hub_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket table (bucket, node, weight): the member of largest weight with every other."""
    hubs = members.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("hub"))
    pairs = members.join(hubs, "bucket").select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    return pairs.where(F.col("a") != F.col("b")).distinct()


def _dealt(members: DataFrame, parts: Column) -> DataFrame:
    """Bucket members dealt to parts, their own (``guest`` false) and, if they are outside the bucket's most frequent
    component, all others; a part's own members come first."""
    home = F.pmod(F.xxhash64("node", "bucket"), parts)
    rows = members.withColumn("home", home)
    own = rows.withColumns({"part": home, "guest": F.lit(False)})
    guests = rows.where(F.col("outside") & (parts > 1)).withColumns(
        {"part": F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)), "guest": F.lit(True)}).where("part <> home")
    return own.unionByName(guests).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "guest")


class _Part:
    """The own members of a part, and which of them a probe is likely to equal."""

    def __init__(self, key: tuple, rows: list[dict], similarity: float):
        self.key, self.rows = key, rows
        self.sketches = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1).T.copy()
        self.bands = np.array([r["bands"] for r in rows], np.int64)
        self.numbers: dict[bytes, int] = {}  # of components
        self.label = np.array([self.number(r["label"]) for r in rows])
        self.outside = np.array([r["outside"] for r in rows])
        self.place = np.arange(len(rows))
        self.least = np.ceil(((similarity - SLACK) * 255 + 1) / 256 * len(self.sketches) - 1e-9)

    def number(self, label: bytes) -> int:
        return self.numbers.setdefault(label, len(self.numbers))

    def likely(self, probe: dict, at: int | None) -> np.ndarray:
        """Places of the members that a probe (own, at ``at``, or a guest) is to be tested with here, most alike first:
        in another component, met in no earlier band, signatures alike enough (a pair that reaches the similarity falls
        out with a probability of about 1e-5, ``SLACK`` being over four standard deviations). Of two probes that
        would meet twice, one is tested with the other."""
        turn = ~self.outside | (self.place > at if at is not None else probe["home"] < self.key[1])
        place = np.flatnonzero(turn & (self.label != self.number(probe["label"])))
        if not len(place):
            return place
        table = self.sketches if len(place) > len(self.rows) // 2 else self.sketches[:, place]
        equal = (table == np.frombuffer(probe["sketch"], np.uint8)[:, None]).sum(axis=0, dtype=np.int16)
        equal = equal[place] if table is self.sketches else equal
        fit = equal >= self.least
        place, equal = place[fit], equal[fit]
        band = probe["band"]
        if band and len(place):
            new = ~(self.bands[place, :band] == np.array(probe["bands"][:band], np.int64)).any(axis=1)
            place, equal = place[new], equal[new]
        return place[np.argsort(-equal, kind="stable")]


def _probes(batches, similarity: float):
    """(part, probe, its place or None) of a sorted stream of dealt rows; a part's own members are held, guests
    stream."""
    key, rows, part = None, [], None

    def own():
        nonlocal part
        part = _Part(key, rows, similarity)
        for at in np.flatnonzero(part.outside).tolist():
            yield part, rows[at], at

    for b in batches:
        for row in b.to_pylist():
            now = (row["bucket"], row["part"])
            if now != key:
                if rows and part is None:
                    yield from own()
                key, rows, part = now, [], None
            if not row["guest"]:
                rows.append(row)
            elif rows:  # a part without members of its own has nothing to compare
                if part is None:
                    yield from own()
                yield part, row, None
    if rows and part is None:
        yield from own()


def with_partners(members: DataFrame, similarity: float) -> DataFrame:
    """(bucket, node): the members of open buckets (bucket, band, node, label, outside, size, sketch, bands) that the
    signature gives a likely partner in another component."""

    def work(batches):
        now, out, seen = None, [], set()
        for part, probe, at in _probes(batches, similarity):
            if part is not now:
                now, seen = part, set()
            for node in ([probe["node"]] if len(found := part.likely(probe, at)) else []) + [part.rows[i]["node"] for i in found]:
                if node not in seen:
                    seen.add(node)
                    out.append((part.key[0], node))
            if len(out) > 4096:
                yield _pairs(out, ("bucket", "node"), (pa.int64(), pa.binary()))
                out = []
        yield _pairs(out, ("bucket", "node"), (pa.int64(), pa.binary()))

    dealt = _dealt(members, F.floor(F.col("size") / PART) + 1)
    return dealt.mapInArrow(work, "bucket long, node binary").distinct()


def spanning_links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join the components of each bucket wherever a pair of its members, in the first bucket
    they share, reaches the exact similarity; rows as for ``with_partners`` with ``cells``, sorted 64-bit hashes, and
    ``bytes``, their total in the bucket."""

    def joined(part: _Part, probe: dict, at: int | None, parent: list[int], cells: list[np.ndarray]):
        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        mine, me = np.frombuffer(probe["cells"], np.uint64), part.number(probe["label"])
        places = part.likely(probe, at)
        parent += range(len(parent), len(part.numbers))
        size = 1
        while len(places):
            here = root(me)
            places = np.array([i for i in places.tolist() if root(part.label[i]) != here], np.int64)
            batch, places = places[:size], places[size:]
            if not len(batch):
                return
            lengths = np.array([len(cells[i]) for i in batch])
            flat = np.concatenate([cells[i] for i in batch])
            spot = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            both = np.add.reduceat(mine[spot] == flat, np.cumsum(lengths) - lengths, dtype=np.int64)
            for i in batch[both >= similarity * (lengths + len(mine) - both) - 1e-9].tolist():
                if (there := root(part.label[i])) != (here := root(me)):
                    parent[there] = here
                    yield part.rows[i]["node"], probe["node"]
            size *= 2

    def work(batches):
        now, out, parent, cells = None, [], [], []
        for part, probe, at in _probes(batches, similarity):
            if part is not now:
                now, parent = part, list(range(len(part.numbers)))
                cells = [np.frombuffer(r["cells"], np.uint64) for r in part.rows]
            out += joined(part, probe, at, parent, cells)
            if len(out) > 4096:
                yield _pairs(out, ("a", "b"), (pa.binary(), pa.binary()))
                out = []
        yield _pairs(out, ("a", "b"), (pa.binary(), pa.binary()))

    dealt = _dealt(members, F.floor(F.col("bytes") / PART_BYTES) + 1)
    return dealt.mapInArrow(work, "a binary, b binary").distinct()


def _pairs(rows: list[tuple], names: tuple, types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


def cell_table(texts: DataFrame) -> DataFrame:
    """(node, cells): the sorted cell hashes of every text (node, text)."""

    def work(batches):
        for b in chunks(batches, "text", CHUNK_BYTES):
            cell, owner = cell_hashes(*shingle_hashes(*hashed_words(b["text"])))
            ends = np.cumsum(np.bincount(owner, minlength=b.num_rows))[:-1]
            cells = [c.tobytes() for c in np.split(cell, ends)]
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(cells, pa.binary())], names=["node", "cells"])

    return texts.select("node", "text").mapInArrow(work, "node binary, cells binary")


def links_in_open_buckets(open_buckets: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components that share buckets (bucket, band, node, size, label), a spanning forest of
    them in each bucket. ``sketches`` has (node, sketch, bands), ``texts`` (node, text)."""
    most = (open_buckets.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("bucket").agg(F.max(F.struct("n", "label"))["label"].alias("most")))
    told = open_buckets.join(most, "bucket").select(
        "bucket", "band", "node", "size", "label", (F.col("label") != F.col("most")).alias("outside")).join(sketches, "node")
    some = _small(with_partners(told, similarity), "partners")
    cells = cell_table(texts.join(some.select("node").distinct(), "node", "left_semi"))
    chosen = written(told.join(some, ["bucket", "node"], "left_semi").join(cells, "node"), "cells")
    total = chosen.groupBy("bucket").agg(F.sum(F.octet_length("cells").cast("long")).alias("bytes"))
    return spanning_links(chosen.join(total, "bucket"), similarity)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, group, class_id) for every row: the group's smallest node, and its smallest id."""
    marks = written(band_table(docs, bands, rows), "bands")
    every = (marks.where(F.col("bands").isNotNull()).groupBy("node").agg(F.first("bands").alias("bands"))
             .select("node", F.posexplode("bands").alias("band", "bucket")))
    sizes = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(every.join(sizes, "bucket"), "buckets")
    degree = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    members = written(shared.join(degree, "node").select("bucket", "band", "node", "weight", "size"), "members")
    known = members.select("node").distinct()
    sketches = written(marks.join(known, "node", "left_semi").groupBy("node").agg(
        F.first(F.struct("sketch", "bands")).alias("s")).select("node", "s.sketch", "s.bands"), "sketches")

    hubs = _small(likely(hub_pairs(members), sketches, similarity), "likely")
    texts = written(
        docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("node"), "text")
        .join(known, "node", "left_semi").dropDuplicates(["node"]), "texts")
    links = _small(verified(hubs, texts, similarity), "links")
    labels = components(links.where("same"))
    placed = members.select("bucket", "band", "node", "size").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    several = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    open_buckets = _small(placed.join(several.select("bucket"), "bucket", "left_semi"), "open")
    found = _small(links_in_open_buckets(open_buckets, sketches, texts, similarity), "found")
    new = _small(verified(found, texts, similarity).where("same").select("a", "b"), "new")  # on the words themselves
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    joined = new.join(la, "a", "left").join(lb, "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    roots = components(joined).toDF("label", "root")
    every = labels.union(new.select("a", "a")).union(new.select("b", "b"))  # linked for the first time: own labels
    labels = _small(every.groupBy("node").agg(F.min("label").alias("label")).join(roots, "label", "left")
                    .select("node", F.coalesce("root", "label").alias("label")), "labels")

    named = marks.select("doc_id", "text_hash", "node").join(labels, "node", "left").select(
        "doc_id", "text_hash", F.coalesce("label", "node").alias("group"))
    classes = named.groupBy("group").agg(F.min("doc_id").alias("class_id"))
    return named.join(classes, "group").select("doc_id", "text_hash", "group", "class_id")
