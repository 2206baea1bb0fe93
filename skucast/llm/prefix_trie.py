"""Operator 11: the prefix trie of conversations, by adaptive radix trees over turn ids.

A turn's id is 16 bytes, the big-endian MD5 of its role and text, so that a conversation is a byte string of fixed
width a turn and prefixes of conversations are prefixes of bytes. A tree's nodes grow from 4 over 16 and 48 to 256
children and keep the bytes that all keys below share (path compression); most of its byte positions are inside a
turn or inside a compressed path. Only depths that are a whole number of turns give nodes of the result.

One tree of all conversations would not fit a task. So conversations are cut into segments of ``TURNS`` turns: a
segment's context is the identity of the node that it starts at, and each context has a tree of its own. Equal
segments are one key with a count, so copies of a conversation meet before the shuffle. Keys are range-partitioned
by (context, key), the order of the leaves, which splits hot openings as well; a task streams its range and builds
trees of at most ``KEYS`` keys. Every chunk of keys also inserts its neighbour keys on both sides as ghosts, that
count nothing: a node on the left ghost's path was counted before, a key that the right ghost prolongs has a child.
All columns of a node are then sums (or minima) over chunks. What later segments add to the nodes above them is
one sum a conversation, carried along as a number of the segment's key.

A node is told by the XOR of 128-bit hashes of (position, turn id) along its path, so the contexts come from one
running XOR. Memory: one chunk of keys a task. A conversation's turns are numbered, and the ids of the members that
end at one node are digested, in one task each, streamed in order (SHA-256 is sequential by definition).

Defined results: null roles and texts are empty; turns are ordered by turn (null first), role and text, repeated
rows all count; rows without conv_id belong to no conversation and take no part; a conversation without turns ends
at the root; a table without conversations has no nodes. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skucast.llm.common import written

WIDTH = 16  # bytes of a turn id
TURNS, KEYS = 32, 100_000
WORD = r"[^\x20\x09-\x0D]+"
PARTIAL = "id binary, depth long, parent binary, first long, n long, kids long, leaves long, saved long"


class Node:
    """A node of the tree: ``path`` (the bytes below its own branching byte that all keys share), the value of the
    key that ends here, and children by byte in the layout that their number asks for: up to 4 unsorted bytes, up to
    16 sorted bytes, up to 48 through a 256-byte index, then a slot for every byte."""

    __slots__ = ("path", "value", "size", "bytes", "kids")

    def __init__(self, path: bytes, value=None):
        self.path, self.value, self.size, self.bytes, self.kids = path, value, 0, bytearray(), []

    def _slot(self, byte: int) -> int:
        """Where the child of ``byte`` is in ``kids``; -1 without one."""
        if self.size <= 4:
            return self.bytes.find(byte)
        if self.size <= 16:
            at = bisect_left(self.bytes, byte)
            return at if at < self.size and self.bytes[at] == byte else -1
        if self.size <= 48:
            return self.bytes[byte] - 1
        return byte if self.kids[byte] is not None else -1

    def child(self, byte: int) -> Node | None:
        at = self._slot(byte)
        return self.kids[at] if at >= 0 else None

    def add(self, byte: int, kid: Node) -> None:
        """Adds a child under a byte that has none, after growing the layout where it is full."""
        if self.size == 4:
            order = sorted(range(4), key=self.bytes.__getitem__)
            self.bytes, self.kids = bytearray(self.bytes[i] for i in order), [self.kids[i] for i in order]
        elif self.size == 16:
            index = bytearray(256)
            for at, b in enumerate(self.bytes):
                index[b] = at + 1
            self.bytes = index
        elif self.size == 48:
            slots = [None] * 256
            for b, at in enumerate(self.bytes):
                if at:
                    slots[b] = self.kids[at - 1]
            self.bytes, self.kids = bytearray(), slots
        if self.size >= 48:
            self.kids[byte] = kid
        elif self.size >= 16:
            self.kids.append(kid)
            self.bytes[byte] = len(self.kids)
        else:
            at = bisect_left(self.bytes, byte) if self.size >= 4 else self.size
            self.bytes.insert(at, byte)
            self.kids.insert(at, kid)
        self.size += 1

    def children(self) -> list[Node]:
        return [k for k in self.kids if k is not None] if self.size > 48 else self.kids


def insert(root: Node, key: bytes, value) -> None:
    """Puts ``value`` at ``key``; a key that is there already keeps its place and gets the new value."""
    node, at = root, 0
    while True:
        path = node.path
        if not key.startswith(path, at):
            there = key[at:at + len(path)]
            differ = int.from_bytes(path[:len(there)]) ^ int.from_bytes(there)
            n = len(there) - (differ.bit_length() + 7) // 8
            low = Node(path[n + 1:], node.value)  # the node's lower half, below the byte where the key leaves
            low.size, low.bytes, low.kids = node.size, node.bytes, node.kids
            node.path, node.value, node.size, node.bytes, node.kids = path[:n], None, 0, bytearray(), []
            node.add(path[n], low)
            path = node.path
        at += len(path)
        if at == len(key):
            node.value = value
            return
        kid = node.child(key[at])
        if kid is None:
            node.add(key[at], Node(key[at + 1:], value))
            return
        node, at = kid, at + 1


def position_hash(position: int, turn: bytes) -> int:
    return int.from_bytes(hashlib.md5(turn + str(position).encode()).digest())


class Segment:
    """Value of a key: ``n`` conversations, ``last`` of them ending here, the smallest id, words a turn, and what
    later segments of the members add. ``ghost``: -1 for the neighbour on the left, 1 on the right."""

    __slots__ = ("key", "n", "last", "first", "words", "more_saved", "more_leaves", "ghost")

    def __init__(self, key, n, last, first, words, more_saved, more_leaves, ghost=0):
        self.key, self.n, self.last, self.first, self.words = key, n, last, first, words
        self.more_saved, self.more_leaves, self.ghost = more_saved, more_leaves, ghost

    def ids(self, context: int, start: int) -> list[int]:
        out = [context]
        for i in range(0, len(self.key), WIDTH):
            out.append(out[-1] ^ position_hash(start + i // WIDTH + 1, self.key[i:i + WIDTH]))
        return out


def tree_rows(segments: list[Segment], context: bytes, number: int, turns: int) -> list[tuple]:
    """The node rows (``PARTIAL``) of the tree of these segments, all of one context and segment number. Nodes that
    only ghosts reach give no row; the context's own node gets the number of its children here, or, as the
    root of all, a whole row."""
    root = Node(segments[0].key, segments[0])
    for s in segments[1:]:
        insert(root, s.key, s)
    start, base, out = number * turns, int.from_bytes(context), []
    done: dict[int, list] = {}  # node -> [n, first, kids, leaves, saved, old, sample] of its subtree
    stack = [(root, -1, False)]
    while stack:
        node, above, seen = stack.pop()
        end = above + 1 + len(node.path)
        if not seen:
            stack.append((node, above, True))
            stack += [(k, end, False) for k in node.children()]
            continue
        n = kids = leaves = saved = 0
        first, old, sample = None, False, None
        for k in node.children():
            kn, kf, kk, kl, ks, ko, kx = done.pop(id(k))
            n, kids, leaves, saved, old = n + kn, kids + kk, leaves + kl, saved + ks, old or ko
            first = kf if first is None or (kf is not None and kf < first) else first
            sample = sample or kx
        own = node.value
        if own is not None and own.ghost:
            old = old or own.ghost < 0
        elif own is not None:
            n, saved, leaves = n + own.n, saved + own.more_saved, leaves + own.more_leaves
            first = own.first if first is None else min(first, own.first)
            goes_on = len(own.key) == turns * WIDTH and own.last < own.n
            leaves += not node.size and not goes_on
            sample = (own, own.ids(base, start))
        for depth in range(end // WIDTH, max(above // WIDTH, -1), -1):  # turn-aligned depths of this node's bytes
            if not n:
                break
            segment, ids = sample
            if depth:
                saved += (n - (not old)) * segment.words[depth - 1]
                out.append((ids[depth], start + depth, ids[depth - 1], first, n, kids, leaves, saved))
                kids = int(not old)
            elif number:
                out.append((base, start, None, None, 0, kids, 0, 0))
            else:
                out.append((base, 0, None, first, n, kids, leaves, saved))
        done[id(node)] = [n, first, kids, leaves, saved, old, sample]
    return out


def _chunks(batches, turns: int) -> Iterator[tuple[bytes, int, list[Segment]]]:
    """(context, segment number, segments in order) of a sorted stream, ``KEYS`` keys at most, with ghosts."""
    now, held = None, []
    for b in batches:
        rows = zip(*(b[c].to_pylist() for c in (
            "context", "number", "key", "n", "last", "first", "words", "more_saved", "more_leaves")))
        for context, number, *rest in rows:
            s = Segment(*rest)
            if not s.n:
                s.ghost = -1 if now != (context, number) else 1
            if now != (context, number):
                if held:
                    yield (*now, held)
                now, held = (context, number), []
            elif len(held) > KEYS:
                left, s.ghost = held[-1], s.ghost or 2  # a plain neighbour for this chunk, a key of the next
                yield (*now, [*held, s])
                s.ghost %= 2
                held = [Segment(left.key, 0, 0, None, left.words, 0, 0, -1)]
            held.append(s)
    if held:
        yield (*now, held)


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PARTIAL.split(", ")]
    binary = {"id", "parent"}
    cells = [[r[i] for r in rows] for i in range(len(names))]
    return pa.RecordBatch.from_arrays(
        [pa.array([None if v is None else v.to_bytes(WIDTH) for v in cell], pa.binary()) if name in binary
         else pa.array(cell, pa.int64()) for name, cell in zip(names, cells)], names=names)


def _partial_nodes(segments: DataFrame, turns: int) -> DataFrame:
    def work(batches):
        rows = []
        for context, number, held in _chunks(batches, turns):
            if any(s.n for s in held):
                rows += tree_rows(held, context, number, turns)
            while len(rows) > 50_000:
                yield _columns(rows[:50_000])
                rows = rows[50_000:]
        yield _columns(rows)

    return segments.mapInArrow(work, PARTIAL)


def _new_parts(segments: DataFrame, turns: int) -> DataFrame:
    """(first, number, new_words, new_leaves) of every key: the words of the nodes that it is the first key to
    reach, and whether it ends at a node without children."""

    def work(batches):
        for _, number, held in _chunks(batches, turns):
            out = []
            for i, s in enumerate(held):
                if s.ghost:
                    continue
                before, after = (held[i - 1].key if i else b""), (held[i + 1].key if i + 1 < len(held) else b"")
                shared = 0
                while shared < len(s.words) and before[:WIDTH * (shared + 1)] == s.key[:WIDTH * (shared + 1)]:
                    shared += 1
                goes_on = len(s.words) == turns and s.last < s.n
                leaf = not goes_on and not after.startswith(s.key)
                out.append((s.first, number, sum(s.words[shared:]), int(leaf)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], pa.int64()) for i in range(4)],
                names=["first", "number", "new_words", "new_leaves"])

    return segments.mapInArrow(work, "first long, number long, new_words long, new_leaves long")


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def _id_of(high: Column, low: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, position from 1, turn_id as hex, words), without rows that have no conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       role.alias("role"), text.alias("text")).where(F.col("conv_id").isNotNull())
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return src.select(
        "conv_id", F.row_number().over(order).cast("long").alias("position"),
        F.md5(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text").cast("binary")).alias("turn_id"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def with_borrowed_openings(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Numbered turns in which conversation c opens with the first h turns of conversation c - c % ``family`` in
    place of its own first h, h = crc32(c) % ``most``; conversations without turns have one row without a turn."""
    own = numbered(turns)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    head = F.col("conv_id") - F.col("conv_id") % family
    all_ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).where(F.col("conv_id").isNotNull()).distinct()
    openings = own.where((head == F.col("conv_id")) & (F.col("position") < most)).select(
        F.col("conv_id").alias("head"), "position", "turn_id", "words")
    borrowed = all_ids.select("conv_id", head.alias("head"), h.alias("h")).join(openings, "head").where(
        F.col("position") <= F.col("h"))
    nothing = all_ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("position"),
                             F.lit(None).cast("string").alias("turn_id"), F.lit(None).cast("long").alias("words"))
    rows = (nothing.unionByName(borrowed.select("conv_id", F.lit(0).alias("part"), "position", "turn_id", "words"))
            .unionByName(own.where(F.col("position") > h).withColumn("part", F.lit(1))))
    order = Window.partitionBy("conv_id").orderBy("part", "position")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("position"), "turn_id", "words")


def _segments(rows: DataFrame, turns: int) -> DataFrame:
    """(conv_id, number, context, key, words, last, end): a conversation's segments; ``end`` is the node that the
    segment ends at. Position 0 holds no turn, so a conversation without turns is an empty segment."""
    digest = F.md5(F.concat(F.unhex("turn_id"), F.col("position").cast("string").cast("binary")))
    number = F.floor(F.greatest(F.col("position") - 1, F.lit(0)) / turns)
    has = F.col("turn_id").isNotNull()
    cut = rows.withColumns({"number": number, "high": F.when(has, _half(digest, 1)), "low": F.when(has, _half(digest, 17))})
    packed = cut.groupBy("conv_id", "number").agg(
        F.sort_array(F.collect_list(F.when(has, F.struct("position", "turn_id", "words")))).alias("t"),
        F.coalesce(F.bit_xor("high"), F.lit(0).cast("long")).alias("high"),
        F.coalesce(F.bit_xor("low"), F.lit(0).cast("long")).alias("low"))
    order = Window.partitionBy("conv_id").orderBy("number")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    upto = packed.select(
        "conv_id", "number", "high", "low", F.bit_xor("high").over(so_far).alias("to_high"),
        F.bit_xor("low").over(so_far).alias("to_low"), F.lead("number").over(order).isNull().alias("last"),
        F.unhex(F.array_join(F.transform("t", lambda x: x["turn_id"]), "")).alias("key"),
        F.transform("t", lambda x: x["words"]).alias("words"))
    return upto.select(
        "conv_id", "number", "key", "words", "last", _id_of(F.col("to_high"), F.col("to_low")).alias("end"),
        _id_of(F.col("to_high").bitwiseXOR(F.col("high")), F.col("to_low").bitwiseXOR(F.col("low"))).alias("context"))


def _distinct(segments: DataFrame) -> DataFrame:
    """Equal segments as one row; ``more_saved`` and ``more_leaves`` are summed."""
    return segments.groupBy("context", "number", "key").agg(
        F.sum("n").alias("n"), F.sum("last").alias("last"), F.min("first").alias("first"), F.first("words", True).alias("words"),
        F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"))


def _ordered(distinct: DataFrame, label: str) -> DataFrame:
    """The segments as sorted ranges, one a task, each with its neighbours in other ranges as rows of n = 0.

    The ranges are written, as a second execution could draw others; two rows a range are exchanged."""
    at = ["context", "number", "key"]
    ranged = written(distinct.repartitionByRange(*at).withColumn("part", F.spark_partition_id()), label)
    edges = ranged.groupBy("part").agg(F.min(F.struct(*at, "words")).alias("low"), F.max(F.struct(*at, "words")).alias("high"))
    parts = Window.orderBy("part")  # one row a range
    sides = edges.select("part", "low", "high", F.lag("high").over(parts).alias("before"), F.lead("low").over(parts).alias("after"))
    ghosts = sides.select("part", F.explode(F.array(
        F.when(F.col("before.context") == F.col("low.context"), F.col("before")),
        F.when(F.col("after.context") == F.col("high.context"), F.col("after")))).alias("g")).where("g IS NOT NULL")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    rows = ranged.unionByName(ghosts.select("part", "g.*").withColumns(
        {"n": zero, "last": zero, "first": none, "more_saved": zero, "more_leaves": zero}))
    return rows.repartition("part").sortWithinPartitions("part", *at)


def _single(segments: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return segments.select("context", "number", "key", F.lit(1).cast("long").alias("n"), F.col("last").cast("long").alias("last"),
                           F.col("conv_id").alias("first"), "words", zero.alias("more_saved"), zero.alias("more_leaves"))


def _from_later_segments(segments: DataFrame, turns: int) -> DataFrame:
    """Rows to be added to the distinct segments: what the members' later segments save and how many leaves they
    hold, each node counted for the smallest of its first key's members."""
    later = segments.where(F.col("number") > 0)
    new = _new_parts(_ordered(_distinct(_single(later)), "later"), turns)
    long_ones = segments.join(later.where(F.col("number") == 1).select("conv_id"), "conv_id", "left_semi")
    mine = long_ones.join(new.withColumnRenamed("first", "conv_id"), ["conv_id", "number"], "left")
    said = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
    none = F.lit(0).cast("long")
    after = Window.partitionBy("conv_id").orderBy(F.desc("number")).rowsBetween(Window.unboundedPreceding, -1)
    sums = mine.select("context", "number", "key", "words",
                       F.sum(said - F.coalesce("new_words", none)).over(after).alias("more_saved"),
                       F.sum(F.coalesce("new_leaves", none)).over(after).alias("more_leaves"))
    zero = F.lit(0).cast("long")
    return sums.where("more_saved IS NOT NULL").select(
        "context", "number", "key", zero.alias("n"), zero.alias("last"), F.lit(None).cast("long").alias("first"), "words",
        "more_saved", "more_leaves")


def _ends(segments: DataFrame) -> DataFrame:
    """(id, ends_sha256): the digest of the ids, in order, of the conversations that end at a node."""

    def work(batches):
        now, digest = None, None
        for b in batches:
            out = []
            for node, conv in zip(b["id"].to_pylist(), b["conv_id"].to_pylist()):
                if node != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())],
                                             names=["id", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["id", "ends_sha256"])

    ends = segments.where("last").select(F.col("end").alias("id"), "conv_id")
    return ends.repartition("id").sortWithinPartitions("id", "conv_id").mapInArrow(work, "id binary, ends_sha256 string")


def prefix_trie(rows: DataFrame, turns: int = TURNS) -> DataFrame:
    """One row a node of the trie of numbered turns (``numbered``, ``with_borrowed_openings``): conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` is the length of a segment; the result does not depend on it."""
    segments = written(_segments(rows, turns), "segments")
    all_rows = _single(segments).unionByName(_from_later_segments(segments, turns))
    partial = _partial_nodes(_ordered(_distinct(all_rows), "keys"), turns)
    names = [c.split()[0] for c in PARTIAL.split(", ")]
    ends = _ends(segments).select("id", *[F.lit(None).cast("binary" if c == "parent" else "long").alias(c) for c in names[1:]],
                                  "ends_sha256")
    merged = partial.withColumn("ends_sha256", F.lit(None).cast("string")).unionByName(ends).groupBy("id").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("first").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")], F.max("ends_sha256").alias("ends_sha256"))
    nodes = written(merged, "nodes")
    above = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
