"""Operator 9: best-fit packing of token sequences with swap-based local search.

A document's tokens are its ids and one end id. Documents of over ``size`` tokens are cut into pieces of ``size``,
the first of which may be shorter, and full pieces are sequences by themselves. All shorter pieces are dealt in
turn to shards of about ``SHARD`` pieces, whatever their ids, and each shard is packed by one task: best fit in
order of falling length, then local search. The search takes underfull bins, the emptiest first, and moves tokens out
of each into fuller underfull bins, by moving a document, or by exchanging one of its documents, or two, for one
smaller document; every step increases the sum of squared fills. Pieces of underfull bins are indexed by length and by
the room of their bin, so a step looks at the lengths, not at the pieces. The search ends when the lower bound of bins
is reached or a pass over all underfull bins allows no step.

Ids are those of the tokenizer file's vocabulary as ranks, read by the faster of the two tokenizer libraries; the
tests hold them against the other. ``added`` names the tokens that stand beside the vocabulary in the tokenizer file:
their strings in a text are single ids, as in that library; without it they are ordinary text.

Defined results: a null text is empty (the end id alone); null ids and repeated rows are documents of their own;
an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skucast.llm.common import chunks

SIZE, END_ID = 1024, 2
SHARD = 1 << 13
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, shard long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def added_tokens(path: str) -> dict[str, int]:
    """The tokens of the tokenizer file (JSON) at ``path`` that are matched in texts as they stand."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that are matched with their surroundings are not supported")
    return {t["content"]: t["id"] for t in tokens}


def encoder(path: str, pattern: str, added: dict[str, int] | None = None):
    """Encoding by the rank file at ``path``."""
    import tiktoken

    from skucast.llm.bpe import read_ranks
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens=added or {})


def _cut(batches, path: str, pattern: str, size: int, shards: int, added: dict[str, int]):
    code = encoder(path, pattern, added)
    task, full, short = TaskContext.get().partitionId(), 0, 0
    for b in chunks(batches, "text"):
        rows = []
        for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
            ids = np.array([*code.encode(text, allowed_special="all", disallowed_special=()), END_ID], "<u4")
            starts = [0, *range(len(ids) % size or size, len(ids), size)] if len(ids) > size else [0]
            for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                crc = zlib.crc32(ids[s:e].tobytes())
                if e - s == size:
                    full += 1
                    rows.append((doc, k, s, size, crc, -((task << 36) + full), 0, -((task << 20) + full // SHARD) - 1))
                else:
                    short += 1
                    rows.append((doc, k, s, e - s, crc, 0, 0, (task * 7919 + short) % shards))
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                         names=[c.split()[0] for c in PIECES.split(", ")])


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            bins[at].append(i)
        else:
            room, at = size, len(bins)
            bins.append([i])
        left = room - need
        if left:
            with_room[left].append(at)
            rooms |= 1 << left
    return bins


class _Underfull:
    """Bins with room: bins by room, and pieces by length and room of their bin, with bit masks of the rooms there
    are."""

    def __init__(self, size: int):
        self.bins: list[set[int]] = [set() for _ in range(size + 1)]
        self.rooms = 0
        self.pieces: dict[int, dict[int, set[tuple[int, int]]]] = {}
        self.room_of: dict[int, int] = {}  # length -> bit mask of rooms

    def put(self, bin_: int, room: int, pieces: list[int], lengths: list[int]) -> None:
        self.bins[room].add(bin_)
        self.rooms |= 1 << room
        for p in pieces:
            self.pieces.setdefault(lengths[p], {}).setdefault(room, set()).add((bin_, p))
            self.room_of[lengths[p]] = self.room_of.get(lengths[p], 0) | 1 << room

    def take(self, bin_: int, room: int, pieces: list[int], lengths: list[int]) -> None:
        self.bins[room].discard(bin_)
        if not self.bins[room]:
            self.rooms &= ~(1 << room)
        for p in pieces:
            there = self.pieces[lengths[p]][room]
            there.discard((bin_, p))
            if not there:
                del self.pieces[lengths[p]][room]
                self.room_of[lengths[p]] &= ~(1 << room)
                if not self.room_of[lengths[p]]:
                    del self.room_of[lengths[p]]

    @staticmethod
    def least(mask: int, room: int) -> int:
        """The smallest room of ``mask`` that is at least ``room``; -1 without one."""
        mask >>= room
        return room + (mask & -mask).bit_length() - 1 if mask else -1


def _best_step(own: list[int], fill: int, index: _Underfull, lengths: list[int], size: int):
    """(gain, pieces out, bin, piece back or None) of the step that fills a bin best, from a bin of ``fill`` that is
    not in the index; two pieces against one only if one does not do. Equal gains go to the first found."""
    best = None

    def consider(group: tuple[int, ...], total: int, length: int, room: int):
        nonlocal best
        delta = total - length
        gain = 2 * delta * (size - room - fill + delta)
        if gain > 0 and (best is None or gain > best[0]):
            if length:
                best = gain, group, *min(index.pieces[length][room])
            else:
                best = gain, group, min(index.bins[room]), None

    by_length = {lengths[p]: p for p in own}
    for total, p in by_length.items():
        if (room := index.least(index.rooms, total)) >= 0:
            consider((p,), total, 0, room)
    twos = {lengths[p] + lengths[q]: (p, q) for i, p in enumerate(own) for q in own[:i]}
    for groups in ({t: (p,) for t, p in by_length.items()}, twos):
        if best is None:
            for length, mask in index.room_of.items():
                for total, group in groups.items():
                    if total > length and (room := index.least(mask, total - length)) >= 0:
                        consider(group, total, length, room)
        elif groups is not twos:
            for length, mask in index.room_of.items():
                for total, group in groups.items():
                    delta = total - length
                    if delta > 0 and 2 * delta * (size - fill) > best[0] and (room := index.least(mask, delta)) >= 0:
                        consider(group, total, length, room)
    return best


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Empties bins by moves and exchanges that raise the sum of squared fills, until no bin allows a step."""
    bins = [list(b) for b in bins]
    fill = [sum(lengths[p] for p in b) for b in bins]
    bound = math.ceil(sum(fill) / size)
    index, n_bins, moved = _Underfull(size), len(bins), True
    for b, f in enumerate(fill):
        if f < size:
            index.put(b, size - f, bins[b], lengths)
    while moved and n_bins > bound:
        moved = False
        for source in sorted((b for b, f in enumerate(fill) if 0 < f < size), key=lambda b: (fill[b], b)):
            if not 0 < fill[source] < size or n_bins <= bound:
                continue
            index.take(source, size - fill[source], bins[source], lengths)
            while bins[source] and (step := _best_step(bins[source], fill[source], index, lengths, size)):
                _, group, at, back = step
                index.take(at, size - fill[at], bins[at], lengths)
                for p in group:
                    bins[source].remove(p)
                bins[at] += group
                if back is not None:
                    bins[at].remove(back)
                    bins[source].append(back)
                delta = sum(lengths[p] for p in group) - (lengths[back] if back is not None else 0)
                fill[at], fill[source], moved = fill[at] + delta, fill[source] - delta, True
                if fill[at] < size:
                    index.put(at, size - fill[at], bins[at], lengths)
            if bins[source]:
                index.put(source, size - fill[source], bins[source], lengths)
            else:
                n_bins -= 1
    return [b for b in bins if b]


def _pack(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    if pdf["shard"].iloc[0] < 0:  # full pieces, which have their sequences
        return pdf.drop(columns="shard")
    pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece"], ignore_index=True)
    lengths = pdf["length"].tolist()
    sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
    for k, members in enumerate(local_search(best_fit(lengths, size), lengths, size)):
        at = 0
        for i in members:
            sequence[i], offset[i] = (int(pdf["shard"].iloc[0]) << 32) + k, at
            at += lengths[i]
    return pdf.assign(sequence_id=sequence, offset=offset).drop(columns="shard")


def pack_documents(docs: DataFrame, path: str, pattern: str, size: int = SIZE, shard: int = SHARD,
                   added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: where it starts in its document, and its sequence and offset there."""
    shards = max(1, math.ceil(docs.count() / shard))
    pieces = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        lambda it: _cut(it, path, pattern, size, shards, added or {}), PIECES)
    return pieces.groupBy("shard").applyInPandas(lambda pdf: _pack(pdf, size), PACKED)
