"""Operator 5: byte-level BPE encoding and decoding with higher-order functions.

Texts are cut into pieces by the tokenizer's pattern; every chunk of texts keeps its distinct pieces and the piece
numbers of its texts in a written table. Texts are first cut before spaces where a piece surely ends, and the pattern
is matched on each distinct such unit once a chunk, not on every word again (other patterns than the one this is shown
for are matched on each distinct whole text). The distinct pieces of all chunks meet in buckets by hash, each once.
Spark folds the ranked merges over the byte array of each distinct piece: the state is the array of token ids, one a byte at first, and the ranks of adjacent pairs; each step joins
the leftmost pair of lowest rank, whose rank is the id of the joined token, and looks up the two new pairs, until
no pair has a rank. The rank map is a literal: for every way to split a token into two, (left id, right id) ->
rank, dealt to an array of small maps, since a Spark map is searched from its start. Decoding looks up the bytes of every
id in a literal array of binary values and concatenates them. A bucket stores its result in the shared folder (a
mounted file system) as a sorted table of hashes and a blob of ids and decoded bytes, which workers map into memory
and read only where their texts' pieces are; every decoded piece is compared with its source there. Only distinct
pieces are shuffled, so no frequent piece makes a hot group; the number of buckets follows the input, a chunk holds
``CHUNK_BYTES`` of text or one longer text.

A piece that is itself a token is that token, as in the tiktoken library, and is not folded. A fold copies its arrays
at every merge, so its time grows with the square of a piece's length: pieces of over ``LONG_PIECE`` bytes are merged
with a heap instead, by the same ranks and with the same result.

Defined results: a null text is empty (no ids); null ids and repeated rows stay as they are; an empty table gives
no rows. Further columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skucast.llm.common import chunks, mounted, shared_folder, shuffles_dropped, store_array, written

CHUNK_BYTES, PIECES_AT_ONCE, BYTES_AT_ONCE, UNITS_AT_ONCE = 8 << 20, 100_000, 1 << 20, 1 << 18
CUT = "doc_ids array<long>, counts array<int>, low binary, high binary, pieces binary, lens binary"
BUCKETS = 1 << 14
LONG_PIECE = 512


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with lines of base64 bytes and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(key): int(rank) for key, rank in map(bytes.split, f)}


def _bucket(left, right):
    return left * 31 + right


def pair_literal(ranks: dict[bytes, int]) -> Column:
    """Literal array of ``BUCKETS`` maps from left id * 2^32 + right id to the rank of the joined token."""
    keys: list[list[int]] = [[] for _ in range(BUCKETS)]
    values: list[list[int]] = [[] for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                at = _bucket(left, right) % BUCKETS
                keys[at].append((left << 32) + right)
                values[at].append(rank)
    rows = json.dumps([{"k": k, "v": v} for k, v in zip(keys, values)])
    return F.transform(F.from_json(F.lit(rows), "array<struct<k:array<bigint>,v:array<int>>>"),
                       lambda b: F.map_from_arrays(b["k"], b["v"]))


def token_literal(ranks: dict[bytes, int]) -> Column:
    """Literal array<binary> of the bytes of every id."""
    names = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        names[rank] = base64.b64encode(token).decode()
    return F.transform(F.from_json(F.lit(json.dumps(names)), "array<string>"), F.unbase64)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def encode_piece(piece: Column, pairs_of: Column) -> Column:
    """Ids of one piece, given as the ids of its bytes, by folding merges from the lowest rank upwards. The ids stand
    between two that no pair has (-1), so every pair has neighbours."""

    def rank(left: Column, right: Column) -> Column:
        return F.element_at(F.get(pairs_of, _bucket(left, right).bitwiseAND(F.lit(BUCKETS - 1))),
                            F.shiftleft(left.cast("bigint"), 32) + right)

    def merge(state: Column, _step: Column) -> Column:
        ids, pairs = state["ids"], state["pairs"]

        def at(p: Column) -> Column:  # the pair's place, from 1; null if no pair has a rank
            low = F.get(pairs, p - 1)
            return F.when(p.isNull(), state).otherwise(F.struct(
                F.concat(F.slice(ids, F.lit(1), p - 1), F.array(low), F.slice(ids, p + 2, F.size(ids))).alias("ids"),
                F.concat(F.slice(pairs, F.lit(1), p - 2),
                         F.array(rank(F.get(ids, p - 2), low), rank(low, F.get(ids, p + 1))),
                         F.slice(pairs, p + 2, F.size(pairs))).alias("pairs")))

        return _let(F.array_position(pairs, F.array_min(pairs)).cast("int"), at)

    edge = F.array(F.lit(-1))
    first = _let(F.concat(edge, piece, edge), lambda ids: F.struct(ids.alias("ids"), F.transform(
        F.slice(ids, 2, F.size(ids)), lambda right, i: rank(F.get(ids, i), right)).alias("pairs")))
    steps = F.slice(piece, 2, F.size(piece))  # a merge less than bytes at most
    return F.aggregate(steps, first, merge, lambda s: F.slice(s["ids"], F.lit(2), F.size(s["ids"]) - 2))


def decode_ids(ids: Column, tokens: Column) -> Column:
    return F.aggregate(ids, F.lit(b""), lambda so_far, i: F.concat(so_far, F.get(tokens, i)))


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a very long piece: a heap of ranked pairs over a linked list of parts."""
    part = [piece[i:i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    heap = [(ranks[k], i, k) for i in range(len(part) - 1) if (k := part[i] + part[i + 1]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, key = heapq.heappop(heap)
        j = after[i] if part[i] else len(part)
        if j >= len(part) or part[i] + part[j] != key:
            continue  # one of the two has been merged since
        part[i], part[j], after[i] = key, b"", after[j]
        if after[i] < len(part):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(part) and (k := part[a] + part[b]) in ranks:
                heapq.heappush(heap, (ranks[k], a, k))
    return [ranks[p] for p in part if p]


def _unblob(blob: bytes, lens: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lens, "<u4"), dtype=np.int64).tolist()
    return [blob[s:e] for s, e in zip([0, *ends[:-1]], ends)]


def _array(blob, lens: np.ndarray) -> pa.LargeBinaryArray:
    """The values that stand one after another in ``blob``, zero copy."""
    ends = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(ends), pa.py_buffer(blob)])


def _parts(values: pa.LargeBinaryArray) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of all values one after another, and where each ends (from 0)."""
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2] or pa.py_buffer(b"")
    return data.slice(int(ends[0]), int(ends[-1] - ends[0])), ends - ends[0]


def _list(values: pa.LargeBinaryArray) -> list[bytes]:
    data, ends = _parts(values)
    return _unblob(data.to_pybytes(), np.diff(ends).astype("<u4").tobytes())


def _hashes(pieces: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in all ranges one after another, and where each range ends (from 0)."""
    cuts = np.concatenate(([0], np.cumsum(stops - starts)))
    return np.arange(cuts[-1]) + np.repeat(starts - cuts[:-1], stops - starts), cuts


#: With this pattern a piece ends before every space that stands before a character other than whitespace.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: First bytes of characters that are no whitespace, but for characters that begin with two bytes of ``MAYBE_SPACE``.
PLAIN = np.arange(256) > 32
MAYBE_SPACE = (0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380)


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where a space stands before a character that is surely no whitespace. Pieces of ``SPACED`` hold a space only
    at their start or between whitespace, and of the whitespace before another character all but the last is one
    piece, so no piece goes over such a place and texts cut there have the same pieces."""
    at = np.flatnonzero(data[:-1] == 32)
    after = data[at + 1]
    fine = PLAIN[after]
    wide = np.flatnonzero((after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3)))
    two = (after[wide].astype(np.int32) << 8) + data[np.minimum(at[wide] + 2, len(data) - 1)]
    fine[wide] = ~np.isin(two, MAYBE_SPACE)
    return at[fine]


def _units(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut where pieces surely end (for other patterns not at all): the units, coded, units per text, and which
    of the distinct units may stand behind any text without a change of its pieces or theirs."""
    data, ends = _parts(texts.cast(pa.large_binary()))
    flat = np.frombuffer(data, np.uint8)
    begins = np.zeros(len(flat) + 1, bool)
    begins[ends] = True
    if pattern == SPACED:
        cuts = _cuts(flat)
        begins[cuts[~begins[cuts + 1]]] = True  # no cut before a text's last character
    at = np.flatnonzero(begins[:-1])
    coded = _array(data, np.diff(np.append(at, len(flat)))).dictionary_encode()
    apart = np.zeros(len(coded.dictionary), bool)
    if pattern == SPACED:
        data, heads = _parts(coded.dictionary)
        spaced = np.zeros(len(data) + 1, bool)
        spaced[_cuts(np.frombuffer(data, np.uint8))] = True
        apart = spaced[heads[:-1]] & (np.diff(heads) > 1)
    return coded, np.diff(np.searchsorted(at, ends)), apart


def _pieces(units: pa.LargeBinaryArray, apart: np.ndarray, find) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces of all units, coded, where those of each unit start among them, and pieces per unit. Units that may
    stand together are searched at once."""
    sizes, counts, parts, found, order = np.diff(_parts(units)[1]), np.zeros(len(units), np.int64), [], [], []

    def put():
        parts.append(pa.array(found, pa.large_string()))
        found.clear()

    together, = np.nonzero(apart)
    for block in np.split(together, np.flatnonzero(np.diff(np.cumsum(sizes[together]) // BYTES_AT_ONCE)) + 1):
        joined, stops = _parts(units.take(pa.array(block)))
        found += find(joined.to_pybytes().decode())
        put()
        counts[block] = np.diff(np.searchsorted(_parts(parts[-1].cast(pa.large_binary()))[1], stops))
        order.append(block)
    alone, = np.nonzero(~apart)
    for i in alone.tolist():
        pieces = find(units[i].as_py().decode())
        found += pieces
        counts[i] = len(pieces)
        if len(found) > PIECES_AT_ONCE:
            put()
    put()
    coded = pa.concat_arrays(parts).dictionary_encode()
    order = np.concatenate([*order, alone]).astype(np.int64)
    starts = np.empty(len(units), np.int64)
    starts[order] = np.cumsum(counts[order]) - counts[order]
    return coded, starts, counts


def _cut(batches, pattern: str):
    """One row a chunk: ids and piece counts of its texts, the piece numbers of all texts (low 16 bits and the
    rest apart, which packs better), and the distinct pieces with their lengths. Only distinct units are searched."""
    import regex

    find = regex.compile(pattern).findall
    for b in chunks(batches, "text", CHUNK_BYTES):
        units, per_text, apart = _units(b["text"], pattern)
        coded, starts, counts = _pieces(units.dictionary, apart, find)
        numbers, of = (x.indices.to_numpy(zero_copy_only=False) for x in (coded, units))
        ends = np.concatenate(([0], np.cumsum(counts[of])))[np.concatenate(([0], np.cumsum(per_text)))]
        stops = starts + counts
        numbers = np.concatenate([numbers[:0], *[numbers[_ranges(starts[u], stops[u])[0]] for u in (
            of[lo:lo + UNITS_AT_ONCE] for lo in range(0, len(of), UNITS_AT_ONCE))]])
        often = np.argsort(-np.bincount(numbers, minlength=len(coded.dictionary)), kind="stable")  # frequent pieces first
        rank = np.empty(len(often), np.int32)
        rank[often] = np.arange(len(often), dtype=np.int32)
        numbers = rank[numbers]
        names, stops = _parts(coded.dictionary.cast(pa.large_binary()).take(pa.array(often)))
        row = [b["doc_id"].to_pylist(), np.diff(ends).astype(np.int32), (numbers & 0xFFFF).astype("<u2").tobytes(),
               (numbers >> 16).astype("<u2").tobytes(), names.to_pybytes(), np.diff(stops).astype("<u4").tobytes()]
        del units, coded, of, numbers
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)],
                                         names=[c.split()[0] for c in CUT.split(", ")])


def _deal(batches, bits: int, path: str):
    """The distinct pieces of every chunk that are no tokens, by top bits of their hashes."""
    tokens = pa.array(list(read_ranks(path)), pa.large_binary())
    for b in batches:
        for blob, lens in zip(b["pieces"].to_pylist(), b["lens"].to_pylist()):
            pieces = _array(blob, np.frombuffer(lens, "<u4"))
            pieces = pieces.filter(pc.invert(pc.is_in(pieces, value_set=tokens)))
            bucket = (_hashes(_list(pieces)) >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))[:len(pieces)]
            data, ends = _parts(pieces.take(pa.array(order)))
            lens = np.diff(ends).astype("<u4")
            blobs = [(data[int(ends[s]):int(ends[e])].to_pybytes(), lens[s:e].tobytes()) for s, e in zip(at, np.append(at[1:], len(pieces)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[order[at]], pa.int32()), *[pa.array([x[j] for x in blobs], pa.binary()) for j in (0, 1)]],
                names=["bucket", "pieces", "lens"])


def _distinct(group: pa.Table, of_byte: np.ndarray) -> pa.Table:
    """A bucket's distinct pieces, and the ids of their bytes (none for long pieces, which are not folded)."""
    seen: set[bytes] = set()
    for blob, lens in zip(group["pieces"].to_pylist(), group["lens"].to_pylist()):
        seen.update(_unblob(blob, lens))
    pieces = sorted(seen)
    folded = [p if len(p) <= LONG_PIECE else b"" for p in pieces]
    ends = np.concatenate(([0], np.cumsum([len(p) for p in folded], dtype=np.int64))).astype(np.int32)
    ids = pa.ListArray.from_arrays(ends, pa.array(of_byte[np.frombuffer(b"".join(folded), np.uint8)]))
    rows = [0, len(pieces)]
    return pa.table({"bucket": group["bucket"].slice(0, 1).combine_chunks(),
                     "pieces": pa.ListArray.from_arrays(rows, pa.array(pieces, pa.binary())),
                     "bytes": pa.ListArray.from_arrays(rows, ids)})


#: A stored piece: its hash, where its part of the blob ends, and the bytes of its ids there (its bytes follow).
ENTRY = np.dtype([("hash", "<u8"), ("end", "<u8"), ("id_bytes", "<u4")])


def _id_type(ranks: dict[bytes, int]) -> np.dtype:
    return np.min_scalar_type(max(ranks.values(), default=0)).newbyteorder("<")


def _keep(batches, folder: str, path: str):
    """Stores a bucket: the entries in order of their hashes, and the blob of ids and decoded bytes."""
    ranks = read_ranks(path)
    names, kind = {v: k for k, v in ranks.items()}, _id_type(ranks)
    for b in batches:
        for row in range(b.num_rows):
            bucket, pieces = b["bucket"][row].as_py(), b["pieces"][row].as_py()
            lists = b["ids"][row].values
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(kind)
            ids = [flat[s:e].tobytes() for s, e in zip(at[:-1], at[1:])]
            decoded = b["decoded"][row].values.to_pylist()
            for i, piece in enumerate(pieces):
                if len(piece) > LONG_PIECE:
                    merged = _merge_long(piece, ranks)
                    ids[i], decoded[i] = np.array(merged, kind).tobytes(), b"".join([names[x] for x in merged])
            hashes = _hashes(pieces)
            order = np.argsort(hashes).tolist()
            entries = np.zeros(len(pieces), ENTRY)
            entries["hash"], entries["id_bytes"] = hashes[order], [len(ids[i]) for i in order]
            entries["end"] = np.cumsum([len(ids[i]) + len(decoded[i]) for i in order])
            store_array(folder, f"{bucket}-blob", np.frombuffer(b"".join([x for i in order for x in (ids[i], decoded[i])]), np.uint8))
            store_array(folder, f"{bucket}-entries", entries)
            yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([len(pieces)])], names=["bucket", "n"])


def _gathered(blob: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ranges one after another, and the length of each."""
    return blob[_ranges(starts, stops)[0]], stops - starts


def _looked_up(pieces: pa.LargeBinaryArray, folder: str, bits: int, tokens: pa.Array, kind: np.dtype):
    """The ids, as bytes, and the decoded bytes of every piece: tokens (in order of their ids) by their place, others
    from the store."""
    place = pc.index_in(pieces, value_set=tokens)
    known = place.is_valid().to_numpy(zero_copy_only=False)
    ranks = place.drop_null()
    encoded = [_array(ranks.to_numpy().astype("<u4").tobytes(), np.full(len(ranks), 4))]
    decoded, others = [tokens.take(ranks)], np.flatnonzero(~known)
    hashes = _hashes(_list(pieces.take(pa.array(others))))
    order = np.argsort(hashes)
    hashes = hashes[order]
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], np.diff(bucket) != 0)))[:len(others)]
    for lo, hi in zip(at, np.append(at[1:], len(others))):
        entries = np.load(f"{folder}/{bucket[lo]}-entries.npy", mmap_mode="r")
        blob = np.load(f"{folder}/{bucket[lo]}-blob.npy", mmap_mode="r")
        places = np.searchsorted(entries["hash"], hashes[lo:hi])
        stops = entries["end"][places].astype(np.int64)
        starts = np.where(places > 0, entries["end"][places - 1], 0).astype(np.int64)
        middle = starts + entries["id_bytes"][places]
        ids, sizes = _gathered(blob, starts, middle)
        encoded.append(_array(ids.view(kind).astype("<u4").tobytes(), sizes // kind.itemsize * 4))
        decoded.append(_array(*_gathered(blob, middle, stops)))
    back = np.empty(len(pieces), np.int64)
    back[np.concatenate((np.flatnonzero(known), others[order]))] = np.arange(len(pieces))
    return [pa.concat_arrays(x).take(pa.array(back)) for x in (encoded, decoded)]


def _assemble(batches, folder: str, bits: int, path: str):
    """The ids and the decoded bytes of every text from those of its pieces."""
    ranks = read_ranks(path)
    kind, names = _id_type(ranks), [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        names[rank] = token
    tokens = pa.array(names, pa.large_binary())
    for b in batches:
        for at_row in range(b.num_rows):
            (row,) = b.slice(at_row, 1).to_pylist()
            pieces = _array(row["pieces"], np.frombuffer(row["lens"], "<u4"))
            coded = _looked_up(pieces, folder, bits, tokens, kind)
            if not coded[1].equals(pieces):
                raise ValueError("a decoded piece differs from its source")
            numbers = np.frombuffer(row["low"], "<u2") + (np.frombuffer(row["high"], "<u2").astype(np.int32) << 16)
            ends = np.concatenate(([0], np.cumsum(row["counts"], dtype=np.int64)))
            for lo in range(0, len(row["doc_ids"]), 200):
                stops = ends[lo:lo + 201]
                of, out = pa.array(numbers[stops[0]:stops[-1]]), []
                for values in coded:
                    data, cuts = _parts(values.take(of))
                    out.append(_array(data, np.diff(cuts[stops - stops[0]])).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][lo:lo + 200], pa.int64()), *out],
                                                 names=["doc_id", "ids", "decoded"])


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as little-endian unsigned 32-bit integers, and the bytes that
    decoding them gives. ``path`` names a rank file that every worker can read."""
    ranks = read_ranks(path)
    pair_map, tokens = pair_literal(ranks), token_literal(ranks)
    folder = mounted(shared_folder(docs.sparkSession, "pieces"))
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    cut = written(text.mapInArrow(lambda it: _cut(it, pattern), CUT), "cut")
    bits = max(3, math.ceil(math.log2(2 * docs.rdd.getNumPartitions())))
    dealt = cut.select("pieces", "lens").mapInArrow(lambda it: _deal(it, bits, path), "bucket int, pieces binary, lens binary")
    # written, so that no task has a Python worker on either side of the fold
    of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
    with shuffles_dropped(docs.sparkSession):
        found = written(dealt.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(
            lambda group: _distinct(group, of_byte), "bucket int, pieces array<binary>, bytes array<array<int>>"), "distinct")
    # folds take long: buckets are dealt evenly to tasks, though not one each, as every task reads the literals
    found = found.repartition(min(1 << bits, 4 * docs.sparkSession.sparkContext.defaultParallelism))
    coded = found.withColumn("ids", _let(pair_map, lambda m: F.transform("bytes", lambda p: encode_piece(p, m))))
    coded = coded.withColumn("decoded", _let(tokens, lambda t: F.transform("ids", lambda ids: decode_ids(ids, t))))
    stored = coded.drop("bytes").mapInArrow(lambda it: _keep(it, folder, path), "bucket long, n long")
    with shuffles_dropped(docs.sparkSession):
        stored.agg(F.sum("n")).collect()
    return cut.mapInArrow(lambda it: _assemble(it, folder, bits, path), "doc_id long, ids binary, decoded binary")
