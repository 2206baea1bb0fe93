"""Prefix trie: against a dictionary of prefixes, for every segment length and chunk size; tree layouts."""

import hashlib
import random
import re
import zlib

import pytest

from skucast.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, borrow=True):
    """Every node by a dictionary from prefixes to members."""
    own = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None),
                             key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((r or "", x or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if borrow else 0
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:] if borrow else turns
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, cs in members.items():
        mine = (len(cs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += mine
            leaves[p[:d]] += kids[p] == 0
    sha = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p],
                   sha([c for c in cs if len(built[c]) == len(p)])) for p, cs in members.items())


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1], r))


def same(spark, rows, turns, partitions=5, monkeypatch=None):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS position", "'x' AS words").repartition(partitions)
    got = prefix_trie.prefix_trie(prefix_trie.with_borrowed_openings(df), turns).collect()
    assert order(got) == order(brute(rows))


def conversations(seed, n, length, alphabet):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randrange(length + 1)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t % 3 == 2 else "user", f"w{rng.randrange(alphabet)} a  b\n" * rng.randrange(3)))
    return rows


@pytest.mark.parametrize("turns", [1, 2, 3, 32])
def test_against_prefix_dictionary(spark, turns):
    same(spark, conversations(turns, 90, 7, 2), turns)


@pytest.mark.parametrize("keys", [1, 3])
def test_chunks_of_few_keys_change_nothing(spark, monkeypatch, keys):
    monkeypatch.setattr(prefix_trie, "KEYS", keys)
    segments = [prefix_trie.Segment(bytes([a]) * 16 + bytes([b]) * 16 * (b > 0), 1, 1, a * 4 + b, [2] + [3] * (b > 0), 0, 0)
                for a in range(4) for b in range(4)]

    class Batch:
        def __getitem__(self, name):
            cells = {"context": [bytes(16)] * 16, "number": [0] * 16}
            return Cell(cells.get(name) or [getattr(s, name) for s in segments])

    class Cell(list):
        def to_pylist(self):
            return self

    def merged(rows):
        out = {}
        for i, depth, parent, first, n, kids, leaves, saved in rows:
            o = out.setdefault(i, [depth, first, 0, 0, 0, 0])
            o[1] = min(x for x in (o[1], first) if x is not None)
            o[2:] = [x + y for x, y in zip(o[2:], (n, kids, leaves, saved))]
        return out

    parts = [r for context, number, held in prefix_trie._chunks([Batch()], 32)
             for r in prefix_trie.tree_rows(held, context, number, 32)]
    assert merged(parts) == merged(prefix_trie.tree_rows(segments, bytes(16), 0, 32))


def test_hot_conversation_long_ones_and_copies(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(60) for t in range(4)]
    rows += [(61, t, "user", f"turn {t}") for t in range(70)] + [(62, t, "user", f"turn {min(t, 50)}") for t in range(75)]
    same(spark, rows, 32)
    same(spark, rows, 5)


def test_defined_results(spark):
    rows = [(0, None, None, None), (0, 1, "user", "a b"), (0, 1, "user", "a b"), (0, 1, "assistant", "a"), (1, 0, "", ""),
            (2, 5, "user", "long " * 20000), (3, 0, "user", None), (None, 0, "user", "x"), (25, 0, "user", "a")]
    same(spark, rows, 32)
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(prefix_trie.with_borrowed_openings(empty)).count() == 0


def test_role_and_text_do_not_run_into_each_other(spark):
    rows = [(4, 0, "user", "a"), (5, 0, "use", "ra"), (6, 0, "us", "er:a")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert prefix_trie.numbered(df).select("turn_id").distinct().count() == 3


@pytest.mark.parametrize("n", [3, 5, 17, 49, 256])
def test_layouts_grow(n):
    root = prefix_trie.Node(b"")
    keys = random.Random(n).sample(range(256), n)
    for k in keys:
        prefix_trie.insert(root, bytes([k, 7, 7]), k)
    assert root.size == n and all(root.child(k).value == k for k in keys)
    assert all(root.child(k) is None for k in range(256) if k not in keys)
    assert len(root.children()) == n


def test_splits_keep_values():
    rng = random.Random(5)
    keys = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(200)}
    root = prefix_trie.Node(min(keys), min(keys))
    for k in sorted(keys, key=lambda k: k[::-1]):
        prefix_trie.insert(root, k, k)
    found, stack = {}, [(root, b"")]
    while stack:
        node, at = stack.pop()
        at += node.path
        if node.value is not None:
            found[at] = node.value
        for b in range(256):
            kid = node.child(b)
            if kid:
                stack.append((kid, at + bytes([b])))
    assert found == {k: k for k in keys}
