"""Near-duplicate groups against all pairs, signature agreement against weighted Jaccard, defined results."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from skucast.llm import common, dart


def brute(docs):
    sets = [dart._shingle_set(t) if (t or "").split() else None for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        x, y = sets[a], sets[b]
        same = (docs[a][1] or "") == (docs[b][1] or "")
        if same or (x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    smallest = {g: min((d for d in m if d is not None), default=None) for g, m in groups.items()}
    return sorted(((d, smallest[find(i)]) for i, (d, _) in enumerate(docs)), key=str)


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS bucket").repartition(3)
    return sorted(((r.doc_id, r.class_id) for r in dart.near_duplicates(df).collect()), key=str)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def test_matches_all_pairs(spark):
    rng = random.Random(5)
    docs, vocabulary = [], [f"v{i}" for i in range(500)]
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.choice([30, 80, 300]))
        for _ in range(rng.choice([1, 2, 9, 25])):
            docs.append((len(docs), edited(rng, base, rng.randrange(0, max(2, len(base) // 40)))))
    docs += [(900, "one two"), (901, "ONE two"), (902, "one two three"), (903, ""), (904, None), (905, " \n"),
             (None, "one two"), (906, "x" * 70000), (907, "x" * 70000), (907, "x" * 70000), (908, "a " * 400), (909, "a " * 900)]
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    names = rng.integers(1, 2**63, 400).astype(np.uint64)
    x, y = rng.integers(0, 4, 400) * 0.75, rng.integers(0, 4, 400) * 0.75
    y[:300] = x[:300]
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    element, weight = np.concatenate((names, names)), np.concatenate((x, y))
    a, b = dart.dart_signatures(element, weight, np.repeat([0, 1], 400), 2, 3000)
    assert abs((a == b).mean() - want) < 0.03
    (alone,) = dart.dart_signatures(names, y, np.zeros(400, np.int64), 1, 3000)
    assert (alone == b).all()


def test_word_hashes_of_sliced_batches():
    texts = [f"Word{i} the\x0bCat é{i} " * (i % 5) for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    seen = []
    for part in common.chunks([batch], "text", 300):
        ids, counts, hashes = common.hashed_words(part["text"])
        seen += np.split(hashes[ids], np.cumsum(counts)[:-1])
    import xxhash
    for text, got in zip(texts, seen, strict=True):
        assert got.tolist() == [xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()]


@pytest.mark.parametrize("text, n", [("", 0), ("a", 1), ("a b c d", 1), ("a b c d e", 1), ("a b c d e f", 2)])
def test_shingle_counts(text, n):
    element, owner = dart.shingle_hashes(*common.hashed_words(pa.array([text, "x y z u v w"])))
    assert (owner == 0).sum() == n and (owner == 1).sum() == 2


def test_link_beyond_the_most_alike_members_of_a_large_group(spark):
    """400 near copies, to all but one of which an outside text stays just under the threshold."""
    for seed in (1, 2):
        rng = random.Random(seed)

        def fresh(n):
            return [f"u{rng.randrange(10**9)}" for _ in range(n)]

        common, shared = fresh(400), fresh(50)
        docs = [(i, " ".join(common + shared + fresh(50))) for i in range(400)]
        docs += [(500, " ".join(common + shared + fresh(46))), (501, " ".join(common))]
        assert {group for _, group in run(spark, docs)} == {0}


def searched(spark, rows, texts):
    """Links of the components of one bucket; rows are (node, label, band values), equal sketches for all."""
    name = lambda n: bytes([n]) * 16
    open_buckets = spark.createDataFrame([(7, 1, name(n), len(rows), name(label)) for n, label, _ in rows],
                                         "bucket long, band int, node binary, size long, label binary")
    sketches = spark.createDataFrame([(name(n), bytes(75), bands) for n, _, bands in rows], "node binary, sketch binary, bands array<long>")
    table = spark.createDataFrame([(name(n), texts[n]) for n, _, _ in rows], "node binary, text string")
    return [(r.a[0], r.b[0]) for r in dart.links_in_open_buckets(open_buckets, sketches, table, 0.8).collect()]


def test_pairs_whose_sketch_alone_agrees_in_an_earlier_band(spark):
    """The bytes of band 0 agree by chance, the real bucket is that of band 1: the pair is tested there. A pair that
    shares band 0 itself was tested there and is not tested again."""
    texts = dict.fromkeys((1, 2, 3, 4), "a b c d e f g h i j")
    found = searched(spark, [(1, 1, [5, 9]), (2, 1, [6, 9]), (3, 3, [7, 9]), (4, 4, [7, 9])], texts)
    assert len(found) == 2 and {frozenset(f) & {3, 4} for f in found} == {frozenset((3,)), frozenset((4,))}


@pytest.mark.parametrize("part, part_bytes", [(8192, 32 << 20), (3, 200), (1, 1)])
def test_parts_of_buckets_find_the_same_components(spark, monkeypatch, part, part_bytes):
    monkeypatch.setattr(dart, "PART", part)
    monkeypatch.setattr(dart, "PART_BYTES", part_bytes)
    rng = random.Random(3)
    bases = [[f"b{f}x{i}" for i in range(300)] for f in range(4)]
    texts = {n: edited(rng, bases[n % 4], n % 3) for n in range(1, 25)}
    found = searched(spark, [(n, n, [n, 9]) for n in texts], texts)
    assert len(found) >= 20
    parent = {n: n for n in texts}

    def root(n):
        return n if parent[n] == n else root(parent[n])

    for a, b in found:
        parent[root(a)] = root(b)
    assert {frozenset(n for n in texts if root(n) == root(m)) for m in texts} == {
        frozenset(n for n in texts if n % 4 == f) for f in range(4)}
    if part > 100:
        assert len(found) == 20  # a spanning forest


def test_repeats_weigh(spark):
    line = "one two three four five six seven"
    docs = [(1, line + " x " * 3), (2, (line + " ") * 9), (3, (line + " ") * 10), (4, (line + " ") * 20)]
    assert run(spark, docs) == brute(docs) == [(1, 1), (2, 2), (3, 2), (4, 4)]
