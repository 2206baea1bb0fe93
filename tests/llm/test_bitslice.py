"""Bit-sliced top-k against plain inner products; ties, odd vectors, block sizes, big and tiny components."""

import math
import random

import numpy as np
import pytest

from skucast.llm import bitslice


def plain(rows, k, every):
    vecs = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vecs.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out, done = [], set()
    for i, v in sorted(vecs):
        if i % every or i in done:
            continue
        done.add(i)
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in vecs if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, k=3, every=4, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'c' AS score", "1 AS block")
    v = df.select("vec_id", bitslice.quantised("embedding").alias("v"))
    got = bitslice.top_inner_products(v, v.where(v.vec_id % every == 0), k, **kw).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_matches_plain(spark, block):
    rng = random.Random(block)
    rows = [(i, [round(rng.gauss(0, 0.3), 2) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]  # ties
    rows += [(500, None), (504, [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (508, [math.nan] * 6), (512, [math.inf] * 6), (None, [1.0] * 6),
             (516, [0.0] * 6), (520, []), (524, [9.0, -900.0, 3.0]), (524, [9.0, -900.0, 3.0]), (525, [1e4] * 6)]
    assert run(spark, rows, block=block) == plain(rows, 3, 4)


def test_fewer_rows_than_k_and_empty(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])], k=5) == [(0, 1, 1, 256 * 512)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


@pytest.mark.parametrize("drop", [0, 2, 5])
def test_sliced_scores_bound_exact_ones(drop):
    rng = np.random.default_rng(drop)
    rows = rng.integers(-200, 200, (130, 9))
    block = bitslice.Block(np.arange(130), rows, drop)
    query = rng.integers(-200, 200, 9)
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) for s in block.score_slices(query)]
    sliced = sum(b << w for w, b in enumerate(bits)) << block.drop
    exact = rows @ query
    gap = exact - sliced
    assert gap.max() - gap.min() <= np.abs(query).sum() * ((1 << block.drop) - 1)


@pytest.mark.parametrize("rows", [[(0, [1e30]), (1, [1.0])], [(0, [1e13] * 3), (1, [1e13] * 3)]])
def test_components_too_large_for_scores_are_an_error(spark, rows):
    with pytest.raises(Exception, match="too large|62 bits"):
        run(spark, rows)


def test_many_cells_match_plain(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [round(rng.gauss(0, 0.3), 2) for _ in range(5)]) for i in range(120)] + [(200 + i, []) for i in range(8)]
    monkeypatch.setattr(bitslice, "QUERIES", 4)
    monkeypatch.setattr(bitslice, "HELD", 4 * 5 * 8)
    assert run(spark, rows, every=3, block=9) == plain(rows, 3, 3)
    assert run(spark, rows[120:]) == plain(rows[120:], 3, 4)


def test_copies_follow_the_groups_not_the_blocks():
    n_blocks, n_sets = 1880, 602  # 15.4 million rows, a fiftieth of them queries
    across, down = bitslice.grid(15_400_000, 308_000, n_blocks, n_sets, 64, 24)
    assert across * down <= 2 * 24 and 308_000 / down * 64 * 8 <= bitslice.HELD
    whole = 15_400_000 * down + 308_000 * across
    assert whole < 3 * 15_400_000 < 308_000 * n_blocks / 10
    assert bitslice.grid(0, 0, 1, 1, 0, 24) == (1, 1)


def test_blocks_are_packed_in_the_smallest_integers(spark):
    rows = [(1, [1, -128]), (2, [300, 0]), (3, [1 << 20, 1]), (4, [1 << 40, 1])]
    for row, kind, size in zip(rows, ("<i1", "<i2", "<i4", "<i8"), (1, 2, 4, 8)):
        packed = bitslice._blocks(spark.createDataFrame([row], "vec_id long, v array<long>"), 1).first()
        assert (packed.kind, len(packed.matrix), packed.dims) == (kind, 2 * size, 2)
