"""Histogram boosting: against a plain program, planted functions, early stopping, independence of partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skucast.operators import boosting as B

OPTIONS = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.5, "subsamplingRate": 1.0, "featureSubset": 1.0, "maxBins": 16}


def table(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3)).round(2)
    y = 5 + 3 * (x[:, 0] > 0.3) - 2 * (x[:, 1] > -0.5) * (x[:, 0] <= 0.3) + rng.normal(0, 0.1, n)
    return x, y, np.arange(n) % 5 == 0


def frame(spark, x, y, val, parts=3):
    rows = [(i, *map(float, r), float(t), bool(v)) for i, (r, t, v) in enumerate(zip(x, y, val))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, target double, is_val boolean").repartition(parts)


def plain(x, y, o, lam=1.0, alpha=0.1):
    """Predictions of greedy trees over all rows, one node at a time."""
    edges = [np.unique(np.percentile(x[:, j], [100 * i / o["maxBins"] for i in range(1, o["maxBins"])])) for j in range(x.shape[1])]
    margin = np.full(len(y), y.mean())
    shrink = lambda g: np.sign(g) * max(abs(g) - alpha, 0)
    score = lambda g, h: shrink(g) ** 2 / (h + lam)
    for _ in range(o["maxIter"]):
        pull, out = margin - y, np.zeros(len(y))

        def grow(rows, depth):
            g, h = pull[rows].sum(), len(rows)
            best = (1e-12, None, None)
            if depth < o["maxDepth"]:
                for j, e in enumerate(edges):
                    for cut in e:
                        left = rows[x[rows, j] <= cut]
                        if 1 <= len(left) < h:
                            gl = pull[left].sum()
                            gain = 0.5 * (score(gl, len(left)) + score(g - gl, h - len(left)) - score(g, h))
                            if gain > best[0] * (1 + 1e-8):
                                best = (gain, j, cut)
            if best[1] is None:
                out[rows] = -shrink(g) / (h + lam) * o["stepSize"]
            else:
                side = x[rows, best[1]] <= best[2]
                grow(rows[side], depth + 1)
                grow(rows[~side], depth + 1)

        grow(np.arange(len(y)), 0)
        margin = margin + out
    return margin


def test_equals_a_plain_program(spark):
    x, y, _ = table(1500)
    df = frame(spark, x, y, np.zeros(len(y), bool))
    model = B.fit(df, ["a", "b", "c"], ["id"], OPTIONS)
    got = {r.id: r.p for r in df.select("id", B.predicted(model, df).alias("p")).collect()}
    want = plain(x, y, OPTIONS)
    assert model.getNumTrees == 3 and max(abs(got[i] - want[i]) for i in range(len(y))) < 1e-9


def test_planted_function_early_stopping_and_importances(spark):
    x, y, val = table()
    df = frame(spark, x, y, val)
    model = B.fit(df, ["a", "b", "c"], ["id"], {**OPTIONS, "maxIter": 40, "subsamplingRate": 0.8, "maxBins": 128}, patience=3)
    errors = model.errors
    assert model.getNumTrees == int(np.argmin(errors)) + 1 and (len(errors) == 40 or len(errors) == model.getNumTrees + 3)
    margin = model.margins(model.binned([x[:, j] for j in range(3)]))
    assert np.mean((margin - y)[val] ** 2) < 0.05 * y.var() and abs(np.mean((margin - y)[val] ** 2) - min(errors)) < 1e-9
    shares = model.importances()
    assert shares["a"] > shares["b"] > 10 * shares["c"] and abs(sum(shares.values()) - 1) < 1e-12
    again = B.BoostedTrees.from_json(model.to_json())
    assert (again.margins(again.binned([x[:, j] for j in range(3)])) == margin).all()


@pytest.mark.parametrize("parts, chunk", [(1, 1 << 16), (7, 100)])
def test_rows_may_lie_anywhere(spark, monkeypatch, parts, chunk):
    x, y, val = table(1200)
    options = {**OPTIONS, "subsamplingRate": 0.6, "featureSubset": 0.7}
    whole = B.fit(frame(spark, x, y, val, 2), ["a", "b", "c"], ["id"], options)
    monkeypatch.setattr(B, "CHUNK", chunk)
    other = B.fit(frame(spark, x, y, val, parts), ["a", "b", "c"], ["id"], options)
    assert [t.feature.tolist() for t in whole.trees] == [t.feature.tolist() for t in other.trees]
    assert [t.cut.tolist() for t in whole.trees] == [t.cut.tolist() for t in other.trees]
    assert all(np.allclose(t.value, u.value) for t, u in zip(whole.trees, other.trees))


def test_a_level_is_one_job_over_evenly_dealt_chunks(spark, monkeypatch):
    x, y, val = table(1000)
    df = frame(spark, x, y, val, 5)
    sc = spark.sparkContext
    jobs = []
    for trees in (1, 4):
        sc.setJobGroup(f"boosting-{trees}", "")
        assert B.fit(df, ["a", "b", "c"], ["id"], {**OPTIONS, "maxIter": trees}).getNumTrees == trees
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"boosting-{trees}")))
    sc.setJobGroup("", "")
    assert jobs[1] - jobs[0] == 3 * OPTIONS["maxDepth"]
    monkeypatch.setattr(B, "CHUNK", 20)
    model = B.BoostedTrees(["a", "b", "c"], [[0.0]] * 3, 0.0)
    dealt = B.dealt_chunks(B.chunk_table(df, model, [F.col("id")], "target")).glom().map(len).collect()
    assert len(dealt) == sc.defaultParallelism and max(dealt) - min(dealt) <= 1


def test_splits_of_all_nodes_and_columns_at_once():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 4, (4, 5, 16)).astype(float)
    g = rng.normal(0, 3, h.shape) * h
    h[2, 3], g[2, 3], h[1], g[1] = 0, 0, 0, 0
    whole = B.best_splits(g, h, 1.0, 0.1, 1.0)
    assert all([x[k, i] for x in whole] == list(B.best_split(g[k, i], h[k, i], 1.0, 0.1, 1.0)) for k in range(4) for i in range(5))
    found = B.level_splits(np.stack([g, h]), [2, 3, 5, 7, 11], 1.0, 0.1, 1.0)
    assert [r.node for r in found] == [0, 2, 3] and all(r.gain == whole[1][r.node].max() for r in found)


def test_regularisation_shrinks_leaves_and_splits():
    g, h = np.array([-3.0, -3.0, 2.0]), np.array([1.0, 1.0, 1.0])
    at, gain, left, rows = B.best_split(g, h, 1.0, 0.0, 1.0)
    assert (at, left, rows) == (1, -6.0, 2.0) and abs(gain - 0.5 * (36 / 3 + 4 / 2 - 16 / 4)) < 1e-6
    assert B.best_split(g, h, 1.0, 100.0, 1.0)[0] == -1  # nothing is left of the gradients
    assert B.best_split(g, h, 1.0, 0.0, 2.0)[0] == -1  # every side needs two rows


def test_empty_and_constant(spark):
    x, y, val = table(50)
    df = frame(spark, x, y, val)
    model = B.fit(df.limit(0), ["a", "b", "c"], ["id"], OPTIONS)
    assert model.base == 0 and df.select(B.predicted(model, df).alias("p")).where("p <> 0").count() == 0
    model = B.fit(df.withColumn("target", F.lit(4.0)), ["a", "b", "c"], ["id"], OPTIONS)
    assert df.select(B.predicted(model, df).alias("p")).where("abs(p - 4) > 1e-9").count() == 0


def test_cut_points_are_quantiles_of_all_training_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "RUN", 300)
    rng = np.random.default_rng(9)
    n = 3000
    a = np.where(np.arange(n) % 2 == 0, 0.0, rng.normal(0, 1e6, n))  # every second day has one value
    b, c = rng.integers(-3, 4, n).astype(float), -(10.0 ** rng.integers(-300, 300, n))
    val = np.arange(n) % 7 == 0
    rows = [(i, float(a[i]), float(b[i]), None if i % 3 else float(c[i]), None, bool(val[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, is_val boolean").repartition(5)
    df = df.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id")))
    shares = [i / 16 for i in range(1, 16)]
    train = df.where("not is_val")
    want = [sorted(set(train.agg(F.percentile(x, F.array(*map(F.lit, shares)))).first()[0] or [])) for x in "abcd"]
    assert B.edges_of(df, ["a", "b", "c", "d"], 16) == want and len(want[0]) > 7 and want[3] == []
    assert B.edges_of(df.limit(0), ["a", "b"], 16) == [[], []]


def test_cut_points_of_more_rows_than_a_sample(spark):
    n = 1_200_000  # the rows beyond a million counted only by every second day
    df = spark.range(n).selectExpr("date_add(date'2020-01-01', cast(id % 2 as int)) AS date", "if(id % 2 = 0, 0D, cast(id AS double)) AS a",
                                   "false AS is_val")
    want = df.agg(F.percentile("a", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    assert B.edges_of(df, ["a"], 4) == [sorted(set(want))] and want[2] > 0


def test_ordered_keys_keep_the_order_of_doubles():
    x = np.array([-np.inf, -1e300, -1.0, -1e-320, 0.0, 1e-320, 1.0, 1e300, np.inf, np.nan])
    keys = B.ordered(x)
    assert (np.diff(keys.astype(object)) > 0).all() and np.array_equal(B.of_ordered(keys), x, equal_nan=True)
    assert B.ordered(np.array([-0.0]))[0] == B.ordered(np.array([0.0]))[0]
