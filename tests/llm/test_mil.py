"""Attention-based classifier: gradients, pooling, held-out accuracy, defined results."""

import numpy as np
import pyarrow as pa
import pytest

from skucast.llm import mil
from tests.conftest import SF01


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = mil.new_model(1)
    n = np.array([1, 4, 2])
    x, y = rng.normal(size=(7, mil.WIDTH)), np.array([1.0, 0.0, 1.0])
    g = mil.gradients(model, x, n, y)
    for name in model:
        for at in list(np.ndindex(model[name].shape))[:: max(1, model[name].size // 5)]:
            up, down = ({k: v.copy() for k, v in model.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            slope = (mil.gradients(up, x, n, y)["loss"][0] - mil.gradients(down, x, n, y)["loss"][0]) / 2e-5
            assert g[name][at] == pytest.approx(slope, rel=1e-3, abs=1e-6)


def test_attention_weights_sum_to_one_and_order_is_free():
    rng = np.random.default_rng(1)
    model, x = mil.new_model(2), rng.normal(size=(5, mil.WIDTH))
    one = mil.forward(model, x, np.array([5]))
    other = mil.forward(model, x[::-1], np.array([5]))
    assert one["a"].sum() == pytest.approx(1) and one["logit"] == pytest.approx(other["logit"])


def test_passages_cover_whole_texts():
    words = 3 * mil.PASSAGE + 5
    x, n = mil.passages(pa.array(["w " * words, "", None, "one"]))
    assert n.tolist() == [4, 1, 1, 1] and x.shape == (7, mil.WIDTH)
    assert np.expm1(4 * x[:, 0]).round().tolist() == [64, 64, 64, 5, 0, 0, 1]


def test_held_out_accuracy_and_determined_scores(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    model = mil.fit(docs, labels)
    from skucast.llm.common import fold_of
    held = mil.score(docs, model).join(labels, "doc_id").where(fold_of(5) == 0).collect()
    right = [(r.score >= mil.THRESHOLD) == (r.quality == 1) for r in held]
    assert len(right) > 50 and np.mean(right) > 0.95
    good = [r.score >= mil.THRESHOLD for r in held if r.quality == 1]
    assert np.mean(good) > 0.98


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "y"), (None, None, None), (2, "", None), (3, "z" * 90000, "q")],
                                 "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9, 1)], "doc_id long, quality int")
    none = labels.limit(0)
    for given, flat in ((labels, False), (none, True)):
        rows = mil.score(docs, mil.fit(docs, given)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert all(r.score == 0.5 for r in rows) == flat
        assert {r.quality for r in rows} == {"x", "y", None, "q"}
    assert mil.score(docs.limit(0), None).count() == 0


def test_sample_holds_whole_texts_of_the_table(spark):
    docs = spark.createDataFrame([(i, "w " * (40 * mil.PASSAGE)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    bags = mil.training_bags(docs, labels, 5, 8).collect()
    assert [r.n for r in bags] == [40] * 8
    assert {len(r.bag) for r in bags} == {40 * mil.WIDTH * 4}
