"""Operator 3: document quality by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` words each, the last may be shorter). A passage is described by
figures of its words (length, letters in upper case, digits, signs, repeats) and by a hashed bag of word shapes
and characters; nothing but the text enters. A layer encodes every passage, gated attention gives each a weight
(softmax of w . (tanh(V h) * sigmoid(U h)) over the document), and a logistic unit scores the weighted passage
representation. All parts are learned together from document labels alone, by Adam on the whole training sample:
tasks return the gradients of their part of the sample, whose sums are a few thousand numbers.

The training sample is bounded: of the labelled ids in the table, outside the held-out fold, the ``SAMPLE`` of
smallest id hash, with all their passages. Scoring covers whole texts too.

Defined results: a null or empty text is a bag of one passage without words; several labels of an id count as the
larger; null ids are held out; repeated rows stay; without any labelled training row every score is 0.5; an empty
table gives no rows. Further columns are passed on by ``score`` and ignored in training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skucast.llm.common import chunks, fold_of, hashed_words, written

PASSAGE, BUCKETS = 64, 64
SAMPLE = 4000
HIDDEN, ATTENTION, STEPS, RATE, DECAY = 24, 12, 60, 0.03, 1e-4
THRESHOLD = 0.3
CHUNK_BYTES = 6 << 20
N_FIGURES = 12
WIDTH = N_FIGURES + BUCKETS


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(passages x WIDTH features, passages per text)."""
    ids, counts, hashes, words = hashed_words(texts, lower=False, with_words=True)
    n = np.maximum(1, -(-counts // PASSAGE))
    first = np.cumsum(n) - n
    place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    passage = np.repeat(first, counts) + place // PASSAGE
    total = int(n.sum())
    size = np.bincount(passage, minlength=total).astype(np.float64)
    per = np.maximum(size, 1)

    def share(values: np.ndarray) -> np.ndarray:
        return np.bincount(passage, values[ids].astype(np.float64), total) / per

    def count(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False)

    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    upper, digits, letters = count(r"\p{Lu}"), count(r"\p{N}"), count(r"\p{L}")
    signs, marks = count(r"[#*$%&|<>]"), count(r"[!?]")
    alone = (letters + digits == 0).astype(np.float64)
    # words that stood before in their passage, and words equal to the word before
    seen = np.unique(passage * max(len(hashes), 1) + ids) // max(len(hashes), 1)
    distinct = np.bincount(seen, minlength=total)
    same = np.zeros(len(ids))
    same[1:] = (ids[1:] == ids[:-1]) & (passage[1:] == passage[:-1])
    chars = share(length)
    per_char = np.maximum(chars, 1e-9)
    figures = np.stack([
        np.log1p(size) / 4, chars / 8, share(upper) / per_char, share(digits) / per_char, share(signs),
        share(marks), share(letters) / per_char, share(alone), distinct / per,
        np.bincount(passage, same, total) / per, share((length - letters - digits > 1).astype(np.float64)),
        share((upper > 1).astype(np.float64))], axis=1)
    bag = np.bincount(passage * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64)[ids], minlength=total * BUCKETS)
    bag = np.sqrt(bag.reshape(total, BUCKETS) / per[:, None])
    return np.concatenate([figures, bag], axis=1), n


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION),
              "w": (ATTENTION,), "c": (HIDDEN,), "d": (1,)}
    return {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def forward(model: dict, x: np.ndarray, n: np.ndarray) -> dict:
    """Logits of bags: ``x`` holds the passages of all bags in order, ``n`` the passages per bag (1 at least)."""
    starts, bag = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    h = np.maximum(x @ model["W"] + model["b"], 0)
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    e = (t * g) @ model["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "starts": starts, "logit": z @ model["c"] + model["d"]}


def gradients(model: dict, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over the bags of the gradients of the log loss; ``loss`` beside them."""
    s = forward(model, x, n)
    p = _sigmoid(s["logit"])
    dl = p - y
    dz = dl[:, None] * model["c"]
    dzh = (dz[s["bag"]] * s["h"]).sum(axis=1)
    de = s["a"] * (dzh - np.add.reduceat(s["a"] * dzh, s["starts"])[s["bag"]])
    dtg = de[:, None] * model["w"]
    dt, dg = dtg * s["g"] * (1 - s["t"] ** 2), dtg * s["t"] * s["g"] * (1 - s["g"])
    dh = (s["a"][:, None] * dz[s["bag"]] + dt @ model["V"].T + dg @ model["U"].T) * (s["h"] > 0)
    loss = np.logaddexp(0, s["logit"]) - y * s["logit"]
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": s["h"].T @ dt, "U": s["h"].T @ dg,
            "w": (s["t"] * s["g"]).T @ de, "c": s["z"].T @ dl, "d": dl.sum(keepdims=True),
            "loss": loss.sum(keepdims=True)}


def training_bags(docs: DataFrame, labels: DataFrame, folds: int, sample: int) -> DataFrame:
    """(quality, n, passages) of the bounded training sample, written to the shared folder."""
    chosen = (labels.where(F.col("quality").isNotNull() & (fold_of(folds) != 0))
              .join(docs.select("doc_id"), "doc_id", "left_semi")
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def work(batches):
        for b in chunks(batches, "text", CHUNK_BYTES):
            x, n = passages(b["text"])
            bags = [part.tobytes() for part in np.split(x.astype("<f4"), np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([b["quality"].cast(pa.int32()), pa.array(n, pa.int32()), pa.array(bags, pa.binary())],
                                             names=["quality", "n", "bag"])

    # at most ``sample`` rows of two numbers: a proven bound
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return written(rows.select("quality", "text").mapInArrow(work, "quality int, n int, bag binary"), "bags")


def train(bags: DataFrame, steps: int = STEPS) -> dict[str, np.ndarray] | None:
    """Adam on the whole sample; one Spark job a step returns the gradient sums of its tasks."""
    total = bags.count()
    if not total:
        return None
    model = new_model()
    sizes = {k: v.size for k, v in model.items()}
    m, v = {k: np.zeros_like(x) for k, x in model.items()}, {k: np.zeros_like(x) for k, x in model.items()}

    def part(current):
        def work(batches):
            for b in chunks(batches, "bag", CHUNK_BYTES):
                n = b["n"].to_numpy()
                x = np.frombuffer(b"".join(b["bag"].to_pylist()), "<f4").reshape(-1, WIDTH).astype(np.float64)
                g = gradients(current, x, n, b["quality"].to_numpy().astype(np.float64))
                flat = np.concatenate([g[k].reshape(-1) for k in [*sizes, "loss"]])
                yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["g"])
        return work

    few = bags.coalesce(4)  # the rows of the sample are bounded
    for step in range(1, steps + 1):
        got = few.mapInArrow(part(model), "g binary").collect()
        flat, at = np.sum([np.frombuffer(r.g, np.float64) for r in got], axis=0) / total, 0
        rate = RATE * (1 - (step - 1) / steps)
        for k, size in sizes.items():
            g = flat[at:at + size].reshape(model[k].shape) + DECAY * model[k]
            at += size
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            model[k] = model[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return model


def score(docs: DataFrame, model: dict | None, col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text (column text) added as ``col``."""
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(col, T.DoubleType())])

    def work(batches):
        for b in chunks(batches, "text", CHUNK_BYTES):
            if model is None:
                p = np.full(b.num_rows, 0.5)
            else:
                x, n = passages(b["text"])
                p = _sigmoid(forward(model, x, n)["logit"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*names, col])

    return docs.mapInArrow(work, schema)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> dict | None:
    return train(training_bags(docs, labels, folds, sample))
