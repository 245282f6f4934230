"""Operator 8: toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Features are the distinct hashes of words, of neighbouring pairs and of pairs
that skip one word. FTRL-proximal keeps a rate for each coordinate, and its L1
term leaves most weights at zero, so the model is a short list of (bucket,
weight), broadcast to score every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, giving_back, is_held_out, pair, read, slices, word_hashes

BUCKETS = 1 << 20
#: Labelled documents learned from at most (about), chosen by a hash of the id.
MAX_TRAIN_DOCS = 12_000
#: Rate, its offset, sparsity, shrinkage and epochs, chosen by log loss on a part of the training rows (crc32 mod 4 is 1,
#: fitted on 0 and 3); held-out rows had no part in it.
ALPHA, BETA, L1, L2 = 1.2, 1.0, 16.0, 0.5
EPOCHS = 8
THRESHOLD = 0.3
_BLANKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(text: bytes | None) -> np.ndarray:
    """Distinct buckets of a text; bucket 0 is the constant."""
    w = word_hashes(text or b"", _BLANKS)
    with np.errstate(over="ignore"):
        grams = [w, pair(w[:-1], w[1:]) + U(1), pair(w[:-2], w[2:]) + U(2)]
    found = np.unique(np.concatenate(grams) % U(BUCKETS - 1)).astype(np.int64) + 1
    return np.concatenate(([0], found))


class Ftrl:
    """State of the optimiser; weights follow from it."""

    def __init__(self):
        self.z, self.n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, label: float) -> None:
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        root = np.sqrt(self.n[i])
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - root) / ALPHA * w
        self.n[i] += g * g


def _fitted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Weights learned from the sample, in the order of a hash of its ids."""
    rows = table.sort_by([("order", "ascending"), ("doc_id", "ascending")])
    made, labels = [features(t) for t in rows["text"].to_pylist()], rows["toxic"].to_pylist()
    model = Ftrl()
    for _ in range(EPOCHS):
        for i, y in zip(made, labels, strict=True):
            model.learn(i, y)
    w = model.weights()
    some = np.flatnonzero(w)
    return pa.Table.from_arrays([pa.array(some, pa.int64()), pa.array(w[some], pa.float64())], ["bucket", "w"])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights from the labelled rows that are not held out.

    Labels other than 0 and 1 are left out, and so are ids with contradicting labels. One task learns, as the
    method is sequential; its sample has about ``MAX_TRAIN_DOCS`` rows whatever the input.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    total = known.count()
    if not total:
        return np.zeros(1, np.int64), np.array([-1.0])
    share = min(1.0, MAX_TRAIN_DOCS / total)
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = known.where(order < int(share * (1 << 20)) + (share == 1.0))
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", F.xxhash64("doc_id", F.lit(8)).alias("order"), F.lit(1).alias("one"))
    rows = sample.groupBy("one").applyInArrow(_fitted, "bucket long, w double").toArrow()
    return rows["bucket"].to_numpy(), rows["w"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted of every row's whole text.

    Null and empty texts get the score of the constant alone. Repeated rows get equal scores; a null id is not
    held out. Extra columns are not read.
    """
    order = np.argsort(model[0])
    held = docs.sparkSession.sparkContext.broadcast((model[0][order], model[1][order]))

    def judge(batches):
        weights = np.zeros(BUCKETS)
        weights[held.value[0]] = held.value[1]
        for batch in slices(batches):
            s = np.array([weights[features(t)].sum() for t in batch["text"].to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(p, pa.float64()), pa.array(p >= THRESHOLD).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", is_held_out().alias("held_out"), F.col("text").cast("binary").alias("text")).mapInArrow(giving_back(judge), "doc_id long, held_out boolean, score double, predicted int")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))
