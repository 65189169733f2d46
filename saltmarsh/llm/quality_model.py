"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are words and runs of other characters. One- and two-token grams are hashed into ``2 ** BITS`` places; a token followed
by itself is one gram whatever the token. A place's value is its count over the root of the number of grams.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import as_bytes, batch_column, free_name, share, shared
from saltmarsh.llm.samples import fit, fold, labelled_sample

BITS = 18
#: Labelled documents that the model is fitted on at most.
SAMPLE = 12_000
#: Learning rate, its smoothing, and the weights of both penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4

TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")


def grams(text: bytes | None) -> np.ndarray:
    """Places of all grams, repeats included; place 0 is the constant."""
    tokens = TOKEN.findall(text or b"")
    if not tokens:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    left, right = one[:-1], one[1:]
    two = np.where(left == right, np.uint64(1), left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = np.concatenate([one, two]) * np.uint64(0xD6E8FEB86659FD93)
    return 1 + (mixed >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Follow the regularised leader, one document after another."""

    def __init__(self):
        self.z = np.zeros(1 + (1 << BITS))
        self.n = np.zeros(1 + (1 << BITS))

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        kept = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -kept / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, text: bytes | None, label: int) -> None:
        places = grams(text)
        at, counts = np.unique(places, return_counts=True)
        at = np.append(at, 0)
        x = np.append(counts / np.sqrt(max(1, len(places))), 1.0)
        w = self.weights(at)
        g = (_probability(float(w @ x)) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _probability(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def score(weights: np.ndarray, text: bytes | None) -> float:
    """Sparse dot product of a text's grams with the weights, as a probability of label 1."""
    places = grams(text)
    return _probability(float(weights[0]) + float(weights[places].sum()) / np.sqrt(max(1, len(places))))


def train(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    sample: int = SAMPLE,
) -> np.ndarray:
    """Weights fitted on at most ``sample`` labelled documents outside the held-out fold. Without any, all are zero."""
    rows = labelled_sample(docs, labels, doc_id=doc_id, text=text, label=label, size=sample,
                           allowed=fold(doc_id, 3) != 1)

    def start():
        model = Ftrl()

        def take(batch):
            for value, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                model.learn(value, int(y > 0))

        return take, lambda: model.weights(slice(None)).astype(np.float32)

    found = fit(rows, start, "order", "text")
    return np.zeros(1 + (1 << BITS), np.float32) if found is None else found


def _worker(weights):
    def start():
        w = shared(weights)
        return lambda values: [[score(w, v) for v in values]]

    return start


def score_column(spark: SparkSession, weights: np.ndarray, text: str = "text"):
    """Struct column with the field ``score``."""
    return batch_column(spark, _worker(share(spark, weights)), {"score": pa.float64()})(as_bytes(text))


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    A null or empty text scores by the constant alone. A row without an id is not held out. Repeated rows score alike; an empty
    table gives an empty table, and without labels every score is one half.
    """
    weights = train(docs, labels, doc_id=doc_id, text=text)
    scored = docs.select(F.col(doc_id).alias("doc_id"), score_column(docs.sparkSession, weights, text).alias("made"))
    value = F.col("made.score")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
                         value.alias("score"), F.when(value >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that the classifier rejects, with the same columns."""
    weights = train(docs, labels, doc_id=doc_id, text=text)
    made = free_name(docs, "made")
    return docs.withColumn(made, score_column(docs.sparkSession, weights, text)).where(F.col(f"{made}.score") >= 0.5).drop(made)
