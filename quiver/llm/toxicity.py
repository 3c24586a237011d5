"""Toxicity scoring by FTRL-proximal logistic regression.

Features are the words, word pairs and one-skip pairs of a text, hashed to
``2**BITS`` coordinates, each counted once per text.  Training runs
follow-the-regularised-leader with per-coordinate rates over a bounded sample of
labelled rows; the L1 term leaves few non-zero weights, which go to the workers
as a sorted list of at most ``2**BITS`` coordinates.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm._common import extend, id_remainder, portions

BITS = 20
SIZE = 1 << BITS
_WORD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits; bytes beyond ASCII count as letters."""
    return (text or "").lower().encode("utf-8", "replace").translate(_WORD).split()


def batch_features(texts) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of every distinct feature of every text, sorted."""
    known: dict[bytes, int] = {}
    put, lids, sizes = known.setdefault, [], []
    for t in texts:
        words = words_of(t)
        sizes.append(len(words))
        lids.extend([put(w, len(known)) for w in words])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    h = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))[np.array(lids, np.int64)] if lids else np.zeros(0, np.uint32)
    first = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    parts = [(doc, first)]
    for gap, salt in ((1, 0x85EBCA6B), (2, 0xC2B2AE35)):
        both = (h[:-gap] * np.uint32(salt)) ^ ((h[gap:] + np.uint32(gap)) * np.uint32(0x27D4EB2F))
        both = ((both ^ (both >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        inside = doc[:-gap] == doc[gap:] if len(doc) > gap else np.zeros(0, bool)
        parts.append((doc[:-gap][inside] if len(doc) > gap else doc[:0], both[inside] if len(doc) > gap else both[:0]))
    return np.concatenate([d for d, _ in parts]), np.concatenate([f for _, f in parts]).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal; weights are derived from z and n on use."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n, self.bz, self.bn = np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        over = np.maximum(np.abs(z) - self.l1, 0.0)
        return -np.sign(z) * over / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    @property
    def bias(self) -> float:
        return -self.bz / ((self.beta + np.sqrt(self.bn)) / self.alpha)

    def step(self, at: np.ndarray, y: int) -> None:
        w, b = self.weights(at), self.bias
        g = sigmoid(w.sum() + b) - y
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g
        self.bz += g - (np.sqrt(self.bn + g * g) - np.sqrt(self.bn)) / self.alpha * b
        self.bn += g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = 5, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) from (distinct coordinates, label) rows;
    without rows nothing is taken for toxic."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), -35.0
    model, rng = Ftrl(), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            model.step(*rows[i])
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    return at, w[at].astype(np.float32), float(model.bias)


def score_texts(texts, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    dense = np.zeros(SIZE, np.float32)
    dense[model[0]] = model[1]
    return score_dense(texts, dense, model[2])


def score_dense(texts, dense: np.ndarray, bias: float) -> np.ndarray:
    doc, at = batch_features(texts)
    hit = dense[at] != 0
    pair = np.unique(doc[hit] << BITS | at[hit])
    return sigmoid(np.bincount(pair >> BITS, dense[pair & (SIZE - 1)], minlength=len(texts)) + bias)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12000, id_col: str = "doc_id", text: str = "text", label: str = "toxic"):
    """Model from at most ``max_rows`` labelled ids, the first by a hash; rows with a
    null id or label teach nothing, an id labelled twice counts as 1 if any label
    is 1, and of several documents of an id the text of the smallest hash teaches.
    Reruns pick the same rows, in the same order."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(marks), "id")  # at most max_rows ids
    rows = rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))

    def features(batches):
        import pyarrow as pa

        for batch in portions(batches, "text"):
            doc, at = batch_features(batch.column("text").to_pylist())
            pair = np.unique(doc << BITS | at)
            cut = np.searchsorted(pair >> BITS, np.arange(1, batch.num_rows))
            at = [x.astype(np.int32).tobytes() for x in np.split(pair & (SIZE - 1), cut)]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("y"), pa.array(at, pa.binary())], names=["id", "y", "at"])

    got = rows.mapInArrow(features, "id long, y int, at binary").toPandas().sort_values("id", kind="stable")
    return fit([(np.frombuffer(a, np.int32), int(y)) for a, y in zip(got["at"], got["y"])])


def predict(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of the
    whole text; null, empty and wordless texts get the score of the bias alone.
    Other columns, ties and repeated rows are kept as they are."""
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")])
    schema = docs.schema.add("score", "double").add("predicted", "integer")
    shared = spark.sparkContext.broadcast(model)  # at most 2**BITS coordinates

    def run(batches):
        import pyarrow as pa

        at, w, bias = shared.value
        dense = np.zeros(SIZE, np.float32)
        dense[at] = w
        for batch in portions(batches, "__text"):
            score = score_dense(batch.column("__text").to_pylist(), dense, bias)
            yield extend(batch, "__text", {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return docs.withColumn("__text", F.col(text)).mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, max_rows: int = 12000, mod: int = 5, rest: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out ids are not used."""
    model = train(docs, labels.where(id_remainder("doc_id", mod) != rest), max_rows)
    return predict(docs.select("doc_id", (id_remainder("doc_id", mod) == rest).alias("held_out"), F.col("text")), model).drop("text")
