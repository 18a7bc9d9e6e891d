"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive
Bayes log-count ratios, trained on labelled text.

A document's features are the distinct hashed n-grams of its whole text. The ratios and
the weights are fitted on a bounded sample of labelled rows; scoring is one pass over the
documents without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.labelled import class_sample, within
from tessera.llm.shared import as_bytes, held_out, small_batches, table

PRIME, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Distinct hashed n-grams of a text; one object serves many texts."""

    def __init__(self, orders: tuple[int, ...], bits: int):
        self.orders, self.bits = orders, bits
        self.seen = np.zeros(1 << bits, bool)

    def of(self, text: bytes) -> np.ndarray:
        """Sorted buckets. Lower-cased, with runs of white space as one space at either end too."""
        words = text.decode("utf-8", "replace").lower().split()
        codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
        h, found = np.zeros(len(codes), np.uint64), [np.zeros(0, np.uint32)]
        for n in range(1, max(self.orders) + 1):
            if len(codes) < n:
                break
            h = (h[: len(codes) - n + 1] + np.uint64(n == 1)) * PRIME + codes[n - 1 :]
            if n in self.orders:
                found.append(((h * MIX) >> np.uint64(64 - self.bits)).astype(np.uint32))
        if 16 * len(codes) < len(self.seen):  # a short text is sorted, a long one marks its buckets
            out = np.sort(np.concatenate(found))
            return out[np.concatenate([np.ones(min(1, len(out)), bool), out[1:] != out[:-1]])]
        for at in found:
            self.seen[at] = True
        out = np.flatnonzero(self.seen)
        self.seen[out] = False
        return out


def count_ratios(rows: list[tuple[np.ndarray, int]], size: int, least: int = 3) -> np.ndarray:
    """The naive Bayes log-count ratio of each feature: the log of its share of all features
    held by rows of class 1 over that of class 0, counts add-one smoothed. Features held by
    fewer than `least` rows have 0."""
    counts = np.zeros((2, size))
    for at, y in rows:
        counts[y][at] += 1
    known = counts.sum(axis=0) >= least
    smooth = np.where(known, counts + 1, 0.0)
    share = smooth / np.maximum(smooth.sum(axis=1, keepdims=True), 1.0)
    return np.log(share[1], where=known, out=np.zeros(size)) - np.log(share[0], where=known, out=np.zeros(size))


def logit(at: np.ndarray, weight: np.ndarray, bias: float) -> float:
    """The linear score of a row's known features, scaled by the root of their number."""
    return bias + float(weight[at].sum(dtype=np.float64)) / max(1.0, math.sqrt(len(at)))


def fit_linear(rows: list[tuple[np.ndarray, int]], ratio: np.ndarray, decay: float, epochs: int = 6, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights of the features, ratios included, and the intercept: a logistic model over
    features scaled by their ratios, by adaptive gradient steps over the rows in turn."""
    weight, square, bias, bias_square = np.zeros(len(ratio)), np.full(len(ratio), 1e-2), 0.0, 1e-2
    for _ in range(epochs):
        for at, y in rows:
            norm, x = max(1.0, math.sqrt(len(at))), ratio[at]
            z = bias + float(weight[at] @ x) / norm
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            step = g * x / norm + decay * weight[at]
            square[at] += step * step
            weight[at] -= rate * step / np.sqrt(square[at])
            bias_square += g * g
            bias -= rate * g / math.sqrt(bias_square)
    return weight * ratio, bias


def calibrated(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float, float]:
    """(slope, shift, loss) of the logistic curve that fits (z, y) best, by damped Newton steps."""

    def loss(v: np.ndarray) -> float:
        t = v[0] * z + v[1]
        return float(np.mean(np.logaddexp(0, t) - y * t)) + 1e-6 * float(v @ v)

    v = np.array([1 / max(1e-9, float(z.std())), 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(v[0] * z + v[1], -30, 30)))
        g = np.array([np.mean((p - y) * z), np.mean(p - y)]) + 2e-6 * v
        w = p * (1 - p)
        move = np.linalg.solve(np.array([[np.mean(w * z * z), np.mean(w * z)], [np.mean(w * z), np.mean(w)]]) + 1e-6 * np.eye(2), g)
        while loss(v - move) > loss(v) and np.abs(move).max() > 1e-9:
            move /= 2
        v = v - move
    return float(v[0]), float(v[1]), loss(v)


def train(rows: list[tuple[np.ndarray, int]], size: int, odds: float, decays: tuple[float, ...] = (1e-4, 1e-3)) -> tuple[np.ndarray, float]:
    """Weights, 0 for what isn't known, and the intercept.

    Every fourth row is set aside to choose the decay and to fit the curve from scores to
    probabilities; with these the model is fitted once more on all rows. The curve is moved
    from the classes' odds among the rows to `odds`, the log odds of class 1 among all
    labels. Without rows of both classes on either side the weights are 0.
    """
    fitted, aside = [r for k, r in enumerate(rows) if k % 4], rows[::4]
    if any({y for _, y in part} != {0, 1} for part in (fitted, aside)):
        return np.zeros(size), odds
    y, best = np.array([y for _, y in aside], np.float64), None
    ratio = count_ratios(fitted, size)
    own = [(at[ratio[at] != 0], y) for at, y in fitted]
    for decay in decays:
        weight, bias = fit_linear(own, ratio, decay)
        found = calibrated(np.array([logit(at[ratio[at] != 0], weight, bias) for at, _ in aside]), y)
        if best is None or found[2] < best[0]:
            best = (found[2], decay, *found[:2])
    _, decay, slope, shift = best
    ratio = count_ratios(rows, size)
    weight, bias = fit_linear([(at[ratio[at] != 0], y) for at, y in rows], ratio, decay)
    return slope * weight, slope * bias + shift - math.log(y.sum() / (len(y) - y.sum())) + odds


def fit(documents: DataFrame, labels: DataFrame, usable: Column, orders: tuple[int, ...], bits: int, per_class: int, most_features: int) -> tuple[np.ndarray, float]:
    """Fits on at most `per_class` rows of each class and `most_features` n-grams in all."""
    sample, odds = class_sample(documents, labels, "toxic", usable, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(orders, bits)
        for batch in small_batches(batches, "text", 1_000_000):
            found = [grams.of(t).astype(np.uint32) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "y", "size", "data"])

    rows = within(sample.mapInArrow(run, "doc_id long, y int, size long, data binary"), most_features)
    return train([(np.frombuffer(bytes(r.data), np.uint32), r.y) for r in rows], 1 << bits, odds)


def score_toxicity(documents: DataFrame, labels: DataFrame, test: Column, orders: tuple[int, ...] = (4, 5, 6), bits: int = 20, per_class: int = 3000, most_features: int = 24_000_000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `documents`.

    Fitted on labels (doc_id, toxic) of rows that aren't `test`; scores are probabilities at
    the odds of all those labels. Null texts count as empty, whose score is that of a text
    of one space. Repeated rows and null ids stay; labels of
    no document, null labels and other columns are ignored; without labels of both classes
    all scores are a half.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", test.alias("held_out"))
    weight, bias = fit(documents, labels, ~test, orders, bits, per_class, most_features)
    model = spark.sparkContext.broadcast((weight.astype(np.float32), bias))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, (w, b) = Grams(orders, bits), model.value
        own = w != 0
        for batch in small_batches(batches, "text"):
            z = []
            for text in as_bytes(batch.column("text")):
                at = grams.of(text)
                z.append(logit(at[own[at]], w, b))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=schema)

    return documents.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op7_nb_char_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels of ids whose crc32 is a multiple of 5 aren't learnt from."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(F.col("doc_id"), 5, 0))
