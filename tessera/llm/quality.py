"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Each is encoded, from counts over its characters and
words, by a small network; gated attention weighs the passages, the weighted sum is the
document's representation, and a logistic output scores it. Only document labels are
needed. The network is fitted on a bounded sample; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.labelled import class_sample, within
from tessera.llm.shared import as_bytes, held_out, small_batches, table

WORDS, BUCKETS = 100, 48
_KIND = np.full(256, 7, np.int64)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1], _KIND[128:] = 0, 1, 2, 3
_KIND[[ord(c) for c in ".,;:?'\"-()"]], _KIND[[9, 10, 11, 12, 13, 32]], _KIND[ord("!")] = 4, 5, 6
FEATURES = 8 + 8 + BUCKETS


def passages(text: bytes) -> np.ndarray:
    """A row of features for each run of WORDS words; an empty text has one row of zeros."""
    words = text.split()
    if not words:
        return np.zeros((1, FEATURES))
    count = -(-len(words) // WORDS)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    of_word = np.arange(len(words)) // WORDS
    raw = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
    of_byte = np.repeat(of_word, lengths + 1)
    size = np.bincount(of_byte, minlength=count)[:, None]
    kinds = np.bincount(of_byte * 8 + _KIND[raw], minlength=8 * count).reshape(count, 8) / size
    pairs = (raw[:-1] * 31 + raw[1:] * 7) % BUCKETS
    bigrams = np.sqrt(np.bincount(of_byte[:-1] * BUCKETS + pairs, minlength=BUCKETS * count).reshape(count, BUCKETS) / size)
    each = np.bincount(of_word, minlength=count)
    other = np.zeros((count, 8))
    other[:, 0] = np.log1p(each)
    other[:, 1] = np.bincount(of_word, lengths, minlength=count) / each / 10
    other[:, 2] = np.bincount(of_word, np.minimum(lengths, 40) ** 2, minlength=count) / each / 100
    for k in range(count):
        own = words[k * WORDS : (k + 1) * WORDS]
        other[k, 3] = len(set(own)) / len(own)
        other[k, 4] = sum(a == b for a, b in zip(own, own[1:])) / len(own)
        other[k, 5] = sum(map(bytes.isupper, own)) / len(own)
        other[k, 6] = sum(map(bytes.isalpha, own)) / len(own)
        other[k, 7] = sum(len(w) == 1 for w in own) / len(own)
    return np.hstack([kinds, other, bigrams])


class GatedAttention:
    """The network. Bags are given as the rows of all passages and where each bag begins."""

    SHAPES = {"w1": (FEATURES, 24), "b1": (24,), "v": (24, 12), "u": (24, 12), "w": (12,), "c": (24,), "d": (1,)}

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("b1", "d") else np.zeros(s) for k, s in self.SHAPES.items()}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of the bags, and what the backward pass needs. x is standardised."""
        p = self.p
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        h = np.tanh(x @ p["w1"] + p["b1"])
        a, b = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
        s = (a * b) @ p["w"]
        e = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        weight = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return z @ p["c"] + p["d"][0], {"bag": bag, "h": h, "a": a, "b": b, "weight": weight, "z": z, "x": x, "starts": starts}

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and its gradient."""
        p = self.p
        logit, k = self.forward(x, starts)
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        out = (prob - y) / len(y)
        dz = out[:, None] * p["c"]
        dh = k["weight"][:, None] * dz[k["bag"]]
        dweight = (k["h"] * dz[k["bag"]]).sum(axis=1)
        ds = k["weight"] * (dweight - np.add.reduceat(k["weight"] * dweight, starts)[k["bag"]])
        gate = k["a"] * k["b"]
        da, db = ds[:, None] * p["w"] * k["b"] * (1 - k["a"] ** 2), ds[:, None] * p["w"] * k["a"] * k["b"] * (1 - k["b"])
        dh += da @ p["v"].T + db @ p["u"].T
        dx = dh * (1 - k["h"] ** 2)
        return loss, {"w1": x.T @ dx, "b1": dx.sum(axis=0), "v": k["h"].T @ da, "u": k["h"].T @ db, "w": gate.T @ ds, "c": k["z"].T @ out, "d": np.array([out.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 9) -> None:
        """Adam over shuffled batches of bags, with a falling rate."""
        every = np.vstack(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        bags = [np.clip((b - self.mean) / self.scale, -6, 6) for b in bags]
        rng, m, v, t = np.random.default_rng(seed), {k: 0 * x for k, x in self.p.items()}, {k: 0 * x for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                sizes = [len(bags[i]) for i in own]
                _, g = self.gradient(np.vstack([bags[i] for i in own]), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int), y[own])
                t += 1
                for k in self.p:
                    step = g[k] + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * step, 0.999 * v[k] + 0.001 * step**2
                    self.p[k] = self.p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def logits(self, bags: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(b) for b in bags])
        x = np.clip((np.vstack(bags) - self.mean) / self.scale, -6, 6)
        return self.forward(x, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int))[0]


def fit(documents: DataFrame, labels: DataFrame, usable: Column, per_class: int, most_passages: int) -> tuple[GatedAttention, float]:
    """The network and the shift of its logits from the sample's class odds to all labels'."""
    sample, odds = class_sample(documents, labels, "quality", usable, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1_000_000):
            found = [passages(t).astype(np.float32) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "y", "size", "data"])

    rows = within(sample.mapInArrow(run, "doc_id long, y int, size long, data binary"), most_passages)
    rows = [(np.frombuffer(bytes(r.data), np.float32).reshape(-1, FEATURES), r.y) for r in rows]
    model, y = GatedAttention(), np.array([y for _, y in rows], np.float64)
    if not len(y) or not 0 < y.sum() < len(y):
        model.p = {k: 0 * x for k, x in model.p.items()}
        return model, odds
    model.fit([b for b, _ in rows], y)
    return model, odds - float(np.log(y.sum() / (len(y) - y.sum())))


def score_quality(documents: DataFrame, labels: DataFrame, test: Column, per_class: int = 2500, most_passages: int = 120_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `documents`, and the columns `carry`.

    Fitted on labels (doc_id, quality) of rows that aren't `test`, at most `per_class` of each
    class and `most_passages` passages in all. A null or empty text is one empty passage.
    Repeated rows and null ids stay; labels of no document, null labels and other columns
    are ignored; without labels of both classes all scores are the prior's.
    """
    spark = documents.sparkSession
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", test.alias("held_out"))
    model, shift = fit(base, labels, ~test, per_class, most_passages)
    spread = spark.sparkContext.broadcast((model.p, model.mean, model.scale, shift))
    scored = documents.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), test.alias("held_out"), *carry).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = GatedAttention()
        own.p, own.mean, own.scale, more = spread.value
        for batch in small_batches(batches, "text", 2_000_000, 500):
            z = own.logits([passages(t) for t in as_bytes(batch.column("text"))]) + more
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    kind = scored.schema["row"].dataType.simpleString()
    return scored.mapInArrow(run, f"row {kind}, score double, predicted int").select("row.doc_id", "row.held_out", "score", "predicted", *[f"row.{c}" for c in carry])


def op9_attention_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; labels of ids whose crc32 leaves 1 by 3 aren't learnt from."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(F.col("doc_id"), 3, 1))
