import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import labelled, quality, toxicity

BIG = "/root/testdata/sf0.01"


def held_out_accuracy(spark, got, sf_dir, label, modulus, remainder):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in got.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == remainder) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    tested = [(labels[i], r) for i, r in rows.items() if i in labels and r.held_out]
    ones, zeros = [r.score for y, r in tested if y], [r.score for y, r in tested if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    return np.mean([y == r.predicted for y, r in tested]), auc


def test_toxicity_on_held_out_rows(spark):
    accuracy, auc = held_out_accuracy(spark, toxicity.op7_nb_char_linear(spark, BIG), BIG, "toxic", 5, 0)
    assert accuracy > 0.9 and auc > 0.95


def test_count_ratios_by_hand():
    rows = [(np.array([0, 1]), 1), (np.array([0]), 1), (np.array([1, 2]), 0), (np.array([0, 2]), 0), (np.array([3]), 0)]
    # Held by rows of class 1: 2, 1, 0; of class 0: 1, 1, 2; feature 3 is held once and not known.
    got = toxicity.count_ratios(rows, 4, least=2)
    want = [np.log((3 / 6) / (2 / 7)), np.log((2 / 6) / (2 / 7)), np.log((1 / 6) / (3 / 7)), 0.0]
    assert got == pytest.approx(want)


def test_curve_of_scores():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 3, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.7 * z - 1.2)))).astype(float)
    assert toxicity.calibrated(z, y)[:2] == pytest.approx((0.7, -1.2), abs=0.06)


def test_scores_equal_a_plain_version(spark):
    rng = np.random.default_rng(4)
    bad, good = ["vile", "filthy", "hateful"], ["river", "garden", "music", "paper", "stone"]
    texts = [" ".join(rng.choice(good + (bad if k % 3 == 0 else []), size=9)) + (" vile hateful" if k % 3 == 0 else "") for k in range(240)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, F.lit(False), orders=(2, 3), bits=16).collect()}
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id")).collect()]

    def plain(text):
        codes = [ord(c) for c in " " + " ".join(text.lower().split()) + " "]
        out = set()
        for n in (2, 3):
            for i in range(len(codes) - n + 1):
                h = 0
                for j, c in enumerate(codes[i : i + n]):
                    h = ((h + (j == 0)) * 0x100000001B3 + c) % 2**64
                out.add((h * 0x9E3779B97F4A7C15 % 2**64) >> 48)
        return np.array(sorted(out))

    weight, bias = toxicity.train([(plain(texts[k]), int(k % 3 == 0)) for k in order], 1 << 16, np.log(67.5 / 133.5))
    for k, text in [*enumerate(texts), (500, "")]:
        at = [i for i in plain(text) if weight[i] != 0]
        z = bias + sum(weight[i] for i in at) / max(1.0, len(at) ** 0.5)
        assert got[k].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    assert np.mean([got[k].predicted == (k % 3 == 0) for k in range(200, 240)]) > 0.95


def test_sample_keeps_to_its_bound_in_the_order_of_hashes(spark):
    frame = spark.createDataFrame([(k, k % 2, 50 if k == 7 else 1 + k % 3, bytes([k])) for k in range(60)], "doc_id long, y int, size long, data binary").repartition(5, "doc_id")
    got = labelled.within(frame, 40)
    order = [r.doc_id for r in frame.orderBy(F.xxhash64("doc_id")).select("doc_id").collect()]
    left, want = {0: 20, 1: 20}, []
    for k in order:
        size = 50 if k == 7 else 1 + k % 3
        if size <= left[k % 2]:
            left[k % 2] -= size
            want.append(k)
    assert [r.doc_id for r in got] == want and [bytes(r.data) for r in got] == [bytes([k]) for k in want]
    assert len(labelled.within(frame, 10**6)) == 60 and labelled.within(frame.limit(0), 5) == []


def test_quality_on_held_out_rows(spark):
    accuracy, auc = held_out_accuracy(spark, quality.op9_attention_bags(spark, BIG), BIG, "quality", 3, 1)
    assert accuracy > 0.9 and auc > 0.93


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    model, x, starts, y = quality.GatedAttention(), rng.normal(size=(9, quality.FEATURES)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])
    _, g = model.gradient(x, starts, y)
    for k, p in model.p.items():
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(4)]:
            held = p[at]
            p[at] = held + 1e-6
            up, _ = model.gradient(x, starts, y)
            p[at] = held - 1e-6
            down, _ = model.gradient(x, starts, y)
            p[at] = held
            assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(2)
    bags, y = [], []
    for k in range(900):
        bag = rng.normal(size=(int(rng.integers(2, 9)), quality.FEATURES))
        if k % 2:
            bag[int(rng.integers(len(bag))), :3] += 6
        bags.append(bag)
        y.append(k % 2)
    model = quality.GatedAttention()
    model.fit(bags[:700], np.array(y[:700], float))
    assert np.mean((model.logits(bags[700:]) > 0) == np.array(y[700:])) > 0.9


def test_passages_and_grams_of_odd_texts():
    for text in (b"", b" \n", "é 日本 a".encode(), b"x" * 5000, b"a b " * 3000):
        assert np.isfinite(quality.passages(text)).all() and quality.passages(text).shape[1] == quality.FEATURES
        assert len(toxicity.Grams((3, 4), 10).of(text)) >= 0
    assert len(quality.passages(b"w " * 250)) == 3
    grams = toxicity.Grams((1, 2), 16)
    assert grams.of(b"AB").tolist() == grams.of(b"ab\n").tolist() and len(grams.of(b"ab")) == 6


@pytest.mark.parametrize("score, label", [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_edges_of_input(spark, score, label):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "good words", "y"), (3, "good words", "y"), (None, "more", "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(9, 1), (2, None), (None, 0)], f"doc_id long, {label} int")
    some = spark.createDataFrame([(2, 1), (2, 0), (3, 0), (9, 1)], f"doc_id long, {label} int")
    for labels in (none, none.limit(0), some):
        got = score(docs, labels, F.lit(False)).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert score(docs.limit(0), some, F.lit(False)).count() == 0
