import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lattice

PATH = "/opt/tokenizers/piece_bpe_32k.model"
PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "c", "bc", "é"]


def small_lattice():
    rng = np.random.default_rng(1)
    w = rng.random(256 + len(PIECES))
    return lattice.Lattice(PIECES, np.log(w / w.sum()))


def segmentations(model, text):
    """All segmentations as lists of (index or byte indices, weight), the plain way."""
    if not text:
        yield []
        return
    if text[0] not in PIECES:
        b = list(text[0].encode())
        for rest in segmentations(model, text[1:]):
            yield [(b, model.logp[b].sum()), *rest]
    for n in range(1, len(text) + 1):
        if text[:n] in PIECES:
            at = 256 + PIECES.index(text[:n])
            for rest in segmentations(model, text[n:]):
                yield [([at], model.logp[at]), *rest]


WORDS = ["a", "ab", "aba", "ababab", "xa", "é", "日b", "cbca", "bcbcbaab", "zz"]


@pytest.mark.parametrize("long", [64, 3])
def test_forward_and_expected_equal_enumeration(long):
    model = small_lattice()
    model.LONG = long
    want_uses = np.zeros(len(model.logp))
    for k, w in enumerate(WORDS):
        all_of = list(segmentations(model, "▁" + w))
        total = math.log(sum(math.exp(sum(x for _, x in s)) for s in all_of))
        assert model.forward([w])[0] == pytest.approx(total, abs=1e-10)
        for s in all_of:
            for ids, _ in s:
                np.add.at(want_uses, ids, (k + 1) * math.exp(sum(x for _, x in s) - total))
    assert np.allclose(model.expected(WORDS, np.arange(1, len(WORDS) + 1)), want_uses)
    assert np.allclose(model.forward(WORDS), [model.forward([w])[0] for w in WORDS])


def test_all_pieces_are_found():
    pieces, logp = lattice.vocabulary(PATH)
    model = lattice.Lattice(pieces, logp)
    own = np.array([model._hash(p) for p in pieces], np.uint64)
    assert model._find(own).tolist() == list(range(256, 256 + len(pieces)))
    assert np.exp(logp).sum() == pytest.approx(1)


def plain(docs, learn):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""] for i, t in docs}
    c = Counter(w for i, ws in words.items() if learn(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words.items()}


@pytest.mark.parametrize("broadcast_rows", [100_000, 300, 0])
def test_scores_of_the_query(spark, sf_dir, broadcast_rows):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80 if broadcast_rows < 1000 else 10**6)
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    learn = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    want = plain(docs, learn)
    pieces, logp, end = lattice.fit(lattice.word_counts(frame, ~(F.crc32(F.col("doc_id").cast("string")) % 7 == 2)), PATH)
    model = lattice.Lattice(pieces, logp)
    got = lattice.score_documents(frame, PATH, ~(F.crc32(F.col("doc_id").cast("string")) % 7 == 2), broadcast_rows).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, train, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, train, not learn(r.doc_id))
        assert r.base_score == pytest.approx(base, rel=1e-9)
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), dict(docs)[r.doc_id]))
        assert r.score == pytest.approx((model.forward(words).sum() + end) / math.log(10), rel=1e-9)


def test_fitting_raises_the_likelihood(spark, sf_dir):
    counts = lattice.word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.lit(True)).cache()
    words = [(r.token, r.c) for r in counts.collect() if r.token]
    c = np.array([n for _, n in words])
    likelihood = [float(lattice.Lattice(*lattice.fit(counts, PATH, steps=k)[:2]).forward([w for w, _ in words]) @ c) for k in (0, 1, 2)]
    assert likelihood[0] < likelihood[1] < likelihood[2]
    pieces, logp, end = lattice.fit(counts, PATH)
    assert np.exp(logp).sum() + math.exp(end) == pytest.approx(1)


def test_edges_of_input(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "One two　three", 3), (3, "One two　three", 3), (None, "x" * 5000, 4), (4, "🎉" * 70 + " \x00", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, token int")
    got = lattice.score_documents(frame, PATH, F.col("doc_id").isNotNull()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3)]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    none = lattice.score_documents(frame, PATH, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in none)
    assert lattice.score_documents(frame.limit(0), PATH, F.lit(True)).count() == 0
