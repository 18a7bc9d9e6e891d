import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.components import connected_components, forest


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


TEXTS = ["", None, "one", "One  two", "a b c d", "a b c d e", "ÉCOLE É \x1f x y z", "w " * 900, " ".join(f"w{i % 37}" for i in range(700)), "A\tB\nC\x0bD\x0cE\rF"]


def test_fingerprints_equal_plain_ones():
    got = simhash.fingerprints([(t or "").encode() for t in TEXTS])
    assert got.tolist() == [plain_fingerprint(t) for t in TEXTS]


def test_shingle_hash_is_the_engines_own(spark):
    for s in ("", "abc", "été naïve x y", "q" * 45):
        assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(s.encode(), 42)


@pytest.mark.parametrize("block_rows", [250_000, 40])
def test_near_links_find_all_pairs(spark, block_rows):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 120, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(1, 7)), replace=False)) for b in base for _ in range(3)]
    fps = sorted({int(x) for x in base} | set(near) | {0, -1, 1})
    u = np.array(fps, np.int64).view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4)
    want = plain_components(fps, [(fps[a], fps[b]) for a, b in zip(i, j) if a < b])
    links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), block_rows=block_rows).collect()
    assert all((int(r.a) ^ int(r.b)) & (2**64 - 1) and bin((r.a ^ r.b) & (2**64 - 1)).count("1") >= 1 for r in links)
    got = plain_components(fps, [(r.a, r.b) for r in links])
    assert got == want


def test_forest_and_components(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 300, 260), rng.integers(0, 300, 260)
    chain = [(1000 + k, 1001 + k) for k in range(70)]
    edges = [*zip(a.tolist(), b.tolist()), *chain, (5000, 5000), (None, 3)]
    ids = {x for e in edges for x in e if x is not None}
    want = plain_components(ids, [e for e in edges if None not in e])
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert all(got.get(i, i) == want[i] for i in ids)
    x, y = forest(a, b)
    assert all(want[int(p)] == int(q) for p, q in zip(x, y) if int(q) < 1000)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    ids = sorted(fp)
    u = np.array([fp[i] for i in ids], np.uint64)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4)
    want = plain_components(ids, [(ids[a], ids[b]) for a, b in zip(i, j) if a < b])
    got = simhash.op8_simhash_vantage(spark, sf_dir).collect()
    assert len(got) == len(ids)
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in fp.items()}
    assert {r.doc_id: r.component_id for r in got} == want


def test_edges_of_input(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "same text here today", "y"), (3, "same text here today", "y"), (None, "same text here today", "z")]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
