import base64
import builtins
import hashlib
import random
import re
import string
import sys

import numpy as np

from tessera.llm import secrets

SHA = "0f1e2d3c4b5a69788796a5b4c3d2e1f00112233a"
CASES = [
    f'token = "{SHA}" tail',
    "PassWord: 'abcdefgh1' and passwd=short",
    "secret: token: abcdefgh12",
    "key AKIAABCDEFGHIJKL123 AKIASHORT",
    "é api_key=abcd.efgh-12 x",
    "paſſword=abcdefgh12",
    "sha " + "ab12" * 12,
    "APIKEY\"=\"ABCDEFGHIJ token=token=12345678",
]


def plain_spans(text):
    out = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def planted(count, seed):
    """Keys that no base pattern covers, from sources of their own: digests in base 32 and 64,
    letters alone, prefixed keys, and short ones."""
    rng, out = random.Random(seed), []
    for k in range(count):
        digest = hashlib.sha256(f"{seed}-{k}".encode()).digest()
        forms = [base64.b64encode(digest[:24]).decode(), base64.b32encode(digest[:15]).decode(), "ghx_" + base64.urlsafe_b64encode(digest[:18]).decode(), "".join(rng.choices(string.ascii_letters, k=22)), "".join(rng.choices(string.ascii_letters + string.digits, k=16))]
        out.append(forms[k % len(forms)])
    return out


def ordinary():
    """Names of Python's own library: nothing that the models are trained on."""
    import argparse
    import unittest.mock

    return sorted({n for m in (builtins, argparse, unittest.mock, np, hashlib, string) for n in dir(m)} | set(sys.stdlib_module_names))


def test_base_spans_equal_plain_patterns():
    for text in CASES:
        assert secrets.base_spans(text) == plain_spans(text)


def test_query_against_plain_patterns(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = secrets.op4_markov_secrets(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        base = plain_spans(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",") if text else []) <= set(r.spans.split(","))


def test_chains_and_their_ratio_by_hand():
    samples = [("ab", False), ("aa", False), ("b", True)]
    model = secrets.MarkovRatio(samples)
    n, edge = len(secrets.ALPHABET) + 1, len(secrets.ALPHABET)
    a, b = 0, 1
    counts = np.ones((2, n, n))
    for text, secret in (([edge, a, b, edge], 0), ([edge, a, a, edge], 0), ([edge, b, edge], 1)):
        for x, y in zip(text, text[1:]):
            counts[secret, x, y] += 1
    p = counts / counts.sum(axis=2, keepdims=True)
    for token in (("b", [edge, b, edge]), ("ab", [edge, a, b, edge])):
        assert abs(model.ratio(token[0]) - sum(np.log(p[1, x, y] / p[0, x, y]) for x, y in zip(token[1], token[1][1:]))) < 1e-9


def test_model_tells_held_out_keys_from_names():
    model = secrets.MarkovRatio(secrets.built_in_samples())
    keys, names = [k for k in planted(1000, 3) if len(k) > 16], ordinary()
    assert np.mean([model.ratio(k) > model.threshold for k in keys]) > 0.97
    assert np.mean([model.ratio(n) > model.threshold for n in names]) < 0.02 and len(names) > 800


def test_tokens_of_many_texts_equal_those_of_each():
    model = secrets.MarkovRatio(secrets.built_in_samples())
    rng = random.Random(5)
    texts = [f"é {' '.join(rng.choices(planted(50, 9) + ordinary()[:200] + ['(a.b)', '--', ''], k=rng.randint(0, 12)))} 日" for _ in range(60)] + ["", "x"]
    for text, (base, added) in zip(texts, secrets.find_spans([t.encode() for t in texts], model)):
        want = set()
        for m in secrets.TOKEN.finditer(text):
            if model.ratio(m[0]) > model.threshold:
                inner = re.search("[A-Za-z0-9](.*[A-Za-z0-9])?", m[0])
                s, e = m.start() + inner.start(), m.start() + inner.end()
                e += len(re.match("={0,2}", text[e:])[0])
                if not any(s < y and x < e for x, _, y in base):
                    want.add((s, e))
        assert {(s, e) for s, _, e in added} == want


def with_keys(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    keys = planted(len(docs), 77)
    rows, at = [], {}
    for k, r in enumerate(docs):
        if k % 3 == 0 and not plain_spans(keys[k]):
            at[r.doc_id] = (len(r.text) + 5, len(r.text) + 5 + len(keys[k]))
            rows.append((r.doc_id, f"{r.text}\nuse {keys[k]} here"))
        else:
            rows.append((r.doc_id, r.text))
    return spark.createDataFrame(rows, "doc_id long, text string"), at, {r.doc_id: r.text for r in docs}


def test_planted_keys_that_no_base_pattern_covers(spark, sf_dir, monkeypatch):
    frame, at, texts = with_keys(spark, sf_dir)
    got = {r.doc_id: r for r in secrets.scan(frame).collect()}
    found = [f"random:{s}:{e}" in got[i].spans.split(",") for i, (s, e) in at.items()]
    assert len(found) > 50 and np.mean(found) > 0.9
    for r in got.values():
        base = plain_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
    # Clean documents are left alone, and without the chains nothing is found.
    assert np.mean([got[i].n_random == 0 for i in texts if i not in at]) > 0.98
    monkeypatch.setattr(secrets.MarkovRatio, "_step", lambda self, counts, size: np.zeros(size * size))
    assert secrets.scan(frame).where("n_random > 0").count() == 0


def test_redaction_and_edges(spark):
    rows = [(1, None, 0, "a"), (2, "", 0, "b"), (3, CASES[0], len(CASES[0]), "c"), (3, CASES[0], len(CASES[0]), "c"), (None, "word " * 30000 + CASES[3], 5, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {r.spans: r for r in secrets.redact(frame).collect()}
    assert got["c"].text == "<secret>\" tail" and got["c"].n_chars == len(got["c"].text)
    assert got["a"].text is None and got["b"].text == "" and got["d"].text.endswith("key <secret> AKIASHORT")
    found = secrets.scan(frame)
    assert found.count() == 5 and found.where("n_access = 1").count() == 1
    assert secrets.scan(frame.limit(0)).count() == 0
    assert secrets.redact(frame.limit(0)).count() == 0


def test_models_are_trained_on_all_tokens_of_all_documents(spark):
    rng = random.Random(8)
    rows = [(k if k % 7 else None, " ".join(["".join(rng.choices("abcdeXYZ019_", k=rng.randint(1, 9))) for _ in range(30)] + ["key value", CASES[k % len(CASES)]] + [""] * (k % 2))) for k in range(2600)]
    rows += [(9000, None), (9001, ""), (9002, " ".join(f"q{k}" for k in range(60_000))), (9003, 'secret="XYZ01abcde_1"')]
    made = secrets.built_in_samples()
    labels, times = {}, {}
    for _, text in rows:
        for token, secret in secrets.ordinary_and_secret(text or ""):
            labels[token] = labels.get(token, False) or secret
            times[token] = times.get(token, 0) + 1
    prior = (sum(n for t, n in times.items() if labels[t]) + 1) / (sum(times.values()) + 100_000)
    want = secrets.MarkovRatio(made + list(labels.items()), prior)
    got = secrets.trained(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), None, None)
    assert len(labels) > 60_000 and np.array_equal(got.step, want.step) and got.threshold == want.threshold
