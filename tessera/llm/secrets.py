"""Secret scans: fixed patterns, and character Markov models of random strings and of
ordinary identifiers, whose log-likelihood ratio tells a key from a word.

Both models are trained from labelled tokens (text, is it a secret?): values that the fixed
patterns find in any document are secrets, all other tokens of all documents are ordinary,
and samples by rule, of usual key alphabets and of identifiers, join them. Every token of every text is scored, whatever its length or characters: its ratio is
summed over its characters, so a longer token gives more evidence. It is reported when the
ratio outweighs the odds of an ordinary token, as counted in all documents, and no base span
overlaps it.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import as_bytes, small_batches, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 at least is a run that passes the length test
KINDS = ("assign", "access", "hex", "random")
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_-"
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+")
Samples = list[tuple[str, bool]]


def built_in_samples(each: int = 4000, seed: int = 11) -> Samples:
    """Labelled samples by rule: random keys in usual alphabets, and identifiers of
    ordinary words in usual styles, dates, versions and serial numbers."""
    rng = random.Random(seed)
    words = "get set user name file path index list value count data time date page size type node tree graph table column row key map item order total price state error message request response client server session buffer stream reader writer parser token filter query result report version release build test sample model layer weight train score batch cache queue worker thread process handler manager factory service config option default public private static import export module package system network address socket channel event listener update delete insert select create remove append merge split join group sort search match replace format string number integer float double boolean object array".split()
    letters, digits = string.ascii_letters, string.digits
    alphabets = [digits + "abcdef", letters + digits, letters + digits + "+/", string.ascii_lowercase + digits, string.ascii_uppercase + digits, letters + digits + "-_", letters]
    out = [("".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(12, 64))), True) for k in range(each)]
    for k in range(each):
        some = rng.choices(words, k=rng.randint(1, 6))
        style = k % 6
        text = ["_".join(some), some[0] + "".join(map(str.title, some[1:])), "-".join(some), "/".join(some), "".join(some), "".join(map(str.title, some))][style]
        if k % 3 == 0:
            text += rng.choice(["", "_", "-v"]) + str(rng.randint(0, rng.choice([9, 99, 2026, 99999999])))
        if k % 11 == 0:
            text = rng.choice([f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", "".join(rng.choices(digits, k=rng.randint(1, 20))), "-".join("".join(rng.choices(digits, k=rng.randint(2, 5))) for _ in range(rng.randint(2, 4)))])
        out.append((text.upper() if k % 17 == 0 else text, False))
    return out


class MarkovRatio:
    """Two first-order character chains with add-one smoothing, from and to the token's ends too.

    Summed over a token, `step` is the log-likelihood ratio of the random chain to the
    ordinary one. A token passes if it is then likelier a secret than not, where `prior` of
    all tokens are secrets. No quantile of the ordinary samples' ratios is asked for: some
    of them are secrets that no fixed pattern knew, and would hide their like.
    """

    def __init__(self, samples: Iterable[tuple[str, bool]], prior: float = 1e-5, more: np.ndarray | None = None):
        """more: transitions() of further ordinary and further secret tokens."""
        self.edge, self.threshold = len(ALPHABET), float(np.log((1 - prior) / prior))
        self.code = np.full(256, self.edge, np.int32)
        self.code[[ord(c) for c in ALPHABET]] = np.arange(self.edge)
        size = self.edge + 1
        counts = np.zeros((2, size * size))
        for text, secret in set(samples):
            np.add.at(counts[int(secret)], self._path(np.frombuffer(text.encode("ascii", "replace"), np.uint8)), 1)
        if more is not None:
            counts += more
        self.step = self._step(counts, size)

    def _path(self, raw: np.ndarray) -> np.ndarray:
        """Each transition between neighbouring bytes, with an edge before and after, as a number."""
        at = np.concatenate([[self.edge], self.code[raw], [self.edge]])
        return at[:-1] * (self.edge + 1) + at[1:]

    def transitions(self, tokens: list[str]) -> np.ndarray:
        """How often each transition comes in all tokens, which are not empty."""
        if not tokens:
            return np.zeros((self.edge + 1) ** 2, np.int64)
        return np.bincount(self._path(np.frombuffer("\n".join(tokens).encode("ascii"), np.uint8)), minlength=(self.edge + 1) ** 2)

    def _step(self, counts: np.ndarray, size: int) -> np.ndarray:
        """log p(next | last) of the random chain less that of the ordinary one; 0 between tokens."""
        table = counts.reshape(2, size, size) + 1
        log = np.log(table / table.sum(axis=2, keepdims=True))
        out = log[1] - log[0]
        out[self.edge, self.edge] = 0.0
        return out.ravel()

    def ratio(self, token: str) -> float:
        """The log-likelihood ratio of one token."""
        return float(self.step[self._path(np.frombuffer(token.encode("ascii", "replace"), np.uint8))].sum())

    def random_tokens(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """(start, end) in bytes of each text's tokens whose ratio passes the threshold."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        path = self._path(np.frombuffer(b"\n".join(texts), np.uint8))
        sums = np.concatenate([[0.0], np.cumsum(self.step[path])])
        before, after = path // (self.edge + 1) == self.edge, path % (self.edge + 1) == self.edge
        # Transition k leads to byte k: a token begins where one leaves the edge, and ends where one comes to it.
        starts, ends = np.flatnonzero(before & ~after), np.flatnonzero(~before & after)
        found = sums[ends + 1] - sums[starts] > self.threshold
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        for s, e in zip(starts[found].tolist(), ends[found].tolist()):
            k = int(np.searchsorted(begins, s, "right")) - 1
            out[k].append((s - int(begins[k]), e - int(begins[k])))
        return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points; leftmost and non-overlapping per kind."""
    low = text.lower()
    out = []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_spans(texts: list[bytes], model: MarkovRatio) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans of each text, and the spans that the models add, in code points.

    An added span leaves out what isn't a letter or digit at a token's ends, and takes in up
    to two '=' behind it.
    """
    for raw, tokens in zip(texts, model.random_tokens(texts)):
        text, added = raw.decode(), []
        base = base_spans(text)
        for s, e in tokens:
            shift = 0 if len(text) == len(raw) else len(raw[:s].decode()) - s
            s, e = s + shift, e + shift
            while s < e and not text[s].isalnum():
                s += 1
            while e > s and not text[e - 1].isalnum():
                e -= 1
            e += len(re.match("={0,2}", text[e : e + 2])[0])
            if e > s and not any(a < e and s < b for a, _, b in base):
                added.append((s, 3, e))
        yield base, added


def ordinary_and_secret(text: str) -> Iterator[tuple[str, bool]]:
    """Labelled tokens of a text: the values of base spans, and every token outside of them."""
    spans = base_spans(text)
    for s, kind, e in spans:
        value = ASSIGN.match(text, s)[2] if kind == 0 else text[s:e]
        yield from ((t, True) for t in TOKEN.findall(value) if len(t) >= 8)
    at = 0
    for s, _, e in [*spans, (len(text), 0, len(text))]:
        yield from ((t, False) for t in TOKEN.findall(text[at:s]))
        at = max(at, e)


def labelled_counts(documents: DataFrame, samples: Samples) -> tuple[np.ndarray, float]:
    """MarkovRatio.transitions() of the distinct labelled tokens of all documents, ordinary and
    secret ones, without those in `samples`; and the share of secrets among all tokens.

    A token that is a secret anywhere is one everywhere. Only tokens shuffle, each with its
    number in a batch, and only sums come to the driver: no more of them than transitions.
    """
    blank, made = MarkovRatio(()), set(samples)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2_000_000, 10_000):
            found = Counter(x for text in batch.column("text").to_pylist() if text for x in ordinary_and_secret(text))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.bool_()), pa.array(found.values(), pa.int64())], names=["token", "secret", "times"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, times = np.zeros((2, (blank.edge + 1) ** 2), np.int64), np.zeros(2, np.int64)
        for batch in small_batches(batches, "token", 2_000_000, 10_000):
            labelled = list(zip(batch.column("token").to_pylist(), batch.column("secret").to_pylist()))
            np.add.at(times, [int(s) for _, s in labelled], batch.column("times").to_numpy())
            for label in (False, True):
                counts[int(label)] += blank.transitions([t for t, s in labelled if s == label and (t, s) not in made])
        label, at = np.nonzero(counts)
        # A label's number of tokens stands beside its transitions, at -1.
        columns = np.concatenate([label, [0, 1]]), np.concatenate([at, [-1, -1]]), np.concatenate([counts[label, at], times])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["label", "at", "n"])

    found = documents.select("text").mapInArrow(tokens, "token string, secret boolean, times long").groupBy("token").agg(F.max("secret").alias("secret"), F.sum("times").alias("times"))
    counts, times = np.zeros((2, (blank.edge + 1) ** 2)), [0, 0]
    for r in found.mapInArrow(sums, "label long, at long, n long").groupBy("label", "at").agg(F.sum("n").alias("n")).collect():
        if r["at"] < 0:
            times[r.label] = r.n
        else:
            counts[r.label, r["at"]] = r.n
    return counts, (times[1] + 1) / (sum(times) + 100_000)


def trained(documents: DataFrame, samples: Samples | None, prior: float | None) -> MarkovRatio:
    """The models of the given samples, or of built_in_samples() and labelled_counts() of all documents."""
    more = None
    if samples is None:
        samples = built_in_samples()
        more, found = labelled_counts(documents, samples)
        prior = found if prior is None else prior
    return MarkovRatio(samples, 1e-5 if prior is None else prior, more)


def scan(documents: DataFrame, samples: Samples | None = None, prior: float | None = None) -> DataFrame:
    """The rows of `documents` (doc_id, text) with n_assign, n_access, n_hex, base_sha256,
    spans, and n_random of the spans that the models added.

    Without `samples` the models are trained by labelled_counts() of all documents. Null and
    empty texts have no spans. Texts of any length are scanned whole; repeated rows and null
    ids stay; other columns are ignored. A row needs nothing of other rows but the models:
    texts don't shuffle, and are read once more for the models.
    """
    model = trained(documents, samples, prior)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1_000_000):
            rows = []
            for doc_id, (base, added) in zip(batch.column("doc_id").to_pylist(), find_spans(as_bytes(batch.column("text")), model)):
                kinds = [k for _, k, _ in base]
                rows.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(documents: DataFrame, samples: Samples | None = None, prior: float | None = None, mark: str = "<secret>") -> DataFrame:
    """`documents` with every found secret replaced by `mark`, and n_chars, if there, set anew.

    Without `samples` the models are trained as in scan(). Overlapping spans are replaced
    once. All rows and columns stay; null texts stay null.
    """
    model = trained(documents, samples, prior)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1_000_000):
            out = batch.column("text").to_pylist()
            for k, (base, added) in enumerate(find_spans(as_bytes(batch.column("text")), model)):
                parts, at = [], 0
                for s, _, e in sorted(base + added):
                    if s >= at:
                        parts += [out[k][at:s], mark]
                    at = max(at, e)
                if parts:
                    out[k] = "".join(parts) + out[k][at:]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array(out, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in out], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return documents.mapInArrow(run, documents.schema)


def op4_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    return scan(table(spark, sf_dir, "documents"))
