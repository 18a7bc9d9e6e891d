"""LM scoring by a subword lattice: every segmentation of a word into vocabulary pieces
counts, weighted by unigram piece probabilities; a log-space forward recursion gives the
marginal probability. Segmentations don't cross words, so a document's probability is the
product of its words' and the end's.

Pieces and their first weights come from an existing vocabulary file. The public file is a
byte-pair model, whose scores are minus the merge's rank: they order the pieces and are no
probabilities, so a piece's first weight is 1 / (2 + rank), and one pass of expected counts
over all training words re-estimates it. A file with unigram scores isn't among the public ones. Word counts cover the whole corpus and
live in a table: the words that are frequent enough for a broadcast of bounded size are
scored where the text is read, all others by a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import as_bytes, held_out, keep, small_batches, table

MARK = "▁"
BYTES = 256
PRIME, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Lattice:
    """Unigram pieces with log probabilities. The first 256 indices are bytes, which spell
    characters that the vocabulary lacks."""

    LONG = 64

    def __init__(self, pieces: list[str], logp: np.ndarray):
        """pieces: distinct texts; logp: of the 256 bytes, then of the pieces."""
        self.pieces, self.logp = pieces, np.asarray(logp, np.float64)
        self.longest = max(map(len, pieces), default=1)
        self.index = {p: BYTES + k for k, p in enumerate(pieces)}
        self._tables()

    def _tables(self) -> None:
        """Hash tables in which each piece has a slot of its own; what collides goes to the next."""
        keys = np.array([self._hash(p) for p in self.pieces], np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("pieces must be distinct")
        bits, left, self.levels = 20, np.arange(len(keys)), []
        while len(left):
            shift, plus = np.uint64(64 - bits), np.uint64(len(self.levels) * int(PRIME) & (2**64 - 1))
            slots = (keys[left] * MIX + plus) >> shift
            _, first = np.unique(slots, return_index=True)
            held, at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            held[slots[first]], at[slots[first]] = keys[left[first]], BYTES + left[first]
            self.levels.append((shift, plus, held, at))
            left, bits = np.delete(left, first), 14

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(PRIME) + ord(c) + 1) & (2**64 - 1)
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, -1, np.int32)
        for shift, plus, held, at in self.levels:
            slot = (h * MIX + plus) >> shift
            hit = held[slot] == h
            out[hit] = at[slot[hit]]
        return out

    def _edges(self, codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By piece length from 1: index and log probability of the piece that starts at each place."""
        found, weights = [], []
        h = np.zeros(codes.shape, np.uint64)
        padded = np.append(self.logp, -np.inf)
        for n in range(1, min(self.longest, codes.shape[1]) + 1):
            h = h[:, : codes.shape[1] - n + 1] * PRIME + codes[:, n - 1 :] + np.uint64(1)
            at = self._find(h)
            found.append(at)
            weights.append(padded[at])
        unknown = found[0] < 0
        for code in np.unique(codes[unknown]):
            weights[0][unknown & (codes == code)] = self.logp[list(chr(int(code)).encode())].sum()
        return found, weights

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        x = np.stack(terms)
        top = x.max(axis=0)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(x - safe).sum(axis=0))

    def _walk(self, codes: np.ndarray, weights: list[np.ndarray], backward: bool) -> np.ndarray:
        size = codes.shape[1]
        log = np.full((size + 1, codes.shape[0]), -np.inf)
        log[size if backward else 0] = 0
        for j in range(size - 1, -1, -1) if backward else range(1, size + 1):
            spans = range(1, min(len(weights), size - j if backward else j) + 1)
            log[j] = self._sum([log[j + n] + weights[n - 1][:, j] if backward else log[j - n] + weights[n - 1][:, j - n] for n in spans])
        return log

    def _grouped(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(k)
        for size, ks in by.items():
            for a in range(0, len(ks), 4096) if size <= self.LONG else ():
                own = ks[a : a + 4096]
                yield own, np.frombuffer("".join(MARK + words[k] for k in own).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.uint64)

    def _long(self, words: list[str]) -> list[int]:
        return [k for k, w in enumerate(words) if len(w) + 1 > self.LONG]

    def _scalar(self, word: str) -> tuple[list[list[tuple[int, int, float]]], list[float]]:
        """Edges (start, index, weight) that end at each place, and the forward recursion, for one long word."""
        text, logp, get = MARK + word, self.logp, self.index.get
        ends: list[list[tuple[int, int, float]]] = [[] for _ in range(len(text) + 1)]
        log = [0.0] + [-math.inf] * len(text)
        for i in range(len(text)):
            if get(text[i]) is None:
                ends[i + 1].append((i, -1, float(logp[list(text[i].encode())].sum())))
            for n in range(1, min(self.longest, len(text) - i) + 1):
                at = get(text[i : i + n])
                if at is not None:
                    ends[i + n].append((i, at, float(logp[at])))
        for j in range(1, len(text) + 1):
            terms = [log[i] + w for i, _, w in ends[j]]
            top = max(terms, default=-math.inf)
            if top > -math.inf:
                log[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        return ends, log

    def forward(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for own, codes in self._grouped(words):
            out[own] = self._walk(codes, self._edges(codes)[1], False)[-1]
        for k in self._long(words):
            out[k] = self._scalar(words[k])[1][-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of the bytes and pieces in `counts` copies of the words."""
        out = np.zeros(len(self.logp))
        for own, codes in self._grouped(words):
            found, weights = self._edges(codes)
            ahead, back = self._walk(codes, weights, False), self._walk(codes, weights, True)
            total, copies = ahead[-1], counts[own].astype(np.float64)
            for n, (at, w) in enumerate(zip(found, weights), 1):
                start, i = np.nonzero(np.isfinite(w))
                share = np.exp(ahead[i, start] + w[start, i] + back[i + n, start] - total[start]) * copies[start]
                ids = at[start, i]
                out += np.bincount(ids[ids >= 0], share[ids >= 0], minlength=len(out))
                if n == 1:
                    for code in np.unique(codes[start, i][ids < 0]):
                        here = (ids < 0) & (codes[start, i] == code)
                        np.add.at(out, list(chr(int(code)).encode()), share[here].sum())
        for k in self._long(words):
            ends, ahead = self._scalar(words[k])
            text, back = MARK + words[k], [-math.inf] * len(words[k]) + [-math.inf, 0.0]
            for j in range(len(text), 0, -1):
                for i, at, w in ends[j]:
                    if back[j] == -math.inf or ahead[i] == -math.inf:
                        continue
                    back[i] = float(np.logaddexp(back[i], w + back[j]))
                    share = math.exp(ahead[i] + w + back[j] - ahead[-1]) * float(counts[k])
                    np.add.at(out, [at] if at >= 0 else list(text[i].encode()), share)
        return out


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a SentencePiece file that lower-cased words can hold, and the bytes' and
    pieces' first log weights, from the file's scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores = [], []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or MARK in p[1:] or any("A" <= c <= "Z" for c in p):
            continue
        pieces.append(p)
        scores.append(model.get_score(i))
    if MARK not in pieces:
        pieces.append(MARK)
        scores.append(min(scores, default=0.0))
    weight = np.concatenate([np.full(BYTES, 1.0 / (2.0 - min(scores))), 1.0 / (2.0 - np.minimum(scores, 0.0))])
    return pieces, np.log(weight / weight.sum())


def word_counts(documents: DataFrame, is_training: Column) -> DataFrame:
    """(token, c, n): uses in training documents and in all. The empty token is the end.

    Each task adds up its own words before the shuffle.
    """
    schema = pa.schema([("token", pa.string()), ("c", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            tokens = list(train.keys() | rest.keys())
            c, n = [train[t] for t in tokens], [train[t] + rest[t] for t in tokens]
            train.clear()
            rest.clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], schema=schema)

        for batch in small_batches(batches, "text"):
            for text, learn in zip(as_bytes(batch.column("text")), batch.column("learn").to_pylist()):
                into = train if learn else rest
                into.update(text.lower().split())
                into[b""] += 1
            if len(train) + len(rest) > 300_000:
                yield flush()
        yield flush()

    found = documents.select("text", is_training.alias("learn")).mapInArrow(run, "token string, c long, n long")
    return found.groupBy("token").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit(counts: DataFrame, path: str, smooth: float = 0.1, steps: int = 1) -> tuple[list[str], np.ndarray, float]:
    """Pieces, log probabilities of bytes and pieces, and the end's, from all training words.

    The vocabulary has a fixed size, and so has what a task returns and the driver sums up.
    """
    pieces, logp = vocabulary(path)
    ends = counts.where("token = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words = counts.where("token != '' and c > 0").select("token", "c")
    end = 0.0
    for _ in range(steps):
        lattice = Lattice(pieces, logp)
        spread = words.sparkSession.sparkContext.broadcast((pieces, logp))

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            own, total = Lattice(*spread.value), 0.0
            for batch in batches:
                total = total + own.expected(batch.column("token").to_pylist(), batch.column("c").to_numpy())
            if not np.isscalar(total):
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], names=["piece", "uses"])

        found = words.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full(len(lattice.logp), smooth)
        for r in found:
            uses[r.piece] += r.uses
        total = uses.sum() + ends + smooth
        logp, end = np.log(uses / total), math.log((ends + smooth) / total)
    return pieces, logp, end


def score_documents(documents: DataFrame, path: str, is_training: Column, broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    score is log10 of the marginal probability under the lattice, base_score log10 under
    add-one word unigrams. Null and empty texts are an end alone. Repeated rows are scored
    and counted as often as they occur; a null doc_id stays null; other columns are ignored.
    With no training rows all counts are zero. At most `broadcast_rows` words, the most
    frequent, are broadcast; every other word is joined.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", is_training.alias("learn"))
    counts = keep(word_counts(docs, F.col("learn")), "words")
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("all"), F.count(F.when(F.col("c") > 0, 1)).alias("distinct")).first()
    train_tokens, below = row["all"], math.log10(row["all"] + row["distinct"] + 1)
    pieces, logp, end = fit(counts, path)
    model = spark.sparkContext.broadcast((pieces, logp))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(*model.value)
        for batch in batches:
            words = batch.column("token").to_pylist()
            log = own.forward(words)
            log[[k for k, w in enumerate(words) if not w]] = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log / math.log(10))], names=[*batch.schema.names, "lattice"])

    words = keep(counts.mapInArrow(score, "token string, c long, n long, lattice double"), "scored")
    step = F.floor(8 * F.log2(F.col("n"))).cast("int")
    bands, rows, least = words.groupBy(step.alias("band")).count().orderBy(F.desc("band")).collect(), 0, None
    for r in bands:  # a few hundred at any size
        if (rows := rows + r["count"]) > broadcast_rows:
            break
        least = r.band
    frequent = words.where(step >= least if least is not None else F.lit(False)).select("token", "c", "lattice").collect()
    known = {r.token.encode(): k for k, r in enumerate(frequent)}
    hot = spark.sparkContext.broadcast((known, np.array([math.log10(r.c + 1) for r in frequent]), np.array([r.lattice for r in frequent]), np.array([r.c > 0 for r in frequent], bool)))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("learn", pa.bool_()), ("token", pa.string()), ("times", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lattice", pa.float64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, base, lattice, seen = hot.value
        get = index.get
        for batch in small_batches(batches, "text"):
            out: list[tuple] = []
            for row, doc_id, learn, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "learn")), as_bytes(batch.column("text"))):
                tokens = text.lower().split()
                tokens.append(b"")
                at = np.array([get(t, -1) for t in tokens], np.int64)
                held = at[at >= 0]
                # A key that starts with a space is no word: the document's own row meets nothing in the join.
                out.append((row, doc_id, learn, f" {row}".encode(), 0, len(tokens), int(seen[held].sum()), float(base[held].sum()), float(lattice[held].sum())))
                out += [(row, doc_id, learn, t, k, 0, 0, 0.0, 0.0) for t, k in Counter(tokens[i] for i in np.flatnonzero(at < 0)).items()]
            columns = list(zip(*out))
            columns[3] = pa.array(columns[3], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    parts = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(read, "row long, doc_id long, learn boolean, token string, times long, n_tokens long, n_known long, base double, lattice double")
    rare = words.where(step < least if least is not None else F.lit(True)).select("token", "c", F.col("lattice").alias("own"))
    joined = parts.join(rare, "token", "left")
    times = F.col("times")
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("learn").alias("learn"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, times).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.coalesce(times * F.log10(F.col("c") + 1), F.lit(0.0))).alias("base"),
        F.sum(F.col("lattice") + F.coalesce(times * F.col("own"), F.lit(0.0))).alias("score"),
    )
    return out.select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.col("n_known").cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        "score",
    )


def op2_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those whose crc32 of the id leaves another remainder than 2 by 7."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents")
    return score_documents(documents, public_tokenizers.path("piece_bpe_32k.model"), ~held_out(F.col("doc_id"), 7, 2))
