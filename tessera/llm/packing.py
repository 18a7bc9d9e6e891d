"""Packing: documents become pieces of at most one window, and best-fit decreasing puts
the pieces into windows. A segment tree indexed by remaining capacity finds the tightest
open window in O(log window).

Overlong documents are first cut into full windows, which are sequences of their own; only
the remainders compete. They are dealt into shards by a hash of the document, enough of
them that a shard fits one task, each with many thousands of pieces, so the few windows
that a shard leaves part empty are a vanishing share.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tessera.llm.shared import as_bytes, keep, small_batches, table

#: Classes of bytes: white space, letters, digits, other printable ASCII, and all else.
SPACE, LETTER, DIGIT, SYMBOL, OTHER = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[33:127] = SYMBOL
KINDS[list(b"0123456789")] = DIGIT
KINDS[list(b"abcdefghijklmnopqrstuvwxyz")] = LETTER
KINDS[list(b" \t\n\r\x0b\x0c")] = SPACE


def all_letters(text: str) -> bool:
    """Whether the text is one run of letters, also once it is composed and lower-cased."""
    return text.isascii() and text.isalpha() or text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()


NOTHING = pa.array([], pa.large_binary())


def few_changes(text: str) -> bool:
    """Whether all are letters up to U+012F, which are composed as they are and lower-cased one by one."""
    return text.isalpha() and max(text) < "\u0130"


def split_words(data: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """(starts, words) of lower-case UTF-8 that begins and ends with a space.

    Words end at ASCII white space and, within it, where the tokenizer's pattern surely ends a
    pre-token: between letters, single digits and symbols of ASCII, U+00C0 to U+00FF being
    letters too. What follows an apostrophe stays with it, as in 's and 'll. Characters on
    either side of such a place are starters that compose with nothing before them.
    """
    kind = KINDS[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    left, right = kind[:-1], kind[1:]
    cut = (left != right) & ((left != OTHER) & (right != OTHER) | (left == SPACE) | (right == SPACE))
    cut |= (left == DIGIT) & (right == DIGIT)
    cut &= (data[:-1] != ord("'")) | (right != LETTER)
    edges = np.append(np.flatnonzero(cut) + 1, len(data))
    word = kind[edges[:-1]] != SPACE
    starts = edges[:-1][word]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.diff(edges)[word], out=offsets[1:])
    return starts, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kind != SPACE])])


class WordTokenizer:
    """Token ids of whole texts by a tokenizer file, with a bounded memo of word ids.

    No token spans the words of `split_words`, so a text's ids are those of its words in order.
    The memo is two Arrow arrays, of words and of their ids, and a batch's words are numbered
    together with them, so that Python sees a word only when it is new. Beyond `most` words the
    half of them that occurred most stays; the memo changes speed, not results. Added tokens
    are found in the text as it is, before it is lower-cased.
    """

    def __init__(self, path: str, most: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that need no other change than to bytes.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.most, self.words, self.ids, self.uses = most, NOTHING, NOTHING, np.zeros(0, np.int64)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.added = {t.content.encode(): np.array([i], np.uint32).tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.at_added = re.compile(b"(" + b"|".join(map(re.escape, self.added)) + b")")

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words, by encoding letter runs many at a time."""
        out: dict[bytes, bytes] = {}
        known = {w: s.lower() for w, s in zip(words, map(bytes.decode, words)) if few_changes(s)}
        self._join(self.plain, known, out)
        self._join(self.tokenizer, {w: s for w in words if w not in out and all_letters(s := w.decode())}, out)
        rest = [w for w in words if w not in out]
        for w, e in zip(rest, self.tokenizer.encode_batch([w.decode() for w in rest], add_special_tokens=False)):
            out[w] = np.array(e.ids, np.uint32).tobytes()
        return out

    def _join(self, by: Tokenizer, words: dict[bytes, str], out: dict[bytes, bytes]) -> None:
        """Adds the ids of words of one pre-token each, unless the number of their last tokens shows that some aren't."""
        if not words:
            return
        ids = np.array(by.encode(" ".join(words.values()), add_special_tokens=False).ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words):
            raw, ends = ids.tobytes(), (4 * cuts).tolist()
            out.update(zip(words, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, as bytes."""
        split = [self.at_added.split(t) if any(x in t for x in self.added) else [t] for t in texts]
        ids = iter(self._encode([x for xs in split for x in xs[::2]]))
        return [next(ids) if len(xs) == 1 else b"".join(self.added[x] if k % 2 else next(ids) for k, x in enumerate(xs)) for xs in split]

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b" ".join([b"", *texts, b""]).lower(), np.uint8)
        starts, words = split_words(data)
        if not len(words):
            return [b""] * len(texts)
        before = len(self.words)
        numbered = pa.concat_arrays([self.words, words]).dictionary_encode()
        known, numbers = numbered.dictionary, numbered.indices[before:]
        fresh = known[before:].to_numpy(zero_copy_only=False).tolist()
        new: list[bytes] = []
        for a in range(0, len(fresh), 4096):
            new += map(self.learn(some := fresh[a : a + 4096]).__getitem__, some)
        all_ids = pa.concat_arrays([self.ids, pa.array(new, pa.large_binary())])
        out = all_ids.take(numbers)
        firsts = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
        bounds = np.frombuffer(out.buffers()[1], np.int64)[firsts].tolist()
        raw = memoryview(out.buffers()[2] or b"")
        self._remember(known, all_ids, numbers)
        return [bytes(raw[a:b]) for a, b in zip(bounds, bounds[1:])]

    def _remember(self, words: pa.Array, ids: pa.Array, used: pa.Array) -> None:
        uses = np.bincount(used.to_numpy(), minlength=len(words))
        uses[: len(self.uses)] += self.uses
        if len(words) > self.most:
            stay = np.sort(np.argsort(-uses, kind="stable")[: self.most // 2])
            words, ids, uses = words.take(pa.array(stay)), ids.take(pa.array(stay)), uses[stay] // 2
        self.words, self.ids, self.uses = words, ids, uses


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, which serves many tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def large_batches(batches: Iterable[pa.RecordBatch], column: str, least: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `least` bytes of `column`, short batches together, as each call looks through the memo."""
    held, size = [], 0
    for batch in small_batches(batches, column, least, 100_000):
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= least // 2:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def cut_pieces(documents: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and a remainder for each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in large_batches(batches, "text"):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode(as_bytes(batch.column("text")))):
                ids += end
                total = len(ids) // 4
                rows += [(doc_id, a, min(window, total - a), zlib.crc32(ids[4 * a : 4 * (a + window)]), total) for a in range(0, total, window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, in the given order, and the number of bins.

    `lengths` must not rise. Open windows hang in the leaf of their remaining capacity;
    an inner node knows whether any leaf below it is taken, so the smallest sufficient
    capacity is found by one climb and one descent.
    """
    size = 1 << window.bit_length()
    tree = [0] * (2 * size)
    stacks: list[list[int]] = [[] for _ in range(window + 1)]
    bins, offsets, opened = [0] * len(lengths), [0] * len(lengths), 0
    for k, need in enumerate(lengths.tolist()):
        at = size + need
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at > 1:
                at += 1
                while at < size:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
        if at > 1:
            room = at - size
            chosen = stacks[room].pop()
            if not stacks[room]:
                while at:
                    tree[at] = 0 if at >= size else tree[2 * at] or tree[2 * at + 1]
                    at >>= 1
        else:
            room, chosen, opened = window, opened, opened + 1
        bins[k], offsets[k] = chosen, window - room
        left = room - need
        if left:
            stacks[left].append(chosen)
            at = size + left
            while at and not tree[at]:
                tree[at] = 1
                at >>= 1
    return np.array(bins, np.int64), np.array(offsets, np.int64), opened


def pack(pieces: DataFrame, window: int = 2048, shard_rows: int = 10_000) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to `window` tokens.

    Ties in length go by doc_id, then start. A shard numbers its windows shard + k * shards,
    so ids never meet and don't depend on which executor packs.
    """
    spark = pieces.sparkSession
    pieces = keep(pieces, "pieces")
    shards = max(1, -(-pieces.where(F.col("length") < window).count() // shard_rows))
    full_shards = max(1, -(-pieces.where(F.col("length") >= window).count() // (4 * shard_rows)))
    shard = F.when(F.col("length") < window, F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards))).otherwise(F.lit(shards) + F.pmod(F.xxhash64("doc_id", "start"), F.lit(full_shards)))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        number, offset, _ = best_fit_decreasing(rows["length"].to_numpy(), window)
        return rows.assign(sequence_id=int(rows["shard"].iloc[0]) + number * (shards + full_shards), offset=offset).drop(columns="shard")

    out = pieces.withColumn("shard", shard.cast("long")).groupBy("shard").applyInPandas(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(documents: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Documents of any length are cut into full
    windows. Repeated rows are packed as often as they occur; a null doc_id is kept; other
    columns are ignored. An empty table gives an empty result.
    """
    return pack(cut_pieces(documents, path, window, end_id), window)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens of the 49k word vocabulary, id 1 ending each."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
