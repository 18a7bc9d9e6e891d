"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ by k = floor(rate * m) edits. Cut into k + 1 pieces, one
piece at least survives k edits untouched, so exact hits of pieces, found by one
Aho-Corasick pass over a text, give every candidate place; Myers' bit-parallel distance
then verifies the candidate windows. Documents never shuffle: the items, a stated query
set, are broadcast in blocks of bounded size, and each block passes over all rows. A block
of two million characters is an automaton of about 50 MB in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import small_batches, table


def normal(text: str | None) -> str:
    """Lower-cased A-Z, runs of ASCII white space as one space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()).decode("utf-8", "surrogatepass")


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of `pattern` to any substring of `text`, and
    the first place where such a substring ends. Bit-parallel over the whole pattern."""
    m = len(pattern)
    if not m:
        return 0, 0
    full, high = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus)
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best, end = score, j
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
    return best, end


@dataclass
class Matcher:
    """The pieces of a block of items in one automaton."""

    items: list[tuple[int | None, str]]
    rate: float
    automaton: object = None
    where: list[list[tuple[int, int]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.texts = [normal(t) for _, t in self.items]
        self.budgets = [int(self.rate * len(t)) for t in self.texts]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (text, budget) in enumerate(zip(self.texts, self.budgets)):
            cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    pieces.setdefault(text[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def matches(self, text: str | None, first_only: bool = False) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, end, budget) of each item that the text holds within its budget."""
        if self.empty or not text:
            return []
        text = normal(text)
        diagonals: dict[int, list[int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                diagonals.setdefault(k, []).append(last + 1 - size - offset)
        out = []
        for k, starts in diagonals.items():
            found = self._verify(text, k, starts)
            if found:
                out.append((self.items[k][0], *found, self.budgets[k]))
                if first_only:
                    break
        return out

    def _verify(self, text: str, k: int, starts: list[int]) -> tuple[int, int] | None:
        item, budget = self.texts[k], self.budgets[k]
        starts = sorted(set(starts))
        for s in starts:
            if s >= 0 and text.startswith(item, s):
                return 0, s + len(item)
        if not budget:
            return None
        best, a = None, 0
        while a < len(starts):
            b = a
            while b + 1 < len(starts) and starts[b + 1] - starts[b] <= 2 * budget:
                b += 1
            low = max(0, starts[a] - budget)
            distance, end = myers(item, text[low : starts[b] + len(item) + budget])
            if distance <= budget and (best is None or distance < best[0]):
                best = (distance, low + end)
            a = b + 1
        return best


_MATCHERS: dict[str, Matcher] = {}


def _blocks(benchmark: DataFrame, rate: float, block_chars: int) -> Iterator[object]:
    """Broadcasts of items, of about `block_chars` characters each, one at a time."""
    context = benchmark.sparkSession.sparkContext
    block: list[tuple[int | None, str]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if not r.text or not normal(r.text):
            continue
        block.append((r.item_id, r.text))
        size += len(r.text)
        if size >= block_chars:
            yield context.broadcast((f"{context.applicationId}-{id(block)}-{size}", block, rate))
            block, size = [], 0
    if block:
        yield context.broadcast((f"{context.applicationId}-{id(block)}-{size}", block, rate))


def _matcher(value: tuple[str, list, float]) -> Matcher:
    key = f"{value[0]}-{hash(tuple(value[1]))}-{value[2]}"
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(value[1], value[2])
    return _MATCHERS[key]


def find_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, distance, end_char, budget): one row for each document and item that
    it holds within the item's budget, with the least distance over all places.

    Texts are compared lower-cased and with single spaces; end_char counts in that form. Of
    equal distances the first place counts. Null or empty texts and items match nothing;
    items with equal texts each match; repeated rows match each; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("end_char", pa.int64()), ("budget", pa.int32())])
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    out = None
    for block in _blocks(benchmark, rate, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own = _matcher(block.value)
            for batch in small_batches(batches, "text", 4_000_000):
                rows = [(doc_id, i, d, e, b) for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for i, d, e, b in own.matches(text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        found = docs.mapInArrow(run, "doc_id long, item_id long, distance int, end_char long, budget int")
        out = found if out is None else out.unionByName(found)
    return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, end_char long, budget int") if out is None else out


def decontaminate(documents: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = 2_000_000) -> DataFrame:
    """The rows of `documents`, unchanged, whose text holds no item within its budget."""
    for block in _blocks(benchmark, rate, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own = _matcher(block.value)
            for batch in small_batches(batches, "text", 4_000_000):
                clean = [not own.matches(text, True) for text in batch.column("text").to_pylist()]
                if any(clean):
                    yield batch.filter(pa.array(np.array(clean)))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def op1_pigeonhole_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
