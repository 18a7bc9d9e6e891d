import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing

PATH = "/opt/tokenizers/word_bpe_49k.json"
ODD = ["", "Don't stop... it's we'll 12 34a", "ÉCOLE é ǅ İstanbul ΣΑΣ ẞ x y z", "a\x1cb\x1fc \x85d", "<|endoftext|> and <|startoftext|>x", "word### (paren) [x] e.g. i.e.", "日本語テキスト 한국어 🎉🎉 a🎉b", "x" * 300, "´a ́b", "ſtraße ﬁne K", "a_b-c d'e 'twas o''s '", "½² ٣ Ⅷ"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizers_own(plain, spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    own = packing.WordTokenizer(PATH, most=500)
    for a in range(0, len(texts), 7):
        got = own.encode([t.encode() for t in texts[a : a + 7]])
        for t, g in zip(texts[a : a + 7], got):
            assert np.frombuffer(g, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'.,sdmtrevl#a1éÉ́")), max_size=40))
def test_ids_of_any_text(text):
    global _own, _plain
    try:
        _own
    except NameError:
        from tokenizers import Tokenizer

        _own, _plain = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    assert np.frombuffer(_own.encode([text.encode()])[0], "<u4").tolist() == _plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\x0b\x1c\x7f\xa0a1'9.,<(|=Bstdé×÷ÀÿĀİĭªµ²–Σß\u0301\u0338\u0345한ᄀ"), max_size=30), min_size=1, max_size=4))
def test_ids_where_words_meet_marks_and_digits(texts):
    global _met, _theirs
    try:
        _met
    except NameError:
        from tokenizers import Tokenizer

        _met, _theirs = packing.WordTokenizer(PATH, most=50), Tokenizer.from_file(PATH)
    for t, g in zip(texts, _met.encode([t.encode() for t in texts])):
        assert np.frombuffer(g, "<u4").tolist() == _theirs.encode(t, add_special_tokens=False).ids


def test_added_tokens_only_as_they_are_written(plain):
    texts = ["x <|EndOfText|> y", "–<|ENDOFTEXT|>x", "<|endoftext|>", "A<|startoftext|><|endoftext|>É.", "<|<|endoftext|>|>", ""]
    for t, g in zip(texts, packing.WordTokenizer(PATH).encode([t.encode() for t in texts])):
        assert np.frombuffer(g, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


class Counting(packing.WordTokenizer):
    learned = 0

    def learn(self, words):
        self.learned += len(words)
        return super().learn(words)


def test_a_word_is_learned_once_with_any_marks_and_digits():
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    own = Counting(PATH)
    for around in ("{}", "{},", "({})", "{}7", "12{}.", "'{}'", "é {}="):
        own.encode([" ".join(map(around.format, words)).encode()])
    assert own.learned <= 2 * len(words) + 20  # the apostrophe stays with what follows


def test_memo_keeps_what_is_used_most():
    own = Counting(PATH, most=100)
    for a in range(40):
        own.encode([" ".join(["often", "again"] * 9 + [f"x{chr(97 + a // 26)}{chr(97 + a % 26)}{chr(97 + b)}" for b in range(26)]).encode()])
        assert len(own.words) == len(own.ids) == len(own.uses) <= 100
    assert own.learned == 40 * 26 + 2


def test_short_batches_are_joined_and_long_ones_cut():
    import pyarrow as pa

    for sizes, least in (([3, 5, 1, 0, 4], 10**6), ([200, 1, 300], 100)):
        texts = [["é" * 10 if k % 3 else None for k in range(n)] for n in sizes]
        out = list(packing.large_batches((pa.RecordBatch.from_pydict({"text": pa.array(t, pa.string())}) for t in texts), "text", least))
        assert [x for b in out for x in b.column("text").to_pylist()] == [x for t in texts for x in t]
        assert len(out) == 1 if least == 10**6 else len(out) > 10


def plain_best_fit(lengths, window):
    rooms, out = [], []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(window - n)
        out.append(sorted(rooms))
    return out[-1] if out else []


@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_equals_plain_search(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    bins, offsets, n = packing.best_fit_decreasing(lengths, 64)
    used = np.bincount(bins, lengths, minlength=n) if len(lengths) else np.array([])
    assert sorted((64 - used).astype(int).tolist()) == plain_best_fit(lengths.tolist(), 64)
    for b in range(n):
        at = offsets[bins == b]
        assert at.tolist() == np.concatenate([[0], np.cumsum(lengths[bins == b])[:-1]]).tolist()


def check(rows, docs, plain, window=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in docs.items():
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(r.length for r in rows) / (window * len(by_seq))


def test_query_is_a_round_trip(spark, sf_dir, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check(packing.op10_best_fit(spark, sf_dir).collect(), docs, plain) > 0.95


def test_edges_of_input(spark, plain):
    rows = [(1, None, 0), (2, "", 0), (3, "a " * 5000, 0), (4, "a " * 2047, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    check(packing.pack_documents(frame, PATH).collect(), {r[0]: r[1] for r in rows}, plain)
    twice = packing.pack_documents(spark.createDataFrame([(7, "x y"), (7, "x y"), (None, "x")], "doc_id long, text string"), PATH).collect()
    assert sorted(r.length for r in twice) == [2, 3, 3] and {r.offset for r in twice} == {0, 3, 6}
    assert packing.pack_documents(frame.limit(0), PATH).count() == 0
