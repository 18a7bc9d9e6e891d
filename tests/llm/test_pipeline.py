import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import decontaminate, packing, quality, secrets, simhash
from tests.llm.test_packing import PATH, check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, SF), name)
        out.append(docs)
    return [spark.read.parquet(f"{SF}/documents.parquet"), *out]


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns


def test_quality_keeps_what_the_classifier_predicts(spark, stages):
    scored = quality.score_quality(stages[0], spark.read.parquet(f"{SF}/labels.parquet"), F.lit(False)).collect()
    assert by_id(stages[1]) == {i: r for i, r in by_id(stages[0]).items() if i in {s.doc_id for s in scored if s.predicted}}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = by_id(stages[1]).keys()
    assert np.mean([i in kept for i, y in labels.items() if y]) > 0.97


def test_one_of_each_group_stays(stages):
    docs = by_id(stages[1])
    ids = sorted(docs)
    fp = simhash.fingerprints([docs[i].text.encode() for i in ids])
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    least = np.arange(len(ids))
    while not np.array_equal(least, new := np.where(near, least[None, :], len(ids)).min(axis=1)):
        least = new
    assert by_id(stages[2]) == {ids[k]: docs[ids[k]] for k in range(len(ids)) if least[k] == k}


def test_an_id_with_several_texts_is_decided_for_each(spark):
    words = [f"{a}{b}" for a in "river stone amber night harbour winter music paper garden iron".split() for b in range(40)]
    text = lambda k: " ".join(words[(k * 37 + i * (7 + k)) % len(words)] for i in range(120))
    rows = [(1, text(1)), (5, text(1)), (5, text(2)), (5, text(3)), (5, text(3)), (6, text(4)), (6, text(4)), (7, text(2)), (8, text(5)), (9, text(5)), (None, text(1))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, text(1)), (5, text(2)), (5, text(3)), (6, text(4)), (8, text(5)), (None, text(1))], key=str)


def test_leaks_go_and_secrets_are_cut(spark, stages):
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = by_id(stages[2]), by_id(stages[3])
    held = {i for i, r in before.items() if any(x in decontaminate.normal(r.text) for x in items)}
    assert held.isdisjoint(after) and len(before.keys() - held - after.keys()) <= 0.02 * len(before)
    for i, r in by_id(stages[4]).items():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
        if not secrets.base_spans(after[i].text):
            assert r.text == after[i].text
    assert by_id(stages[4]).keys() == after.keys()


def test_packing_holds_every_token(stages):
    plain = Tokenizer.from_file(PATH)
    docs = {i: r.text for i, r in by_id(stages[4]).items()}
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == docs.keys()
    check(rows, docs, plain)


def test_run_equals_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[5].select(*got.columns).collect()))


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some plain words of a text", "en", "s", 26), (3, "some plain words of a text", "en", "s", 26), (None, "other words without an id", "en", "s", 3), (4, "long " * 40000, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("label", F.lit("clash"))
    for some in (docs, docs.limit(0)):
        out = some
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = corpus_pipeline.keep(stage(spark, out, SF), name)
        assert {r.doc_id for r in out.collect()} == ({1, 3, 4, None} if some is docs else set())
    assert zlib.crc32(np.array([1], "<u4").tobytes()) in {r.ids_crc32 for r in packing.pack_documents(docs, PATH).collect()}
    # The quality stage on odd rows: with the documents' labels, with labels of none of them, and with no labels.
    for label, want in (([(1, 1), (2, 0), (3, 1), (4, 0), (None, 1), (3, None)], None), ([(99, 1)], {1, 2, 3, 4, None}), ([], {1, 2, 3, 4, None})):
        folder = tmp_path / f"labels{len(label)}"
        spark.createDataFrame(label, "doc_id long, quality int").write.parquet(str(folder / "labels.parquet"))
        kept = corpus_pipeline.quality_stage(spark, docs, str(folder)).collect()
        scored = quality.score_quality(docs, spark.read.parquet(str(folder / "labels.parquet")), F.lit(False)).collect()
        assert sorted(map(str, (r.doc_id for r in kept))) == sorted(str(r.doc_id) for r in scored if r.predicted)
        assert want is None or {r.doc_id for r in kept} == want
        assert corpus_pipeline.quality_stage(spark, docs.limit(0), str(folder)).count() == 0
