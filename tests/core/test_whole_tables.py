"""Queries over whole tables: what they return doesn't depend on ids or caps below the operator's."""

import math
from collections import Counter

from tessera.plans import catalog
from tessera.plans.text_queries import tokenized


def test_no_sql_leaves_rows_out_by_id():
    for name, sql in catalog.oracles().items():
        assert "l_orderkey %" not in sql and "p_partkey <" not in sql and "doc_id <" not in sql, name


def test_tfidf_doc_vectors(spark, sf_dir):
    docs = {r.doc_id: Counter(r.tokens) for r in tokenized(spark, sf_dir).select("doc_id", "tokens").collect()}
    df = Counter(t for c in docs.values() for t in c)
    want = {(d, t): n / sum(c.values()) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for d, c in docs.items() for t, n in c.items()}
    got = {(r.doc_id, r.term): r.tfidf for r in catalog.queries()["tfidf_doc_vectors"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_vocabularies_have_the_operators_cap(spark, tmp_path):
    docs = [(d, " ".join("w" + "".join(chr(97 + int(x)) for x in f"{w:04}") for w in range(k, 2500, 2)), "en", "src1", 1) for k in (0, 1) for d in range(k, 20, 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(tmp_path / "documents.parquet")
    rows = catalog.queries()["df_vocabulary"](spark, str(tmp_path)).collect()
    assert len(rows) == 2500 and all(r.kept_by_df_filter for r in rows)
