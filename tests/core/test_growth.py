"""Steps that grew faster than their input: their plans, and that what replaced them gives the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import clean, unicode
from tessera.operators import graph, models, text
from tessera.plans import catalog, text_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_betweenness_in_blocks_is_that_by_sources(spark):
    rng, rows = np.random.default_rng(5), []
    for w, (authors, subjects, edges) in enumerate([(40, 12, 60), (60, 9, 300), (30, 30, 34), (50, 6, 40)]):
        rows += [(str(w), f"a{rng.integers(authors)}", f"s{rng.integers(subjects)}") for _ in range(edges)]
    rows += [("chain", f"a{k}", f"s{k + d}") for k in range(24) for d in (0, 1)] + [("twins", f"a{k}", s) for k in range(30) for s in ("s1", "s2")]
    frame = spark.createDataFrame(rows, "w string, a string, s string")
    found = [graph.betweenness(frame, "w", "a", "s", **how) for how in ({}, {"block": 7}, {"narrow": 0}, {"depth": 3})]
    want, *others = [{(r.w, r.node): r.betweenness for r in f.collect()} for f in found]
    assert len(want) == frame.select("w", "s").distinct().count() and all(x == pytest.approx(want) for x in others)
    # Edges were copied to each of up to 4,096 tasks: an exploded row for each.
    assert "Generate" not in plan(graph.betweenness(frame, "w", "a", "s", work=1, depth=50))


@pytest.mark.parametrize("name", ["title_term_subject_time", "title_tfidf_time", "title_bigram_time"])
def test_titles_are_taken_apart_without_their_articles(spark, sf_dir, name):
    # Each article's title was exploded into a row a term, and met its subjects then.
    found = [x for x in plan(catalog.queries()[name](spark, sf_dir)).splitlines() if "Generate explode" in x]
    assert found and not any("master_id" in x for x in found)


def test_grouped_counts(spark):
    groups = spark.createDataFrame([("w1", 1, 5, 4), ("w1", 2, 2, 2), ("w2", 1, 1, 1)], "w string, item long, rows long, articles long")
    terms = spark.createDataFrame([(1, "x", 2), (2, "x", 1), (2, "y", 1)], "item long, term string, times long")
    assert {tuple(r) for r in text.grouped_counts(groups, terms, "term", "w").collect()} == {("w1", "x", 12, 6), ("w1", "y", 2, 2), ("w2", "x", 2, 1)}


@pytest.mark.parametrize("name", ["network_nodes", "network_nodes_author", "network_nodes_subject"])
def test_numbers_are_given_to_a_written_table(spark, sf_dir, name):
    # Boundaries, counts and numbers each made the rows anew, with all the joins below them.
    found = plan(catalog.queries()[name](spark, sf_dir))
    assert "/numbered-" in found and "lineitem" not in found


def test_article_edges_number_their_nodes_by_order_alone(spark, sf_dir):
    # Each side's counts were made too, three times, and articles with their titles were shuffled to meet the nodes.
    found = plan(catalog.queries()["network_edges_article"](spark, sf_dir))
    assert found.count("/nodes-") == 2 and "/numbered-" not in found and "A_%d" not in found


def test_counts_of_places_are_made_once(spark, sf_dir):
    # Articles were joined four times, and counts made for the rows, the windows and their number.
    found = plan(catalog.queries()["place_subject_time"](spark, sf_dir))
    assert "/counts-" in found and "lineitem" not in found


def themed(spark):
    rng = np.random.default_rng(8)
    docs = [(d, [f"w{int(x)}" for x in rng.zipf(1.6, 40) % 30], "ab"[d % 2]) for d in range(80)] + [(99, [], "a"), (None, ["w1"], "a"), (100, ["w1"], None)]
    return spark.createDataFrame(docs, "doc_id long, tokens array<string>, g string")


@pytest.mark.parametrize("cap", [3, 40, 12000])
def test_kept_terms_of_three_words_by_their_pairs(spark, cap, monkeypatch):
    docs = themed(spark)
    whole = docs.withColumn("tokens", text.ngrams(F.col("tokens"), 1, 3))
    want = [r.term for r in text.kept_terms(text.term_rows(whole), docs, cap=cap).collect()]
    assert text.kept_list(docs, 3, cap=cap) == want
    monkeypatch.setattr(text, "MOST_PAIRS", 1)
    assert text.kept_list(docs, 3, cap=cap) == want


@pytest.mark.parametrize("group", ["g"])
def test_tfidf_is_counted_within_rows(spark, group):
    docs = themed(spark)
    table = text.tfidf_table(docs.where("g is not null"), text.kept_list(docs), [group])
    # Lengths were sums over sorted rows of all terms, which met their groups by document.
    found = plan(text.tfidf_by_group(docs, group))
    assert "/sums-" in found and "doc_id" not in found
    kept = set(text.kept_list(docs))
    own = [(r.g, [t for t in r.tokens if t in kept]) for r in docs.collect() if r.doc_id is not None and r.g]
    for r in table.collect():
        texts = [t for g, t in own if g == r.g and t]
        s, df = sum(t.count(r.term) / len(t) for t in texts), sum(r.term in t for t in texts)
        assert (r.raw_count, r.document_count) == (sum(t.count(r.term) for t in texts), df)
        assert r.tfidf_score == pytest.approx(s * (np.log((1 + len(texts)) / (1 + df)) + 1))


@pytest.mark.parametrize("name", ["header_cleaning", "normalize_unicode"])
def test_texts_are_worked_on_in_slices(spark, sf_dir, name):
    # A pandas function held a whole batch of 10,000 texts, of any length, in several forms.
    found = plan(catalog.queries()[name](spark, sf_dir))
    assert "MapInArrow" in found and "ArrowEvalPython" not in found


def test_slices_are_of_whole_rows_and_few_characters():
    sizes = [0, 5, 900, 3, 3000, 1, 1, 0, 99, 450, 450, 450]
    parts = [list(range(len(sizes)))[p] for p in unicode.slices(sizes, 1000)]
    assert [k for p in parts for k in p] == list(range(len(sizes))) and max(sum(sizes[k] for k in p) for p in parts if len(p) > 1) < 2 * 1000 + 3000
    assert list(unicode.slices([], 5)) == []


def test_cleaned_rows_are_as_columns(spark):
    frame = spark.createDataFrame([(1, "## p. 1 (#11) ####\n\nA HEADER 1\n\nBody of a text.\n" * 3, "A title"), (2, None, None), (3, "", "x")], "k long, text string, title string")
    want = frame.select("k", clean.cleaned("text", "title").alias("c")).orderBy("k").collect()
    assert clean.cleaned_rows(frame, "text", "title").orderBy("k").collect() == want
    want = frame.select("k", "title", unicode.normalize_unicode("text").alias("n")).orderBy("k").collect()
    assert unicode.normalized_rows(frame, "text", "n").orderBy("k").collect() == want


def test_factorisation_reads_numbers_in_its_iterations(spark, monkeypatch):
    # Each iteration sent every word of the cached documents through Python and looked it up there.
    read, keep = [], models.keep
    monkeypatch.setattr(models, "keep", lambda df, label: read.append(df.dtypes) or keep(df, label))
    rows = [(d, t, 0.5) for d in range(6) for t in ("ab" if d % 2 else "cd")]
    found = models.nmf_topics(spark.createDataFrame(rows, "doc_id long, term string, value double"), list("abcd"), k=2, iterations=30, words=2).collect()
    assert read == [[("ids", "array<int>"), ("values", "array<double>")]]
    assert sorted("".join(sorted(r.word for r in found if r.topic_id == k)) for k in (0, 1)) == ["ab", "cd"]


def test_document_lengths_need_no_window(spark, sf_dir, monkeypatch):
    # All terms were shuffled and sorted by document for its length.
    made, keep = [], text_queries.keep
    monkeypatch.setattr(text_queries, "keep", lambda df, label: made.append(plan(df)) or keep(df, label))
    text_queries.tfidf_doc_vectors(spark, sf_dir)
    assert made and "Window" not in made[0] and "Exchange" not in made[0]
