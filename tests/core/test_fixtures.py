"""Hand-made cases and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import clean, scalar, unicode
from tessera.operators import biblio, graph, matching, models, relational, setops, text, topics
from tessera.plans import roles
from tessera.sources import ocr, texts
from tessera.streaming import windows


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


BODY = "The body of the article goes on here, as bodies do."
MARK = "## p. 5 (#213) ####"
TITLE = "Early European Researches"


@pytest.mark.parametrize(
    "lines, kept",
    [
        ([MARK, "AND THE ADJACENT COUNTRIES IN THE YEAR B.C. 5", BODY], [BODY]),
        ([MARK, "EARLY EUROPEAN RESEARCHES", "6", BODY], [BODY]),
        (["## p. 6 (#214) ####", "6", "EARLY EUROPEAN RESEARCHES", BODY], [BODY]),
        ([MARK, "ANOTHER RUNNING HEADER", "6", BODY], [BODY]),
        ([MARK, "6 EARLY EUROPEAN RESEARCHES", BODY], [BODY]),
        ([MARK, "ARTICLE IX.", "EARLY EUROPEAN RESEARCHES", "BY AN AUTHOR", BODY], ["ARTICLE IX.", "EARLY EUROPEAN RESEARCHES", "BY AN AUTHOR", BODY]),
        (["JOURNAL", "OF THE", "NORTH-CHINA BRANCH", "OF THE", "ROYAL ASIATIC SOCIETY.", "ARTICLE I.", "A TITLE", BODY], ["ARTICLE I.", "A TITLE", BODY]),
        ([MARK, BODY, "", "12 men came."], [BODY, "", "12 men came."]),
    ],
)
def test_headers(lines, kept):
    b = clean.batch(["\n".join(lines), "", "\n".join(lines)], [TITLE, TITLE, TITLE])
    body = b.body()
    assert body[0].split("\n") == kept and body[1] == "" and body[2] == body[0]
    assert b.page_markers.tolist() == [sum(line.startswith("##") for line in lines), 0, sum(line.startswith("##") for line in lines)]


# The seven published cases, (title, text, readable text).
CASES = [
    ("And the Adjacent Countries in the Second Century B.C.", "## p. 5 (#213) ####\n\nAND THE ADJACENT COUNTRIES IN THE SECOND CENTURY B.C. 5\n\nThe body paragraph begins here.\n", "The body paragraph begins here."),
    ("And the Adjacent Countries in the Second Century B.C.", "## p. 6 (#214) ####\n\nAND THE ADJACENT COUNTRIES IN THE SECOND CENTURY B.C.\n6\n\nAnother body paragraph begins here.\n", "Another body paragraph begins here."),
    ("Early European researches into the flora of China", "## p. 6 (#62) ####\n\n6\nEARLY EUROPEAN RESEARCHES\n\nBody after number-first header.\n", "Body after number-first header."),
    ("Early European researches into the flora of China", "## p. 6 (#62) ####\n\nEARLY EUROPEAN RESEARCHES\n6\n\nBody after header-first page number.\n", "Body after header-first page number."),
    ("Early European researches into the flora of China", "## p. 6 (#62) ####\n\n6 EARLY EUROPEAN RESEARCHES\n\nBody after leading-number header.\n", "Body after leading-number header."),
    ("Retrospect of events in China", "## p. 181 (#203) ####\n\nARTICLE IX.\nRETROSPECT OF EVENTS IN CHINA, 1873.\nBy Author Name\n\nOpening body remains here.\n", "ARTICLE IX.\nRETROSPECT OF EVENTS IN CHINA, 1873.\nBy Author Name\n\nOpening body remains here."),
    ("Title of Article", "JOURNAL\nOF THE\nNORTH-CHINA BRANCH\nOF THE\nROYAL ASIATIC SOCIETY.\n\nARTICLE I.\n\nTitle of Article\n\nBy Author Name\n\nBody begins here.\n", "ARTICLE I.\n\nTitle of Article\n\nBy Author Name\n\nBody begins here."),
]


def test_published_cases(spark):
    rows = spark.createDataFrame([(k, t, x) for k, (t, x, _) in enumerate(CASES)], "k int, title string, text string").select("k", clean.cleaned("text", "title").alias("c")).collect()
    assert {r.k: r.c.text for r in rows} == {k: want for k, (_, _, want) in enumerate(CASES)}
    by = {r.k: r.c for r in rows}
    assert [by[k].header_lines for k in range(7)] == [1, 1, 1, 1, 1, 0, 0] and [by[k].page_numbers for k in range(7)] == [0, 1, 1, 1, 0, 0, 0]
    assert by[6].front_matter and by[6].warnings == ["front_matter_removed", "no_page_markers_found"] and by[6].removed[0] == "JOURNAL"


def test_header_warnings():
    shout = "\n".join(f"## p. {k} (#{k}) ##\nSOME RUNNING HEADER\nbody of it here." for k in range(25))
    texts = ["no pages", "## p. 3 (#3) ##", "## p. 3 (#3) ##\nplain body", "## p. 3 (#3) ##\nnotes on early european\nbody", "journal\nof the royal asiatic society", shout, "## p. 7 (#1) ##\n7\nCHINA!!\nbody"]
    b = clean.batch(texts, ["Notes on early European researches"] * len(texts))
    assert b.warnings() == [["no_page_markers_found"], ["unusual_header_pattern"], ["unusual_header_pattern"], ["possible_body_text_removed"], ["front_matter_detected_but_article_marker_not_found", "no_page_markers_found"], ["many_headers_removed"], ["unusual_header_pattern"]]
    assert b.body()[3] == "body" and b.body()[6] == "7\nCHINA!!\nbody"


def test_readable_text_and_udf(spark):
    raw = "This is a line that goes\non to the next one with hyphen-\nated words\n\n[12]\n-----\nEnd.\nNew line\nthat is short"
    want = "This is a line that goes\non to the next one with hyphenated words\n\nEnd.\nNew line\nthat is short"
    other = "A first line of over twenty-five characters\ngoes on,\n  and on  here\nA HEADING\nshort\nand now a longer line again, which goes on\nto the end.\nNext"
    assert clean.batch([raw, "", other], [None] * 3).readable() == [want, "", "A first line of over twenty-five characters goes on, and on here\nA HEADING\nshort\nand now a longer line again, which goes on to the end.\nNext"]
    row = spark.createDataFrame([(raw, None), (None, "t")], "a string, b string").select(clean.cleaned("a", "b").alias("c")).collect()
    assert row[0].c.text == want and row[1].c.text == ""


def test_honorifics():
    assert clean.split_honorific("Rev. Dr. J. Smith, M.A., Esq.") == ("J. Smith", "Rev., Dr., M.A., Esq.")
    assert clean.split_honorific("Joseph Edkins") == ("Joseph Edkins", "")


def test_time_windows(spark):
    years = [1858, 1867, 1868, 1937, 1938, 1947, 1948]
    got = biblio.time_window(spark.createDataFrame([(y,) for y in years], "year int")).collect()
    assert {r.year: r.time_window for r in got} == {1858: "1858-1867", 1867: "1858-1867", 1868: "1868-1877", 1937: "1928-1937", 1938: "1938-1948", 1947: "1938-1948", 1948: "1938-1948"}


def test_years(spark):
    cases = {"1880-1882": [1880, 1881, 1882], "1880-81": [1880, 1881], "1899-01": [1899, 1900, 1901], "1880": [1880], "": []}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", scalar.expand_years("t").alias("y")).collect()
    assert {r.t: r.y for r in rows} == cases


def test_subject_parts(spark):
    cases = {"Political economy": ["political economy"], "Religion and philosophy": ["religion", "philosophy"], "History, and Geology": ["history", "geology"], "geology / history": ["geology / history"], "": ["unknown"]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", scalar.subject_parts("t").alias("p")).collect()
    assert {r.t: r.p for r in rows} == cases


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"])], "doc_id long, tokens array<string>")
    got = {r.term: r.tfidf_score for r in text.tfidf_overall(docs, min_df=1, max_df=1.0).collect()}
    assert got == pytest.approx({"a": 0.936977, "b": 0.833333, "c": 0.702733}, abs=1e-6)


@pytest.mark.parametrize("n, sizes", [(0, []), (400, [400]), (401, [400]), (449, [400]), (450, [400, 100])])
def test_chunks(spark, n, sizes):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string")
    assert [r.chunk_word_count for r in text.chunk_documents(docs).orderBy("chunk_index").collect()] == sizes


def test_ngrams_and_bigrams(spark):
    row = one(spark, text.ngrams(F.array(*map(F.lit, "xyz"))), text.bigrams(F.array(*map(F.lit, "aab"))), text.ngrams(F.array(F.lit("x")), 1, 3))
    assert row.c0 == ["x", "y", "z", "x_y", "y_z", "x_y_z"] and row.c1 == ["a b"] and row.c2 == ["x"]


def test_title_tokens(spark):
    assert one(spark, text.title_tokens(F.lit("Notes on the Yang-Tsze River's floods - an Account")))[0] == ["yangtze", "river", "floods"]


def test_diversity_by_hand(spark):
    rows = [(1, "w", "A", "a"), (2, "w", "A", "a"), (3, "w", "A", "b"), (4, "w", "B", "c")]
    frame = spark.createDataFrame(rows, "master_id long, time_window string, subject_l1 string, subject_l2 string").withColumn("subject_weight", F.lit(1.0)).withColumn("author", F.lit("x"))
    r = biblio.diversity(frame).first()
    assert (r.shannon, r.hhi, r.top3_share) == pytest.approx((1.039721, 0.375, 1.0), abs=1e-6)


def test_betweenness_by_hand(spark):
    cases = {"path": ([("A1", "S"), ("A2", "S")], {"S": 1}), "star": ([("A1", "S"), ("A2", "S"), ("A3", "S")], {"S": 3}), "cycle": ([("A1", "S1"), ("A1", "S2"), ("A2", "S1"), ("A2", "S2")], {"S1": 0.5, "S2": 0.5})}
    rows = [(w, a, s) for w, (edges, _) in cases.items() for a, s in edges]
    got = graph.betweenness(spark.createDataFrame(rows, "w string, a string, s string"), "w", "a", "s", work=4).collect()
    assert {w: {r.node: r.betweenness for r in got if r.w == w} for w in cases} == {w: x for w, (_, x) in cases.items()}


def test_betweenness_of_random_graphs(spark):
    rng, rows, want = np.random.default_rng(3), [], {}
    for w in range(6):
        pairs = sorted({(f"a{rng.integers(14)}", f"s{rng.integers(9)}") for _ in range(int(rng.integers(8, 45)))})
        rows += [(str(w), *p) for p in pairs]
        nodes = sorted({x for p in pairs for x in p})
        near = {x: {q if p == x else p for p, q in pairs if x in (p, q)} for x in nodes}
        far, paths = {}, {}
        for x in nodes:
            far[x, x], paths[x, x], front, d = 0, 1, [x], 0
            while front:
                d += 1
                new = sorted({z for y in front for z in near[y] if (x, z) not in far})
                for z in new:
                    paths[x, z] = sum(paths[x, y] for y in front if z in near[y])
                far |= {(x, z): d for z in new}
                front = new
        on = lambda v, x, y: (x, v) in far and (x, y) in far and (v, y) in far and far[x, v] + far[v, y] == far[x, y]
        for v in nodes:
            if v[0] == "s":
                want[str(w), v] = sum(paths[x, v] * paths[v, y] / paths[x, y] for x in nodes for y in nodes if len({x, y, v}) == 3 and on(v, x, y)) / 2
    frame = spark.createDataFrame(rows, "w string, a string, s string")
    for work in (50, 10**9):
        got = {(r.w, r.node): r.betweenness for r in graph.betweenness(frame, "w", "a", "s", work=work).collect()}
        assert got == pytest.approx(want)
    assert graph.betweenness(frame.limit(0), "w", "a", "s").count() == 0


def test_min_max(spark):
    for values, want in (([0, 5, 10], [0, 0.5, 1]), ([3, 3], [1, 1]), ([0, 0], [0, 0])):
        frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v int")
        assert [r.s for r in frame.select("k", scalar.min_max("v", topics.whole()).alias("s")).orderBy("k").collect()] == want


def test_match_labels(spark):
    cases = [(95, 20, False, -12, "review_year_conflict"), (60, 9, False, -12, "unmatched"), (95, 0, True, 12, "review_tied_best"), (100, 0, True, 12, "review"), (92, 5, False, 0, "high"), (84, 4, False, 12, "medium"), (70, 0, False, 0, "review"), (69, 50, False, 12, "unmatched")]
    frame = spark.createDataFrame(cases, "s int, m int, t boolean, y int, want string").withColumn("got", matching.confidence(*map(F.col, "smty")))
    assert all(r.got == r.want for r in frame.collect())


def test_language(spark):
    cases = [("", "unknown", 0.0), ("xyzzy plugh", "unknown", 0.25), ("the cat and the dog of the house are in the garden with all", "en", None), ("la maison est dans le jardin avec les enfants et le chien pour être à côté", "fr", None), ("der Hund und die Katze sind nicht mit dem Kind für das Haus über", "de", None), ("中文的文章在這裡", "zh-Hant", None)]
    rows = text.with_language(spark.createDataFrame([c[:1] for c in cases], "text string")).collect()
    for (t, want, confidence), r in zip(cases, rows):
        assert r.detected_language == want and (confidence is None or r.language_confidence == confidence), t


def test_unicode(spark):
    t = "﻿A\r\n“q” – soft­hyphen ﬁ\x00"
    assert unicode.normalize_text(t) == "A\n\"q\" - softhyphen fi"
    assert one(spark, unicode.normalize_unicode(F.lit(t)), unicode.normalize_for_match_any(F.lit("Été & Ünal")))[:] == (unicode.normalize_text(t), "ete and unal")


def test_bag_score_and_greedy_rows(spark):
    assert matching.bag_title_score(["a", "b"], ["a", "b"]) == 1.0
    assert matching.bag_title_score(["history", "of", "china"], ["history", "china"]) >= 0.94
    assert matching.bag_title_score([], ["x"]) == 0.0
    assert matching.greedy_nearest([(1, 10.0), (2, 12.0)], [(7, 11.0), (8, 100.0)]) == [(1, 7), (2, None), (None, 8)]
    rows = spark.createDataFrame([(1, "left", 1, 10.0), (1, "right", 7, 11.0), (1, "right", 8, 99.0)], "page long, side string, row_id long, y double")
    assert {(r.left_id, r.right_id) for r in matching.greedy_nearest_by_page(rows).collect()} == {(1, 7), (None, 8)}


def test_text_files_with_hidden_names(spark, tmp_path):
    for name, raw in (("_a.txt", "déjà".encode()), ("b.txt", b"caf\xe9"), ("c.txt", b"\xef\xbb\xbfbom"), ("d.csv", b"x")):
        (tmp_path / name).write_bytes(raw)
    rows = texts.read_texts(spark, f"file://{tmp_path}").orderBy("text_id").collect()
    assert [(r.text_id, r.text, r.encoding) for r in rows] == [("TXT_00001", "déjà", "utf-8-sig"), ("TXT_00002", "café", "cp1252"), ("TXT_00003", "bom", "utf-8-sig")]
    assert texts.read_texts(spark, f"file://{tmp_path}", ".none").count() == 0


def test_csv_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,n\n"q ""x"", y",NA,1\nz,N/A,\n', encoding="utf-8-sig")
    rows = texts.read_csv(spark, f"file://{tmp_path}/x.csv", "a string, b string, n int").collect()
    assert [tuple(r) for r in rows] == [('q "x", y', None, 1), ("z", None, None)]
    assert texts.read_optional_csv(spark, f"file://{tmp_path}/none.csv", "a string").schema.simpleString() == "struct<a:string>"
    assert texts.first_existing(spark, [f"file://{tmp_path}/none", f"file://{tmp_path}/x.csv"]).endswith("x.csv")
    (tmp_path / "long.csv").write_text('\ufeffa,"b, c",d\n1,"x, ""y"""\n1,2,3,4\n,N/A,z"q,q"w\n')
    rows = texts.read_csv_by_hand(spark, f"file://{tmp_path}/long.csv")
    assert rows.columns == ["a", "b, c", "d"] and [tuple(r) for r in rows.collect()] == [("1", 'x, "y"', ""), ("1", "2", "3,4"), ("", None, "zq,qw")]
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"n": "A"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}')
    assert texts.read_geojson(spark, f"file://{tmp_path}/g.json").first().properties == {"n": "A"}
    assert texts.read_geojson(spark, f"file://{tmp_path}/no.json").count() == 0
    assert texts.stopwords(["New York", "", "of"]) == {"new york", "new_york", "new", "york", "of"}


def test_pages(spark):
    t = "front\n## p. iv (#10) ####\nA\n## p. 5 (#11) ####\nB\n## p. 6 (#12) ####\nC"
    assert [(s, p) for s, p, _ in texts.page_index(t)] == [(10, "iv"), (11, "5"), (12, "6")]
    assert texts.slice_pages(t, 11, 11) == "## p. 5 (#11) ####\nB\n" and texts.slice_pages(t, 20, 30) == ""
    assert [x.seq for x in one(spark, texts.page_indexes(F.lit(t)))[0]] == [10, 11, 12]


def test_ocr_json(spark):
    word = lambda t, x: f'{{"symbols": [{{"text": "{t[0]}"}}, {{"text": "{t[1:]}"}}], "boundingBox": {{"vertices": [{{"x": {x}, "y": 1}}, {{"x": {x + 5}}}]}}}}'
    json = f'{{"fullTextAnnotation": {{"pages": [{{"blocks": [{{"paragraphs": [{{"words": [{word("ab", 1)}, {word("cd", 9)}]}}], "boundingBox": {{"vertices": [{{"x": 1, "y": 2}}, {{"x": 14, "y": 8}}]}}}}]}}]}}}}'
    frame = spark.createDataFrame([(1, json), (2, "{}")], "page_id long, json string")
    got = ocr.words(frame).orderBy("word").collect()
    assert [(r.text, tuple(r.box)) for r in got] == [("ab", (1.0, 0.0, 6.0, 1.0)), ("cd", (9.0, 0.0, 14.0, 1.0))]
    assert [(r.text, tuple(r.box)) for r in ocr.blocks(frame).collect()] == [("ab cd", (1.0, 2.0, 14.0, 8.0))]
    assert one(spark, ocr.looks_like_year(F.lit("1880-81")), ocr.looks_like_volume(F.lit("Vol. XIV")), ocr.looks_like_page(F.lit("pp. 3-9")), ocr.looks_like_year(F.lit("x")))[:] == (True, True, True, False)


def test_stream_and_batch_give_the_same_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windows.tumbling(stream, "ts", "event_type", "value", "1 day").writeStream.format("memory").queryName("windows_out").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = lambda f: sorted((r.window_start, r.event_type, r.n, round(r.total, 4)) for r in f.collect())
    assert rows(spark.table("windows_out")) == rows(windows.tumbling(events, "ts", "event_type", "value", "1 day"))


def test_append_resumes_where_it_stopped(spark, tmp_path):
    part = spark.range(5).select(F.col("id").cast("int").alias("id"))
    source, sink, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    part.write.parquet(source)
    assert windows.resume(spark, source, part.schema, sink, marks) == 5
    assert windows.resume(spark, source, part.schema, sink, marks) == 5
    part.limit(2).write.mode("append").parquet(source)
    assert windows.resume(spark, source, part.schema, sink, marks) == 7


def test_invariants(spark, sf_dir):
    rows = roles.known(spark, sf_dir)
    for r in biblio.distribution(rows, ["time_window", "subject_l2"], ["time_window"]).groupBy("time_window").agg(F.sum("share_of_articles").alias("s")).collect():
        assert r.s == pytest.approx(1)
    for r in rows.groupBy("master_id").agg(F.sum("subject_weight").alias("s")).limit(200).collect():
        assert r.s == pytest.approx(1)
    for r in biblio.diversity(rows).collect():
        assert 0 <= r.shannon <= math.log(r.n_l2) + 1e-9 and 1 / r.n_l2 - 1e-9 <= r.hhi <= 1
    for frame, key in ((relational.authors(rows), "author_id"), (relational.subjects(rows), "subject_id"), (biblio.author_nodes(rows), "node_id")):
        assert frame.count() == frame.select(key).distinct().count()


def test_small_operators(spark):
    assert one(spark, setops.with_aliases(F.lit("a"), {"a": "b"}), setops.with_aliases(F.lit("c"), {}), scalar.truthy(F.lit(" Yes ")), scalar.missing_to_null(F.lit("n/a")), scalar.safe_file_name(F.lit("a b/c?")))[:] == ("b", "c", True, None, "a_b_c")
    assert "PRIMARY KEY (`id`)" in relational.ddl(spark.createDataFrame([], "id string, n int"), "t", ("id",))
    frame = spark.createDataFrame([(k, [float(k % 2), float(1 - k % 2)]) for k in range(10)], "vec_id long, embedding array<double>")
    assert len({(r.vec_id % 2, r.cluster) for r in models.embedding_clusters(frame, 2).collect()}) == 2


def test_numbers_over_a_whole_table(spark):
    from tessera.functions.numbering import numbered

    rows = [(k * 37 % 101, "b" if k % 2 else "a") for k in range(101)] + [(None, "z"), (5, "c")]
    frame = spark.createDataFrame(rows, "k int, s string")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for buckets in (2, 16, 500):
        got = numbered(frame, "n", "k", "s", buckets=buckets).orderBy("n").collect()
        assert [r.n for r in got] == list(range(1, 104)) and [(r.k, r.s) for r in got] == want
    assert numbered(frame.limit(0), "n", "k").count() == 0


def test_export_and_metadata(spark, sf_dir, tmp_path):
    from tessera.sources import sinks

    from tessera.plans.match_queries import _place_rows

    every = sinks.export_tables(roles.expanded(spark, sf_dir).cache(), _place_rows(spark, sf_dir))
    assert len(every) == 27
    tables = {n: t for n, t in every.items() if n in ("articles", "article_subjects", "subjects", "time_windows", "subject_diversity_stats", "network_nodes", "title_term_time_stats", "title_bigram_time_stats", "title_tfidf_time_stats", "title_term_subject_time_stats", "article_title_terms", "title_place_time_stats", "title_place_subject_time_stats", "article_title_places", "title_place_name_mapping")}
    ddl = sinks.export(spark, tables, f"file://{tmp_path}/out")
    assert ddl.count("CREATE TABLE") == 15 and "PRIMARY KEY (`master_id`, `subject_id`)" in ddl
    for name, (_, key) in tables.items():
        written = spark.read.parquet(f"file://{tmp_path}/out/{name}")
        assert written.count() == written.select(*key).distinct().count() > 0, name
    frame = spark.createDataFrame([(" ", "T", "x"), ("1", "U", None)], "master_id string, matched_title string, `L1 subject` string")
    assert [(r.master_id, r.title, r.L1, r.year) for r in sinks.by_alias(frame).collect()] == [(None, "T", "x", None), ("1", "U", None, None)]
    assert sinks.existing(frame, ["no", "L1 subject"]).columns == ["L1 subject"] and sinks.ordered(frame, ["L1 subject", "no"]).columns[0] == "L1 subject"
    ids = spark.range(4)
    sinks.append_rows(ids.limit(2), f"file://{tmp_path}/rows", "id")
    sinks.append_rows(ids, f"file://{tmp_path}/rows", "id")
    assert spark.read.parquet(f"file://{tmp_path}/rows").count() == 4
    sinks.write_csv(spark.createDataFrame([('a "q"', 1)], "s string, n int"), f"file://{tmp_path}/csv")
    assert texts.read_csv(spark, f"file://{tmp_path}/csv", "s string, n int").first().s == 'a "q"'


def test_reconciled_titles_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = "history of china notes on the rivers north coast trade silk routes journey".split()
    title = lambda: [str(w) for w in rng.choice(words, size=int(rng.integers(1, 6)))]
    left = [(k, sorted({int(y) for y in rng.integers(1870, 1876, 2)}), title()) for k in range(40)] + [(90, [1800], ["history"]), (91, [1871], [])]
    right = [(k, sorted({int(y) for y in rng.integers(1870, 1876, 2)}), title()) for k in range(60)]
    got = matching.reconcile(spark.createDataFrame(left, "l_id int, l_years array<int>, a array<string>"), spark.createDataFrame(right, "r_id int, r_years array<int>, b array<string>")).collect()
    assert len(got) == len(left)
    for r in got:
        _, years, a = left[[x[0] for x in left].index(r.l_id)]
        best = min(((-round(matching.bag_title_score(a, b), 9), k) for k, ys, b in right if set(ys) & set(years)), default=None)
        if best is None:
            assert (r.r_id, r.score, r.match_status) == (None, None, "no_year_candidate")
        else:
            status = "accepted" if -best[0] >= 0.92 and len(set(a)) >= 2 else "review" if -best[0] >= 0.82 and len(set(a)) >= 3 else "manual"
            assert (r.r_id, r.match_status) == (best[1], status) and r.score == pytest.approx(-best[0])


def test_greedy_rows_of_the_query(spark, sf_dir):
    from tessera.plans import catalog

    events = [r for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect() if r.event_type in ("click", "view")]
    want = set()
    for user in {r.user_id for r in events}:
        side = lambda t: sorted((r.ts.timestamp(), r.event_id) for r in events if r.user_id == user and r.event_type == t)
        free = side("view")
        for y, k in side("click"):
            near = sorted((abs(x - y), j, x) for x, j in free)
            if near and near[0][0] <= 7200:
                want.add((user, k, near[0][1]))
                free.remove((near[0][2], near[0][1]))
            else:
                want.add((user, k, None))
        want |= {(user, None, j) for _, j in free}
    assert {tuple(r) for r in catalog.queries()["greedy_nearest"](spark, sf_dir).collect()} == want


def themes(spark, n=60):
    rng = np.random.default_rng(2)
    words = [[f"{t}{k}" for k in range(8)] for t in "abc"]
    docs = [(d, [str(w) for w in rng.choice(words[d % 3], size=30)]) for d in range(n)]
    return spark.createDataFrame(docs, "doc_id long, tokens array<string>"), words


def test_topic_models_find_the_themes(spark):
    docs, words = themes(spark)
    terms = text.doc_terms(text.term_rows(docs)).select("doc_id", "term", (F.col("tf") / F.col("doc_len")).alias("value"))
    for rows in (models.lda_topics(docs, k=3, iterations=40, words=8), models.nmf_topics(terms, sorted(w for own in words for w in own), k=3, iterations=40, words=8)):
        topics_ = {}
        for r in rows.collect():
            topics_.setdefault(r.topic_id, set()).add(r.word)
        assert sorted(map(sorted, topics_.values())) == sorted(map(sorted, words))


def test_factorisation_error_falls(spark):
    docs, _ = themes(spark, 30)
    terms = text.doc_terms(text.term_rows(docs)).select("doc_id", "term", (F.col("tf") / F.col("doc_len")).alias("value"))
    rows = terms.collect()
    names = sorted({r.term for r in rows})
    x = np.zeros((30, len(names)))
    for r in rows:
        x[r.doc_id, names.index(r.term)] = r.value
    errors = []
    for n in (1, 5, 25):
        h = np.zeros((3, len(names)))
        for r in models.nmf_topics(terms, names, k=3, iterations=n, words=len(names)).collect():
            h[r.topic_id, names.index(r.word)] = r.weight
        w = np.full((30, 3), 1 / 3)
        for _ in range(200):
            w *= (x @ h.T) / (w @ (h @ h.T) + 1e-9)
        errors.append(float(((x - w @ h) ** 2).sum()))
    assert errors[0] > errors[1] > errors[2]


def test_vectors_are_in_the_cluster_of_the_nearest_centre(spark, sf_dir):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    found = {r.vec_id: r.cluster for r in models.embedding_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 6).collect()}
    unit = lambda v: v / np.linalg.norm(v)
    centres = {c: unit(np.mean([unit(rows[k]) for k, x in found.items() if x == c], axis=0)) for c in set(found.values())}
    nearest = [max(centres, key=lambda c: float(unit(v) @ centres[c])) == found[k] for k, v in rows.items()]
    assert np.mean(nearest) > 0.9 and found.keys() == rows.keys()
