import re

from pyspark.sql import functions as F

from tessera.llm import licenses

TEXTS = [
    (1, "Released under the MIT License."),
    (2, "Licensed under the Apache License, Version 2.0. MIT license; mit LICENSE"),
    (3, "the GNU General Public License, version 3 general public license"),
    (4, "Licensed under CC BY-NC 4.0."),
    (5, None),
    (6, ""),
    (7, "...,;!"),
    (8, "nothing here"),
    (9, "mit license mit license"),
    (10, "émit license mıt license É1 ünd"),
    (11, "SPDX-License-Identifier: BSD-3-Clause"),
    (13, "This is not licensed under the BSD license; it is released into the public domain."),
    (14, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (15, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, with Classpath exception"),
    (16, "SPDX-License-Identifier: Foo-1.0"),
    (17, "İstanbul ICU LİCENSE, the icu license"),
    (12, "dual licensed: under the terms of the Mozilla Public License version 2.0 or GNU Lesser General Public License v2.1"),
]


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def brute_labels(text, rules):
    """All matches of all rules, then suppression pair by pair."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    found = [(words[: m.start()].count(" ") - 1, words[: m.end()].count(" "), r.priority, k, r.label) for k, r in enumerate(rules) for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", words)]
    inside = lambda x, y: y[0] <= x[0] and y[1] >= x[1] and (y[2] > x[2] or y[2] == x[2] and (y[1] - y[0] > x[1] - x[0] or (y[0], y[1]) == (x[0], x[1]) and y[3] < x[3]))
    return {x[4] for x in found if not any(inside(x, y) for y in found)}


def compare(rows, texts):
    rules = licenses.built_in_rules()
    assert len(rules) > 250 and len({r.regex for r in rules}) == len(rules) and {r.priority for r in rules} == set(licenses.STRENGTH)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.labels.split(","))) == brute_labels(texts[r.doc_id], rules) | set(filter(None, want[4].split(",")))
        assert 0 <= r.score <= 1


def test_against_brute_force(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("labels", F.lit("clash"))
    rows = licenses.scan(frame).collect()
    compare(rows, dict(TEXTS))
    by = {r.doc_id: r for r in rows}
    assert by[4].labels == "cc-by-nc" and by[11].labels == "bsd-3" and by[12].labels == "dual,gpl,lgpl,mpl"
    assert by[13].labels == "not-licensed,public-domain" and by[14].labels == "mit" and by[15].labels == "exception-classpath,gpl" and by[16].labels == "unknown-license" and by[17].labels == "icu"
    assert (by[11].score, by[13].score, by[14].score, by[8].score) == (1.0, 0.8, 0.8, 0.0)
    assert licenses.scan(frame.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = licenses.op3_signature_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    compare(rows, texts)


def test_no_python_and_no_shuffle(spark, sf_dir):
    plan = licenses.op3_signature_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Pandas|Arrow", plan)
