"""License rules against all regexes on all texts: neither a gate nor keywords."""

import random
import re
from re import _parser as parser

from tessera.llm import licenses

MISSED = {
    1: ("Available under GPLv3", "gpl"),
    2: ("It was published under the Apache 2.0", "apache"),
    3: ("LGPL 2.1", "lgpl"),
    4: ("see MPL 2.0 for more", "mpl"),
    5: ("FreeBSD license", "bsd-2"),
    6: ("Creative Commons Attribution-Non-Commercial 4.0", "cc-by-nc"),
    7: ("governed by the conditions of the EUPL 1.2", "eupl"),
    8: ("no rule, mit dem", ""),
}


def example(rng, parsed):
    """A random match of a parsed regular expression."""
    out = ""
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN":
                out += rng.choice([chr(v) for _, v in arg])
            case "NOT_LITERAL":
                out += "x"
            case "MAX_REPEAT":
                out += "".join(example(rng, arg[2]) for _ in range(rng.randint(arg[0], min(int(arg[1]), 3))))
            case "SUBPATTERN":
                out += example(rng, arg[3])
            case "BRANCH":
                out += example(rng, rng.choice(arg[1]))
            case other:
                raise ValueError(other)
    return out


def all_labels(text, rules):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    found = [(words[: m.start()].count(" ") - 1, words[: m.end()].count(" "), r.priority, k, r.label) for k, r in enumerate(rules) for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", words)]
    inside = lambda x, y: y[0] <= x[0] and y[1] >= x[1] and (y[2] > x[2] or y[2] == x[2] and (y[1] - y[0] > x[1] - x[0] or (y[0], y[1]) == (x[0], x[1]) and y[3] < x[3]))
    base = {label for phrase, label in licenses.BASE if f" {phrase} " in words}
    return {x[4] for x in found if not any(inside(x, y) for y in found)} | base


def test_keywords_are_in_every_match():
    rng = random.Random(3)
    for r in licenses.built_in_rules():
        parsed = parser.parse(r.regex)
        for _ in range(100):
            text = f" {example(rng, parsed)} "
            assert re.search(f"(?<= )(?:{r.regex})(?= )", text) and r.keyword in text, (r, text)


def test_rules_without_gate_words(spark):
    rules, rng = licenses.built_in_rules(), random.Random(4)
    texts = {k: t for k, (t, _) in MISSED.items()} | {100 + k: f"a {example(rng, parser.parse(r.regex))} b" for k, r in enumerate(rules)}
    rows = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    got = {r.doc_id: r.labels for r in rows}
    assert {k: got[k] for k in MISSED} == {k: label for k, (_, label) in MISSED.items()}
    for k, text in texts.items():
        assert set(filter(None, got[k].split(","))) == all_labels(text, rules), text


def test_query_without_gate_words(spark, sf_dir):
    rules = licenses.built_in_rules()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in licenses.op3_signature_rules(spark, sf_dir).collect():
        assert set(filter(None, r.labels.split(","))) == all_labels(texts[r.doc_id], rules)
