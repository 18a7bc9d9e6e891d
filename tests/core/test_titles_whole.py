"""Title matching against the scores of every title for every text."""

import random
import re

from tessera.operators import matching

WORDS = "river stone amber night harbour winter music paper garden iron ox by art sea".split()


def norm(text):
    return re.sub("[^a-z0-9]+", " ", (text or "").lower().replace("&", " and ")).strip()


def brute(texts, titles, preselect=18, top=5):
    out = set()
    for doc, text, year in texts:
        head = (text or "")[:8000]
        whole, tokens_in = norm(head), set(norm(head).split())
        lines = [norm(x).split() for x in head.split("\n") if x.strip()][:45]
        windows = [set(a) | set(b) for a, b in zip(lines, [*lines[1:], []])]
        rows = []
        for master, title, of in titles:
            t, bonus = norm(title), 0 if year is None else 12 if year == of else -12
            tokens = [x for x in t.split() if len(x) > 2]
            part = lambda w: sum(x in w for x in tokens) / len(tokens) if tokens else 0.0
            local = max(map(part, windows), default=0.0)
            inside = t != "" and t in whole
            cheap = 100.0 if inside else round(part(tokens_in) * 75.0, 2)
            full = 100.0 if inside else 92.0 if local >= 0.99 else round(max(part(tokens_in) * 75.0, local * 85.0), 2)
            rows.append((-(cheap + bonus), master, full, bonus))
        kept = sorted((-(full + bonus), master, full, bonus) for _, master, full, bonus in sorted(rows)[:preselect])[:top]
        out |= {(doc, master, k + 1, full, bonus, -c) for k, (c, master, full, bonus) in enumerate(kept)}
    return out


def match(spark, texts, titles):
    return matching.match_titles(spark.createDataFrame(texts, "doc_id long, text string, year long"), spark.createDataFrame(titles, "master_id long, title string, title_year long"))


def test_every_title_counts(spark):
    rng = random.Random(7)
    titles = [(k, " ".join(rng.choices(WORDS, k=rng.randint(1, 7))), rng.choice([1995, 1996, 1997, None])) for k in range(70)]
    titles += [(200, "art", 1995), (201, "by ox", 1996), (202, "", 1996), (203, None, 1997), (204, "tone nigh", 1997), (205, "lonely", 2001)]
    texts = [(k, "\n".join(" ".join(rng.choices(WORDS + ["zebra", "quill"], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 4))), rng.choice([1995, 1996, 1997, None, 2001])) for k in range(40)]
    texts += [(100, "zebra hearts quill", 1995), (101, "nothing shared", 1996), (102, "", 1997), (103, None, None), (104, "baby oxen", 1995), (105, "stone night", 2001)]
    got = match(spark, texts, titles)
    assert {tuple(r) for r in got.select("doc_id", "master_id", "rank", "title_score", "year_bonus", "combined_score").collect()} == brute(texts, titles)


def test_texts_that_share_no_token_have_a_label(spark):
    titles = [(k, f"title number{k} amber", 1990 + k) for k in range(9)]
    ranked = match(spark, [(1, "nothing else", 1992)], titles).cache()
    assert ranked.count() == 5
    assert [(r.master_id, r.match_confidence) for r in matching.match_labels(ranked).collect()] == [(2, "unmatched")]


def test_blocks_of_titles_give_the_same_rows(spark):
    rng = random.Random(8)
    titles = [(k, " ".join(rng.choices(WORDS, k=rng.randint(1, 7))), rng.choice([1995, 1996, None])) for k in range(90)]
    texts = [(k, " ".join(rng.choices(WORDS, k=30)), rng.choice([1995, None])) for k in range(20)]
    frames = spark.createDataFrame(texts, "doc_id long, text string, year long"), spark.createDataFrame(titles, "master_id long, title string, title_year long")
    assert {tuple(r) for r in matching.match_titles(*frames, block_chars=900).collect()} == brute(texts, titles)
    assert matching.match_titles(frames[0], frames[1].limit(0)).count() == 0
