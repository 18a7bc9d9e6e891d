"""Queries of joins, places, sets and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import matching, places, setops
from tessera.plans.biblio_queries import rounded
from tessera.plans.catalog import register
from tessera.plans.roles import articles, subjects, table, with_articles, with_expanded
from tessera.plans.text_queries import _NORM
from tessera.streaming import windows


@register(
    "master_left_joins",
    """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS lines FROM lineitem GROUP BY ALL)
SELECT l.*, o_orderstatus, p_brand, s_name, n_name FROM l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey""",
)
def master_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("lines"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    out = lines.join(orders, "l_orderkey", "left").join(part, "l_partkey", "left").join(supplier, "l_suppkey", "left").join(nation, "s_nationkey", "left")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "lines", "o_orderstatus", "p_brand", "s_name", "n_name")


@register("alias_map", "SELECT n_nationkey, CASE n_name WHEN 'CHINA' THEN 'Zhongguo' WHEN 'JAPAN' THEN 'Nippon' ELSE n_name END AS name FROM nation")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", setops.with_aliases(F.col("n_name"), {"CHINA": "Zhongguo", "JAPAN": "Nippon"}).alias("name"))


@register("unmatched_metadata_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def unmatched_metadata_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "orders").where("o_orderpriority IN ('1-URGENT', '2-HIGH')").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(good, "c_custkey", "left_anti")


@register("resume_anti_join", "SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return setops.remaining(events, events.where("event_type = 'click'"), "event_id").select("event_id", "user_id")


@register("containment_join", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item_text"))


_MATCH = f"""WITH h AS (SELECT doc_id, 1995 + doc_id % 5 AS year, substr(text, 1, 8000) AS head, {_NORM.format('substr(text, 1, 8000)')} AS head_norm FROM documents),
m AS (SELECT item_id AS master_id, 1995 + item_id % 5 AS title_year, {_NORM.format('text')} AS title_norm, list_filter(string_split({_NORM.format('text')}, ' '), lambda t: length(t) > 2) AS tokens FROM benchmark),
c AS (SELECT doc_id, master_id, count(*) / any_value(n) AS coverage FROM (SELECT DISTINCT doc_id, unnest(string_split(head_norm, ' ')) AS token FROM h) JOIN (SELECT master_id, unnest(tokens) AS token, len(tokens) AS n FROM m) USING (token) GROUP BY ALL),
p AS (SELECT *, coalesce(c0, 0.0) AS coverage, title_norm <> '' AND contains(head_norm, title_norm) AS inside, CASE WHEN year = title_year THEN 12 ELSE -12 END AS year_bonus FROM (SELECT h.*, m.* FROM h, m) LEFT JOIN (SELECT doc_id, master_id, coverage AS c0 FROM c) USING (doc_id, master_id)),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (CASE WHEN inside THEN 100.0::DOUBLE ELSE round_even(coverage * 75.0::DOUBLE, 2) END) + year_bonus DESC, master_id) AS n FROM p QUALIFY n <= 18),
l AS (SELECT *, list_transform(list_filter(string_split(head, chr(10)), lambda x: trim(x, ' ') <> '')[1:45], lambda x: string_split({_NORM.format('x')}, ' ')) AS lines FROM q),
s AS (SELECT *, coalesce(list_max(list_transform(range(1, len(lines) + 1), lambda i: len(list_filter(tokens, lambda t: list_contains(flatten(lines[i:i + 1]), t))) / nullif(len(tokens), 0))), 0) AS best FROM l),
f AS (SELECT doc_id, master_id, year_bonus, CASE WHEN inside THEN 100.0::DOUBLE WHEN best >= 0.99 THEN 92.0::DOUBLE ELSE round_even(greatest(coverage * 75.0::DOUBLE, best * 85.0::DOUBLE), 2) END AS title_score FROM s),
top AS (SELECT *, title_score + year_bonus AS combined_score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY title_score + year_bonus DESC, master_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 5)
"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 5 + 1995).alias("year"))
    titles = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("master_id"), F.col("text").alias("title"), (F.col("item_id") % 5 + 1995).alias("title_year"))
    return matching.match_titles(texts, titles)


@register("title_match_top5", _MATCH + "SELECT doc_id, master_id, rank, round(title_score, 2) AS title_score, year_bonus, round(combined_score, 2) AS combined_score FROM top")
def title_match_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ranked(spark, sf_dir), "title_score", "combined_score", digits=2)


@register(
    "title_match_label",
    _MATCH
    + """, w AS (SELECT *, lead(title_score) OVER x AS s2, lead(combined_score) OVER x AS c2 FROM top WINDOW x AS (PARTITION BY doc_id ORDER BY rank)),
b AS (SELECT doc_id, master_id, title_score, title_score - coalesce(s2, 0) AS margin, year_bonus, coalesce(abs(combined_score - c2) < 0.01, false) AS tied FROM w WHERE rank = 1)
SELECT doc_id, master_id, round(title_score, 2) AS title_score, round(margin, 2) AS margin, year_bonus, CASE WHEN year_bonus < 0 THEN CASE WHEN title_score >= 70 THEN 'review_year_conflict' ELSE 'unmatched' END WHEN tied AND title_score < 100 THEN 'review_tied_best'
 WHEN title_score >= 92 AND margin >= 5 THEN 'high' WHEN title_score >= 84 AND margin >= 4 THEN 'medium' WHEN title_score >= 70 THEN 'review' ELSE 'unmatched' END AS match_confidence FROM b""",
)
def title_match_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matching.match_labels(_ranked(spark, sf_dir)), "title_score", "margin", digits=2)


_SIDES = """l AS (SELECT p_partkey AS l_id, p_size AS y0, string_split(p_name, ' ') AS a, p_size % 3 AS span FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_partkey AS r_id, p_size AS y0, string_split(p_name, ' ') AS b FROM part WHERE p_partkey % 2 = 1)"""


@register(
    "year_overlap_best_match",
    f"""WITH {_SIDES}, p AS (SELECT l_id, r_id, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS score FROM l JOIN r ON r.y0 BETWEEN l.y0 AND l.y0 + l.span)
SELECT l_id, r_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY round(score, 9) DESC, r_id) AS n FROM p) WHERE n = 1""",
)
def year_overlap_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    left = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_id"), F.sequence("p_size", F.col("p_size") + F.col("p_size") % 3).alias("l_years"), F.split("p_name", " ").alias("a"))
    right = part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("r_id"), F.array("p_size").alias("r_years"), F.split("p_name", " ").alias("b"))
    return rounded(matching.year_overlap_best(left, right, matching.token_f1(F.col("a"), F.col("b"))), "score")


@register("multiset_overlap", "WITH x AS (SELECT page_id, unnest(list_filter(regexp_extract_all(url, '[a-z]+'), lambda t: length(t) > 1)) AS t FROM pages), c AS (SELECT page_id, t, count(*) AS n FROM x GROUP BY ALL) SELECT a.page_id, b.page_id AS other_id, CAST(sum(least(a.n, b.n)) AS BIGINT) AS common FROM c a JOIN c b ON a.t = b.t AND b.page_id = a.page_id + 1 GROUP BY ALL")
def multiset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.filter(F.regexp_extract_all("url", F.lit("[a-z]+"), 0), lambda t: F.length(t) > 1)
    bags = table(spark, sf_dir, "pages").select("page_id", F.explode(tokens).alias("t"))
    return setops.multiset_overlap(bags, bags.withColumn("page_id", F.col("page_id") - 1), "page_id", "t").select("page_id", (F.col("page_id") + 1).alias("other_id"), "common")


@register(
    "zip_full_outer",
    """WITH a AS (SELECT user_id, event_id AS left_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS position FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id AS right_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS position FROM events WHERE event_type = 'view')
SELECT user_id, position, left_id, right_id, CASE WHEN left_id IS NULL THEN 'missing_left' WHEN right_id IS NULL THEN 'missing_right' ELSE '' END AS reason FROM a FULL JOIN b USING (user_id, position)""",
)
def zip_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    side = lambda kind, name: events.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name))
    return matching.zip_rows(side("click", "left_id"), side("view", "right_id"), ["user_id"], "left_id", "right_id").select("user_id", "position", "left_id", "right_id", "reason")


@register(
    "nearest_join",
    """WITH a AS (SELECT event_id AS left_id, user_id, epoch(ts) AS x FROM events WHERE event_type = 'click'), b AS (SELECT event_id AS right_id, user_id, epoch(ts) AS y FROM events WHERE event_type = 'view'),
p AS (SELECT left_id, right_id, abs(x - y) AS d FROM a JOIN b ON a.user_id = b.user_id AND abs(x - y) <= 7200 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY abs(x - y), right_id) = 1)
SELECT left_id, right_id, round(d, 3) AS distance FROM a LEFT JOIN p USING (left_id)""",
)
def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    side = lambda kind, name, at: events.where(F.col("event_type") == kind).select(F.col("event_id").alias(name), "user_id", F.col("at").alias(at))
    return rounded(matching.nearest(side("click", "left_id", "x"), side("view", "right_id", "y"), "user_id", "x", "y", 7200.0), "distance", digits=3)


# Places: nations of the customers as modern names, old names by the order.

_PLACES = (
    ", pl AS (SELECT art.master_id, time_window, n_name AS modern_name, CASE art.master_id % 3 WHEN 0 THEN 'Old ' || n_name WHEN 1 THEN n_name ELSE 'Former ' || n_name END AS historical_name, r_name FROM art JOIN orders ON o_orderkey = art.master_id JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"
)


def _place_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans.biblio_queries import expanded_articles

    rows = expanded_articles(spark, sf_dir).select("master_id", "time_window")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("master_id"), F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("modern_name"), F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    old = F.when(F.col("master_id") % 3 == 0, F.concat(F.lit("Old "), "modern_name")).when(F.col("master_id") % 3 == 1, F.col("modern_name")).otherwise(F.concat(F.lit("Former "), "modern_name"))
    return rows.join(orders, "master_id").join(customer, "c_custkey").join(nation, "n_nationkey").join(region, "r_regionkey").withColumn("historical_name", old)


def _place_sql(keys: str, source: str = "pl") -> str:
    first = keys.split(",")[0]
    return f""", c AS (SELECT {keys}, modern_name, count(*) AS count, count(DISTINCT master_id) AS article_count, string_agg(DISTINCT historical_name, '; ' ORDER BY historical_name) AS historical_names,
 modern_name || coalesce('（' || string_agg(DISTINCT historical_name, '; ' ORDER BY historical_name) FILTER (lower(historical_name) <> lower(modern_name)) || '）', '') AS place_label FROM {source} GROUP BY {keys}, modern_name),
d AS (SELECT place_label, count(DISTINCT {first}) AS df FROM c GROUP BY 1)
SELECT c.*, round(count / sum(count) OVER (PARTITION BY {first}), 6) AS share, df, round(ln((1 + w) / (1 + df)) + 1, 6) AS idf, round(count * (ln((1 + w) / (1 + df)) + 1), 6) AS tfidf FROM c JOIN d USING (place_label), (SELECT count(DISTINCT {first}) AS w FROM c)"""


@register("place_time", with_articles(_PLACES + _place_sql("time_window")))
def place_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(places.place_counts(_place_rows(spark, sf_dir), "time_window"), "share", "idf", "tfidf")


@register("place_subject_time", with_expanded(_PLACES + ", ps AS (SELECT pl.*, subject_l1, subject_l2 FROM pl JOIN (SELECT DISTINCT master_id, subject_l1, subject_l2 FROM known) USING (master_id))" + _place_sql("time_window, subject_l1, subject_l2", "ps")))
def place_subject_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.biblio import known_subjects

    # The articles are in the place rows; the subjects need no second table of them.
    return rounded(places.place_counts(_place_rows(spark, sf_dir).join(known_subjects(subjects(spark, sf_dir)), "master_id"), "time_window", "subject_l1", "subject_l2"), "share", "idf", "tfidf")


@register("place_rollup", with_articles(_PLACES + " SELECT 'place' AS level, modern_name AS name, count(*) AS count, string_agg(DISTINCT time_window, ',' ORDER BY time_window) AS windows FROM pl GROUP BY modern_name UNION ALL SELECT 'province', r_name, count(*), string_agg(DISTINCT time_window, ',' ORDER BY time_window) FROM pl GROUP BY r_name"))
def place_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.rollup(_place_rows(spark, sf_dir), "modern_name", "r_name", "time_window")


@register("page_places", with_articles(_PLACES + ", c AS (SELECT time_window, modern_name, count(*) AS n FROM pl GROUP BY ALL), d AS (SELECT modern_name, count(DISTINCT time_window) AS df FROM c GROUP BY 1) SELECT modern_name, round(sum(n * (ln((1 + w) / (1 + df)) + 1)), 6) AS weight FROM c JOIN d USING (modern_name), (SELECT count(DISTINCT time_window) AS w FROM c) GROUP BY modern_name ORDER BY round(weight, 9) DESC, modern_name LIMIT 26"))
def page_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.relational import top_by_sum
    from tessera.operators.text import count_tfidf

    counts = _place_rows(spark, sf_dir).groupBy("time_window", "modern_name").agg(F.count("*").alias("n"))
    return rounded(top_by_sum(count_tfidf(counts, "modern_name", "time_window", "n"), "modern_name", "tfidf", 26), "weight")


@register("gazetteer_match", "SELECT p_partkey, g.name FROM part JOIN (SELECT DISTINCT string_split(p_name, ' ')[2] AS name FROM part WHERE p_partkey % 2 = 0) g ON contains(' ' || lower(p_name) || ' ', ' ' || lower(g.name) || ' ')")
def gazetteer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.where("p_partkey % 2 = 0").select(F.split("p_name", " ")[1].alias("name")).distinct()
    return places.mentions(part, names, "p_partkey", "p_name")


# Streams run over the whole table and end: an extension beyond batch work.


@register("events_tumbling_window", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.tumbling(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 day")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("articles_by_year", with_articles("SELECT year, count(*) AS n FROM art GROUP BY year"))
def articles_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"))


@register("first_present", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_brand ELSE p_type END AS name FROM part")
def first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("  ")
    b = F.when(F.col("p_size") % 3 == 1, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.first_present(a, b, "p_type").alias("name"))
