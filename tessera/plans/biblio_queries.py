"""Bibliometric queries over the role tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import biblio, relational
from tessera.plans.catalog import register
from tessera.plans.roles import expanded, known, table, titles, windowed_items, with_articles, with_expanded


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@register("scan_filter_project", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_totalprice", "o_orderpriority")


@register("known_subject_filter", with_expanded("SELECT master_id, subject_l1, subject_l2 FROM known"))
def known_subject_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known(spark, sf_dir).select("master_id", "subject_l1", "subject_l2")


@register("network_filter", with_expanded("SELECT master_id, author, subject_l2 FROM known WHERE time_window = '1997-1998' AND subject_l1 LIKE 'P%' AND (contains(lower(author), '1') OR contains(lower(subject_l2), 'brand#2') OR contains(lower(title), 'the'))"))
def network_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.page_filter(known(spark, sf_dir), window="1997-1998", l1_prefix="P", needles={"author": "1", "subject_l2": "brand#2", "title": "the"}).select("master_id", "author", "subject_l2")


@register(
    "review_queue",
    with_expanded("""SELECT master_id, subject_l2 AS item, 'unknown_subject' AS reason FROM expanded WHERE subject_l2 = 'Unknown'
UNION ALL SELECT master_id, author AS item, 'many_subjects' AS reason FROM (SELECT DISTINCT master_id, author, n_subjects_article_all FROM expanded) WHERE n_subjects_article_all >= 6"""),
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expanded(spark, sf_dir)
    one = rows.where("subject_l2 = 'Unknown'").select("master_id", F.col("subject_l2").alias("item"), F.lit("unknown_subject").alias("reason"))
    many = rows.where("n_subjects_article_all >= 6").select("master_id", F.col("author").alias("item"), F.lit("many_subjects").alias("reason")).distinct()
    return one.unionByName(many)


@register("time_window_assign", with_articles("SELECT master_id, year, window_start, window_end, time_window FROM art"))
def time_window_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded_articles(spark, sf_dir).select("master_id", "year", "window_start", "window_end", "time_window")


@register("subject_weight", with_expanded("SELECT master_id, subject_l2, n_subjects_article_all, n_subjects_article_network, round(subject_weight, 6) AS subject_weight FROM expanded"))
def subject_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(expanded(spark, sf_dir).select("master_id", "subject_l2", "n_subjects_article_all", "n_subjects_article_network", "subject_weight"), "subject_weight")


_DISTRIBUTION = "round(sum(subject_weight), 6) AS weighted_article_count, count(DISTINCT master_id) AS article_count, count(DISTINCT author) AS author_count, min(year) AS first_year, max(year) AS last_year"


@register("subject_distribution_all", with_expanded(f"SELECT subject_l1, subject_l2, {_DISTRIBUTION}, round(sum(subject_weight) / sum(sum(subject_weight)) OVER (), 6) AS share_of_articles FROM known GROUP BY subject_l1, subject_l2"))
def subject_distribution_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(biblio.distribution(known(spark, sf_dir), ["subject_l1", "subject_l2"]), "weighted_article_count", "share_of_articles")


@register(
    "subject_distribution_window",
    with_expanded(f"SELECT time_window, subject_l1, subject_l2, {_DISTRIBUTION}, round(sum(subject_weight) / sum(sum(subject_weight)) OVER (PARTITION BY time_window), 6) AS share_of_articles FROM known GROUP BY time_window, subject_l1, subject_l2"),
)
def subject_distribution_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(biblio.distribution(known(spark, sf_dir), ["time_window", "subject_l1", "subject_l2"], ["time_window"]), "weighted_article_count", "share_of_articles")


@register("subject_share_by_window", with_expanded("SELECT time_window, subject_l2, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY time_window), 6) AS share FROM known GROUP BY time_window, subject_l2"))
def subject_share_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(biblio.with_share(known(spark, sf_dir).groupBy("time_window", "subject_l2").agg(F.count("*").alias("n")), "n", ["time_window"]), "share")


_BY_TIME = "round(sum(subject_weight), 6) AS weighted_article_count, count(DISTINCT master_id) AS article_count, count(DISTINCT author) AS author_count, round(sum(subject_weight) / sum(sum(subject_weight)) OVER (PARTITION BY time_window), 6) AS share_of_window"


@register("subject_l1_time", with_expanded(f"SELECT time_window, subject_l1, {_BY_TIME}, count(DISTINCT subject_l2) AS l2_count FROM known GROUP BY time_window, subject_l1"))
def subject_l1_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(biblio.level_by_time(known(spark, sf_dir), "subject_l1"), "weighted_article_count", "share_of_window")


@register("subject_l2_time", with_expanded(f"SELECT time_window, subject_l1, subject_l2, {_BY_TIME} FROM known GROUP BY time_window, subject_l1, subject_l2"))
def subject_l2_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(biblio.level_by_time(known(spark, sf_dir), "subject_l2"), "weighted_article_count", "share_of_window")


@register(
    "subject_diversity",
    with_expanded("""SELECT time_window, round(sum(w), 6) AS total_weighted, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS shannon, round(sum(p * p), 6) AS hhi,
  round(sum(CASE WHEN r <= 3 THEN p ELSE 0 END), 6) AS top3_share, round(sum(CASE WHEN r <= 5 THEN p ELSE 0 END), 6) AS top5_share,
  count(DISTINCT subject_l1) AS n_l1, count(DISTINCT subject_l2) AS n_l2, CAST(sum(n) AS BIGINT) AS article_count, any_value(d) AS distinct_article_count
FROM (SELECT *, row_number() OVER (PARTITION BY time_window ORDER BY p DESC, subject_l2) AS r FROM (
  SELECT time_window, subject_l1, subject_l2, sum(subject_weight) AS w, count(DISTINCT master_id) AS n, sum(subject_weight) / sum(sum(subject_weight)) OVER (PARTITION BY time_window) AS p FROM known GROUP BY time_window, subject_l1, subject_l2))
JOIN (SELECT time_window, count(DISTINCT master_id) AS d FROM known GROUP BY 1) USING (time_window) GROUP BY time_window"""),
)
def subject_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(biblio.diversity(known(spark, sf_dir)), "total_weighted", "shannon", "hhi", "top3_share", "top5_share")


@register("subject_degree", with_expanded("SELECT time_window, subject_l1, subject_l2, round(sum(subject_weight), 6) AS strength, count(DISTINCT author) AS degree, count(DISTINCT master_id) AS article_count FROM known GROUP BY ALL"))
def subject_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(biblio.subject_degree(known(spark, sf_dir)), "strength")


@register("dedupe_first", with_expanded("SELECT author, subject_l2, master_id FROM (SELECT *, row_number() OVER (PARTITION BY author, subject_l2 ORDER BY pos) AS r FROM expanded) WHERE r = 1"))
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biblio.dedupe_first(expanded(spark, sf_dir), ["author", "subject_l2"], ["pos"]).select("author", "subject_l2", "master_id")


@register(
    "collapse_metadata",
    with_expanded("""SELECT master_id, min_by(author, pos) AS author, min_by(title, pos) AS title, min_by(year, pos) AS year,
  (SELECT string_agg(subject_l1, ' | ' ORDER BY p) FROM (SELECT subject_l1, min(pos) AS p FROM expanded y WHERE y.master_id = x.master_id GROUP BY subject_l1)) AS subject_l1_list,
  string_agg(subject_l2, ' | ' ORDER BY pos) AS subject_l2_list, string_agg(subject_l2 || ':' || printf('%.4f', subject_weight), ' | ' ORDER BY pos) AS subject_weights, count(*) AS metadata_row_count
FROM expanded x GROUP BY master_id"""),
)
def collapse_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biblio.collapse_metadata(expanded(spark, sf_dir), "pos")


@register("author_stats", with_expanded("SELECT author, count(DISTINCT master_id) AS article_count, count(DISTINCT subject_l2) FILTER (subject_l2 <> 'Unknown') AS subject_count, min(year) AS first_year, max(year) AS last_year FROM expanded GROUP BY author"))
def author_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biblio.author_stats(expanded(spark, sf_dir))


@register("rel_author_article_stats", with_expanded("SELECT author, count(DISTINCT master_id) AS article_count, count(DISTINCT subject_l2) AS subject_count, min(year) AS first_year, max(year) AS last_year FROM expanded GROUP BY author"))
def rel_author_article_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biblio.author_stats(expanded(spark, sf_dir), count_unknown=True)


@register("rel_author_stats_window", with_expanded("SELECT author, time_window, count(DISTINCT master_id) AS article_count, count(DISTINCT subject_l2) AS subject_count, min(year) AS first_year, max(year) AS last_year FROM expanded GROUP BY author, time_window"))
def rel_author_stats_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biblio.author_stats(expanded(spark, sf_dir), ["author", "time_window"], count_unknown=True)


@register("author_articles", with_expanded("SELECT author, master_id, min(title) AS title, min(year) AS year, string_agg(DISTINCT subject_l1, '; ' ORDER BY subject_l1) AS subjects_l1, string_agg(DISTINCT subject_l2, '; ' ORDER BY subject_l2) AS subjects_l2 FROM expanded GROUP BY author, master_id"))
def author_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biblio.author_articles(expanded(spark, sf_dir))


@register("mapping_review", with_expanded("SELECT subject_l1, subject_l2, CASE WHEN subject_l2 = 'Unknown' THEN 'no rule' ELSE 'rule' END AS mapping_note, count(*) AS article_rows FROM expanded GROUP BY ALL"))
def mapping_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("subject_l2") == "Unknown", "no rule").otherwise("rule").alias("mapping_note")
    return expanded(spark, sf_dir).groupBy("subject_l1", "subject_l2", note).agg(F.count("*").alias("article_rows"))


_AUTHORS = "SELECT 'A_' || row_number() OVER (ORDER BY min(pos), author) AS node_id, author AS node_label, 'author' AS node_type, min(year) AS first_year, max(year) AS last_year, count(DISTINCT master_id) AS article_count, count(DISTINCT subject_l2) AS subject_count, CAST(NULL AS VARCHAR) AS subject_l1, CAST(NULL AS BIGINT) AS author_count FROM known GROUP BY author"
_SUBJECTS = "SELECT 'S_' || row_number() OVER (ORDER BY min(pos), subject_l2) AS node_id, subject_l2 AS node_label, 'subject' AS node_type, min(year) AS first_year, max(year) AS last_year, count(DISTINCT master_id) AS article_count, CAST(NULL AS BIGINT) AS subject_count, subject_l1, count(DISTINCT author) AS author_count FROM known GROUP BY subject_l2, subject_l1"


@register("network_nodes_author", with_expanded(_AUTHORS))
def network_nodes_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biblio.author_nodes(known(spark, sf_dir))


@register("network_nodes_subject", with_expanded(_SUBJECTS))
def network_nodes_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biblio.subject_nodes(known(spark, sf_dir))


@register("network_nodes", with_expanded(f"{_AUTHORS} UNION ALL {_SUBJECTS}"))
def network_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = known(spark, sf_dir)
    return biblio.author_nodes(rows).unionByName(biblio.subject_nodes(rows))


@register("network_edges_article", with_expanded(f"SELECT a.node_id AS from_id, s.node_id AS to_id, k.author, k.subject_l2, k.subject_l1, master_id, title, year, time_window, round(subject_weight, 6) AS subject_weight FROM known k JOIN ({_AUTHORS}) a ON a.node_label = k.author JOIN ({_SUBJECTS}) s ON s.node_label = k.subject_l2"))
def network_edges_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(biblio.article_edges(known(spark, sf_dir)), "subject_weight")


_EDGES = "SELECT author, subject_l2, subject_l1, time_window, count(DISTINCT master_id) AS article_count, round(sum(subject_weight), 6) AS weight, min(year) AS first_year, max(year) AS last_year, string_agg(DISTINCT title, ' | ' ORDER BY title) AS titles FROM known GROUP BY author, subject_l2, subject_l1, time_window"


@register("network_edges_time", with_expanded(_EDGES))
def network_edges_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(biblio.time_edges(known(spark, sf_dir)), "weight")


@register("edges_json", with_expanded(f"SELECT '{{\"author\":\"' || author || '\",\"subject\":\"' || subject_l2 || '\",\"window\":\"' || time_window || '\",\"articles\":' || article_count || '}}' AS edge FROM ({_EDGES})"))
def edges_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = biblio.time_edges(known(spark, sf_dir))
    return edges.select(F.to_json(F.struct("author", F.col("subject_l2").alias("subject"), F.col("time_window").alias("window"), F.col("article_count").alias("articles"))).alias("edge"))


@register(
    "network_degree",
    with_expanded("""SELECT time_window, node, node_type, count(*) AS degree FROM (
  SELECT DISTINCT time_window, author AS node, 'author' AS node_type, subject_l2 AS other FROM known UNION SELECT DISTINCT time_window, subject_l2, 'subject', author FROM known) GROUP BY ALL"""),
)
def network_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import graph

    return graph.degrees(known(spark, sf_dir), ["time_window"], "author", "subject_l2")


@register(
    "subject_betweenness",
    with_expanded(""", e AS (SELECT DISTINCT time_window AS w, 'a:' || author AS a, 's:' || subject_l2 AS b FROM known UNION SELECT DISTINCT time_window, 's:' || subject_l2, 'a:' || author FROM known),
bfs(w, s, v, d, n) USING KEY (w, s, v) AS (
  SELECT DISTINCT w, a, a, 0, 1.0::DOUBLE FROM e
  UNION SELECT w, s, v, d, n FROM (SELECT x.w, x.s, e.b AS v, x.d + 1 AS d, sum(x.n) AS n FROM bfs x JOIN e ON e.w = x.w AND e.a = x.v GROUP BY ALL) y
    WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.w = y.w AND r.s = y.s AND r.v = y.v))
SELECT x.w AS time_window, substr(x.v, 3) AS node, round(sum(CASE WHEN x.s <> x.v AND y.v <> x.v AND x.s <> y.v AND x.d + y.d = z.d THEN x.n * y.n / z.n ELSE 0 END) / 2, 6) AS betweenness
FROM bfs x JOIN bfs y ON y.w = x.w AND y.s = x.v JOIN bfs z ON z.w = x.w AND z.s = x.s AND z.v = y.v WHERE x.v LIKE 's:%' GROUP BY ALL""").replace("WITH ", "WITH RECURSIVE ", 1),
)
def subject_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import graph

    rows = known(spark, sf_dir).select("time_window", "author", "subject_l2").distinct()
    return graph.betweenness(rows, "time_window", "author", "subject_l2").withColumn("betweenness", F.round("betweenness", 6))


@register(
    "weight_summary",
    with_expanded("""SELECT section, name, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY round(weight, 9) DESC, name) AS rank FROM (
  SELECT 'author' AS section, author AS name, sum(subject_weight) AS weight FROM known GROUP BY author UNION ALL SELECT 'l1', subject_l1, sum(subject_weight) FROM known GROUP BY subject_l1
  UNION ALL SELECT 'l2', subject_l2, sum(subject_weight) FROM known GROUP BY subject_l2)) WHERE rank <= 10"""),
)
def weight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = known(spark, sf_dir), None
    for section, column in (("author", "author"), ("l1", "subject_l1"), ("l2", "subject_l2")):
        one = rows.groupBy(F.col(column).alias("name")).agg(F.sum("subject_weight").alias("weight")).withColumn("section", F.lit(section))
        out = one if out is None else out.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc(F.round("weight", 9)), "name"))
    return rounded(out.withColumn("rank", rank).where("rank <= 10").select("section", "name", "weight", "rank"), "weight")


@register("mapping_override", "SELECT p_partkey, p_type AS subject_l1, p_brand AS note FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'corrected' AS subject_l1, 'override' AS note FROM part WHERE p_partkey % 3 = 0")
def mapping_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("subject_l1"), F.col("p_brand").alias("note"))
    fixed = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select("p_partkey", F.lit("corrected").alias("subject_l1"), F.lit("override").alias("note"))
    return biblio.override_mapping(base, fixed, "p_partkey")


# Relational export.


@register("rel_articles", with_articles("SELECT DISTINCT master_id, title, year, volume, time_window FROM art"))
def rel_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.articles(expanded_articles(spark, sf_dir))


def expanded_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_items(spark, sf_dir).join(titles(spark, sf_dir), "item").drop("item")


_REL_AUTHORS = "SELECT printf('AUTH_%05d', row_number() OVER (ORDER BY author)) AS author_id, author AS author_name FROM (SELECT DISTINCT author FROM expanded)"
_REL_SUBJECTS = "SELECT printf('SUBJ_%05d', row_number() OVER (ORDER BY subject_l1, subject_l2)) AS subject_id, subject_l1, subject_l2 FROM (SELECT DISTINCT subject_l1, subject_l2 FROM expanded)"


@register("rel_authors", with_expanded(_REL_AUTHORS))
def rel_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.authors(expanded(spark, sf_dir))


@register("rel_subjects", with_expanded(_REL_SUBJECTS))
def rel_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.subjects(expanded(spark, sf_dir))


@register("rel_article_authors", with_expanded(f"SELECT DISTINCT master_id, author_id FROM expanded JOIN ({_REL_AUTHORS}) ON author = author_name"))
def rel_article_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.article_authors(expanded(spark, sf_dir))


@register("rel_article_subjects", with_expanded(f"SELECT DISTINCT master_id, subject_id, round(subject_weight, 6) AS subject_weight FROM expanded JOIN ({_REL_SUBJECTS}) s USING (subject_l1, subject_l2)"))
def rel_article_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.article_subjects(expanded(spark, sf_dir)), "subject_weight")


@register("rel_author_details", with_expanded("SELECT DISTINCT author AS author_name, master_id, subject_l2 FROM expanded"))
def rel_author_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.author_details(expanded(spark, sf_dir))


@register("rel_time_windows", with_articles("SELECT DISTINCT time_window, CAST(substr(time_window, 1, 4) AS INTEGER) AS start_year, CAST(substr(time_window, 6, 4) AS INTEGER) AS end_year FROM art"))
def rel_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.time_windows(expanded_articles(spark, sf_dir))


# Read side of the interactive pages.


@register("page_articles", with_expanded("SELECT DISTINCT master_id, title, year FROM known WHERE time_window = '1997-1998' AND subject_l1 LIKE 'P%' AND contains(lower(title), 'the') ORDER BY year, title, master_id LIMIT 160"))
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.page_filter(known(spark, sf_dir), window="1997-1998", l1_prefix="P", needles={"title": "the"})
    return found.select("master_id", "title", "year").distinct().orderBy("year", "title", "master_id").limit(160)


@register("page_heatmap", with_expanded("SELECT subject_l2, time_window, round(sum(subject_weight), 6) AS weight FROM known WHERE subject_l2 IN (SELECT subject_l2 FROM known GROUP BY 1 ORDER BY round(sum(subject_weight), 9) DESC, 1 LIMIT 24) GROUP BY ALL"))
def page_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.heatmap(known(spark, sf_dir), "subject_l2", "time_window", "subject_weight", 24), "weight")


@register("page_bars", with_expanded("SELECT subject_l2, round(sum(subject_weight), 6) AS weight FROM known GROUP BY 1 ORDER BY round(sum(subject_weight), 9) DESC, 1 LIMIT 42"))
def page_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.top_by_sum(known(spark, sf_dir), "subject_l2", "subject_weight", 42), "weight")


@register("page_roles", with_expanded("SELECT time_window, subject_l2, round(sum(subject_weight), 6) AS strength, count(DISTINCT author) AS degree FROM known GROUP BY ALL ORDER BY round(sum(subject_weight), 9) DESC, time_window, subject_l2 LIMIT 220"))
def page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = biblio.subject_degree(known(spark, sf_dir)).orderBy(F.desc(F.round("strength", 9)), "time_window", "subject_l2").limit(220)
    return rounded(out.select("time_window", "subject_l2", "strength", "degree"), "strength")


@register("page_authors", with_expanded("SELECT author, count(DISTINCT master_id) AS article_count, count(DISTINCT subject_l2) AS subject_count, min(year) AS first_year, max(year) AS last_year FROM known WHERE time_window = '1995-1996' GROUP BY author"))
def page_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biblio.author_stats(known(spark, sf_dir).where("time_window = '1995-1996'"))


@register("page_node_articles", with_expanded("SELECT DISTINCT author, master_id, subject_l1 FROM known"))
def page_node_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known(spark, sf_dir).select("author", "master_id", "subject_l1").dropDuplicates()
