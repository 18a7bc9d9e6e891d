"""Topic-table queries: labels of the embeddings, or sources of the documents, as topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import min_max
from tessera.operators import models, text, topics
from tessera.plans.biblio_queries import rounded
from tessera.plans.catalog import register
from tessera.plans.roles import table, with_articles
from tessera.sources.written import keep
from tessera.plans.text_queries import IDF, TOK, tokenized, vocab_sql

#: Words of a topic: the top terms of a source, weighted by tf-idf.
TOPIC_WORDS = f"""{TOK}, {vocab_sql('tok')}, n AS (SELECT count(DISTINCT doc_id) AS n FROM dt), cn AS (SELECT source, count(DISTINCT doc_id) AS n FROM dt GROUP BY source),
tw0 AS (SELECT CAST(substr(source, 4) AS INTEGER) AS topic_id, source, term AS word, sum(tf / doc_len) AS s, count(*) AS document_count FROM dt GROUP BY ALL),
tw AS (SELECT topic_id, CASE WHEN topic_id < 10 THEN 'm1' ELSE 'm2' END AS model, word, weight, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 9) DESC, word) AS INTEGER) AS rank FROM (
  SELECT topic_id, word, s * ({IDF}) AS weight FROM tw0 JOIN cn USING (source)) QUALIFY rank <= 20)"""
#: Prevalences: scaled, positive parts of an embedding's first ten components.
THETA = """th AS (SELECT doc_id, topic_id, v / sum(v) OVER (PARTITION BY doc_id) AS theta, label FROM (
  SELECT vec_id AS doc_id, label, unnest(range(0, 10))::INTEGER AS topic_id, unnest(list_transform(embedding[1:10], lambda x: greatest(CAST(x AS DOUBLE), 0) + 0.01)) AS v FROM embeddings))"""
TOPIC_ROWS = "tr AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN -1 ELSE CAST(substr(source, 4) AS INTEGER) END AS topic_id, lang, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE lang END AS decade, doc_id // 3 AS article FROM documents)"


def topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = keep(text.tfidf_by_group(tokenized(spark, sf_dir), "source", n=20), "topic-words")
    topic = F.substring("source", 4, 9).cast("int")
    return top.select(topic.alias("topic_id"), F.when(topic < 10, "m1").otherwise("m2").alias("model"), F.col("term").alias("word"), F.col("tfidf_score").alias("weight"), "rank")


def theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.slice("embedding", 1, 10), lambda x: F.greatest(x.cast("double"), F.lit(0.0)) + 0.01)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.posexplode(parts).alias("topic_id", "v"))
    return rows.withColumn("theta", F.col("v") / F.sum("v").over(Window.partitionBy("doc_id"))).drop("v")


def topic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.when(F.col("doc_id") % 17 == 0, -1).otherwise(F.substring("source", 4, 9).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", topic.alias("topic_id"), "lang", F.when(F.col("doc_id") % 13 != 0, F.col("lang")).alias("decade"), F.floor(F.col("doc_id") / 3).alias("article"))


@register("topic_by_decade", f"WITH {TOPIC_ROWS} SELECT decade, topic_id, count(*) AS count FROM tr WHERE decade IS NOT NULL GROUP BY ALL")
def topic_by_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.counts(topic_rows(spark, sf_dir), "decade", "topic_id")


@register("topic_by_group", f"WITH {TOPIC_ROWS} SELECT lang, topic_id, count(*) AS count FROM tr GROUP BY ALL")
def topic_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.counts(topic_rows(spark, sf_dir), "lang", "topic_id")


@register("article_topic_summary", f"WITH {TOPIC_ROWS} SELECT article, topic_id, count(*) AS chunk_count FROM tr GROUP BY ALL")
def article_topic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.counts(topic_rows(spark, sf_dir), "article", "topic_id", name="chunk_count")


_LABELS = "SELECT topic_id, string_agg(word, ', ' ORDER BY rank) AS topic_words FROM tw WHERE rank <= {n} GROUP BY topic_id"
_INTERPRET = "SELECT topic_id, coalesce(sum(weight) FILTER (rank <= 5) / nullif(sum(weight) FILTER (rank <= 15), 0), 0) AS interpretability FROM tw GROUP BY topic_id"


@register("topic_labels", f"WITH {TOPIC_WORDS} " + _LABELS.format(n=8))
def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.labels(topic_words(spark, sf_dir), 8)


@register("topic_interpretability", f"WITH {TOPIC_WORDS} SELECT topic_id, round(interpretability, 6) AS interpretability FROM ({_INTERPRET})")
def topic_interpretability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topics.interpretability(topic_words(spark, sf_dir)), "interpretability")


def _norm(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN CASE WHEN max({c}) OVER () > 0 THEN 1.0 ELSE 0.0 END ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


_IMPORTANCE_COLUMNS = "round(topic_size_share, 6) AS topic_size_share, round(article_coverage, 6) AS article_coverage, round(interpretability, 6) AS interpretability, round(a, 6) AS coverage_score_norm, round(b, 6) AS size_score_norm, round(c, 6) AS interpretability_score_norm, round((a + b + c) / 3, 6) AS importance_score"
_ROUNDED = ("topic_size_share", "article_coverage", "interpretability", "coverage_score_norm", "size_score_norm", "interpretability_score_norm", "importance_score")


@register(
    "topic_importance",
    f"""WITH {TOPIC_WORDS}, {TOPIC_ROWS}, v AS (SELECT * FROM tr WHERE topic_id <> -1),
s AS (SELECT topic_id, count(*) AS topic_size, count(DISTINCT doc_id) AS article_count, count(*) / (SELECT count(*) FROM v) AS topic_size_share, count(DISTINCT doc_id) / (SELECT count(DISTINCT doc_id) FROM v) AS article_coverage FROM v GROUP BY topic_id),
j AS (SELECT topic_id, topic_size, article_count, topic_size_share, article_coverage, coalesce(interpretability, 0) AS interpretability, topic_words FROM s LEFT JOIN ({_INTERPRET}) USING (topic_id) LEFT JOIN ({_LABELS.format(n=12)}) USING (topic_id)),
k AS (SELECT *, {_norm('article_coverage')} AS a, {_norm('topic_size')} AS b, {_norm('interpretability')} AS c FROM j)
SELECT topic_id, topic_size, article_count, topic_words, {_IMPORTANCE_COLUMNS}, CAST(row_number() OVER (ORDER BY round((a + b + c) / 3, 9) DESC, article_coverage DESC, topic_size DESC, topic_id) AS INTEGER) AS importance_rank FROM k""",
)
def topic_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topics.importance(topic_rows(spark, sf_dir), topic_words(spark, sf_dir)), *_ROUNDED)


@register(
    "topic_by_decade_detailed",
    f"""WITH {TOPIC_WORDS}, {TOPIC_ROWS}, c AS (SELECT decade, topic_id, count(*) AS count, count(DISTINCT article) AS article_count FROM tr WHERE topic_id <> -1 AND decade IS NOT NULL GROUP BY ALL)
SELECT c.*, round(count / sum(count) OVER (PARTITION BY decade), 6) AS share_of_decade, round(count / sum(count) OVER (PARTITION BY topic_id), 6) AS share_of_topic, topic_words FROM c LEFT JOIN ({_LABELS.format(n=6)}) USING (topic_id)""",
)
def topic_by_decade_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topics.by_decade_detailed(topic_rows(spark, sf_dir), "decade", topic_words(spark, sf_dir), "article"), "share_of_decade", "share_of_topic")


@register("theta_by_decade", f"WITH {THETA} SELECT label, topic_id, round(avg(theta), 6) AS mean_theta, count(*) FILTER (theta >= 0.05) AS document_count, round(avg(CAST(theta >= 0.05 AS INTEGER)), 6) AS document_share FROM th GROUP BY ALL")
def theta_by_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topics.theta_by(theta(spark, sf_dir), "label"), "mean_theta", "document_share")


@register("theta_by_subject", f"WITH {THETA}, g AS (SELECT *, unnest(CASE label % 3 WHEN 0 THEN ['Unknown'] WHEN 1 THEN ['A', 'B'] ELSE ['B'] END) AS subject FROM th) SELECT subject, topic_id, round(avg(theta), 6) AS mean_theta, count(*) FILTER (theta >= 0.05) AS document_count, round(avg(CAST(theta >= 0.05 AS INTEGER)), 6) AS document_share FROM g GROUP BY ALL")
def theta_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.scalar import split_subjects

    cell = F.when(F.col("label") % 3 == 0, "").when(F.col("label") % 3 == 1, "A; B").otherwise("B | unknown")
    rows = theta(spark, sf_dir).withColumn("subject", F.explode(split_subjects(cell, "Unknown")))
    return rounded(topics.theta_by(rows, "subject"), "mean_theta", "document_share")


@register(
    "topic_importance_theta",
    f"""WITH {TOPIC_WORDS}, {THETA}, s AS (SELECT topic_id, sum(theta) AS topic_size, avg(theta) AS topic_size_share, count(*) FILTER (theta >= 0.05) AS article_count, avg(CAST(theta >= 0.05 AS INTEGER)) AS article_coverage FROM th GROUP BY topic_id),
j AS (SELECT s.*, coalesce(interpretability, 0) AS interpretability FROM s LEFT JOIN ({_INTERPRET}) USING (topic_id)), k AS (SELECT *, {_norm('article_coverage')} AS a, {_norm('topic_size')} AS b, {_norm('interpretability')} AS c FROM j)
SELECT topic_id, round(topic_size, 6) AS topic_size, article_count, {_IMPORTANCE_COLUMNS}, CAST(row_number() OVER (ORDER BY round((a + b + c) / 3, 9) DESC, article_coverage DESC, topic_id) AS INTEGER) AS importance_rank FROM k""",
)
def topic_importance_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topics.theta_importance(theta(spark, sf_dir), topic_words(spark, sf_dir)), "topic_size", *_ROUNDED)


@register("dominant_topic", f"WITH {THETA} SELECT doc_id, topic_id AS dominant_topic, round(theta, 6) AS max_theta FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY theta DESC, topic_id) AS r FROM th) WHERE r = 1")
def dominant_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topics.dominant_topic(theta(spark, sf_dir)), "max_theta")


@register("minmax_normalize", f"SELECT s_suppkey, round({_norm('s_acctbal')}, 6) AS score FROM supplier")
def minmax_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(min_max("s_acctbal", topics.whole()), 6).alias("score"))


@register("representative_docs", f"WITH {THETA} SELECT topic_id, doc_id, round(theta, 6) AS theta, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY theta DESC, doc_id) AS INTEGER) AS rank FROM th QUALIFY rank <= 12")
def representative_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topics.representative_docs(theta(spark, sf_dir)).select("topic_id", "doc_id", "theta", "rank"), "theta")


@register("topic_diversity", f"WITH {TOPIC_WORDS} SELECT model, round(count(DISTINCT word) / count(*), 6) AS diversity FROM tw WHERE rank <= 10 GROUP BY model")
def topic_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topics.diversity(topic_words(spark, sf_dir)), "diversity")


@register("topic_exclusivity", f"WITH {TOPIC_WORDS} SELECT model, round(avg(1 / k), 6) AS exclusivity FROM (SELECT model, word, count(DISTINCT topic_id) AS k FROM tw WHERE rank <= 10 GROUP BY ALL) GROUP BY model")
def topic_exclusivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topics.exclusivity(topic_words(spark, sf_dir)), "exclusivity")


@register("topic_concentration", f"WITH {THETA} SELECT round((SELECT avg(m) FROM (SELECT max(theta) AS m FROM th GROUP BY doc_id)), 6) AS concentration, (SELECT count(*) FROM (SELECT 1 FROM th GROUP BY topic_id HAVING sum(theta) < 0.01)) AS near_empty_topics")
def topic_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topics.concentration(theta(spark, sf_dir)), "concentration")


@register("topic_jaccard", f"WITH {TOPIC_WORDS}, w AS (SELECT DISTINCT topic_id, word FROM tw), s AS (SELECT topic_id, count(*) AS n FROM w GROUP BY 1), p AS (SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, count(*) AS shared FROM w a JOIN w b ON a.word = b.word AND a.topic_id < b.topic_id GROUP BY ALL) SELECT topic_a, topic_b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN s x ON x.topic_id = topic_a JOIN s y ON y.topic_id = topic_b WHERE shared / (x.n + y.n - shared) >= 0.2")
def topic_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topics.topic_jaccard(topic_words(spark, sf_dir)), "jaccard")


@register(
    "semantic_coherence",
    f"""WITH {TOPIC_WORDS}, t AS (SELECT topic_id, rank, word FROM tw WHERE rank <= 10), h AS (SELECT DISTINCT doc_id, topic_id, rank FROM allrow JOIN t ON term = word),
d AS (SELECT topic_id, rank, count(*) AS d FROM h GROUP BY ALL), b AS (SELECT x.topic_id, x.rank AS i, y.rank AS j, count(*) AS dij FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.topic_id = y.topic_id AND x.rank > y.rank GROUP BY ALL)
SELECT a.topic_id, round(sum(ln((coalesce(dij, 0) + 1) / d.d)), 6) AS coherence FROM t a JOIN t c ON a.topic_id = c.topic_id AND a.rank > c.rank LEFT JOIN b ON b.topic_id = a.topic_id AND b.i = a.rank AND b.j = c.rank JOIN d ON d.topic_id = a.topic_id AND d.rank = c.rank GROUP BY a.topic_id""",
)
def semantic_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topics.semantic_coherence(tokenized(spark, sf_dir), topic_words(spark, sf_dir)), "coherence")


#: Models to choose from: the first topics of the topic words, and of the prevalences.
WORD_MODELS, THETA_MODELS = (5, 10, 15, 20), (2, 4, 6, 8, 10)


@register(
    "k_selection",
    f"""WITH {TOPIC_WORDS}, t AS (SELECT topic_id, rank, word FROM tw WHERE rank <= 10), h AS (SELECT DISTINCT doc_id, topic_id, rank FROM allrow JOIN t ON term = word),
dj AS (SELECT topic_id, rank, count(*) AS d FROM h GROUP BY ALL), bo AS (SELECT x.topic_id, x.rank AS i, y.rank AS j, count(*) AS dij FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.topic_id = y.topic_id AND x.rank > y.rank GROUP BY ALL),
co AS (SELECT a.topic_id, sum(ln((coalesce(dij, 0) + 1) / dj.d)) AS coherence FROM t a JOIN t c ON a.topic_id = c.topic_id AND a.rank > c.rank LEFT JOIN bo ON bo.topic_id = a.topic_id AND bo.i = a.rank AND bo.j = c.rank JOIN dj ON dj.topic_id = a.topic_id AND dj.rank = c.rank GROUP BY a.topic_id),
ks AS (SELECT unnest({list(WORD_MODELS)}) AS k), c1 AS (SELECT k, avg(coherence) AS coherence FROM ks JOIN co ON topic_id < k GROUP BY k),
e1 AS (SELECT k, avg(1 / m) AS exclusivity FROM (SELECT k, word, count(DISTINCT topic_id) AS m FROM ks JOIN t ON topic_id < k GROUP BY ALL) GROUP BY k),
sc AS (SELECT *, {_norm('coherence')} AS a, {_norm('exclusivity')} AS b FROM c1 JOIN e1 USING (k))
SELECT k, round(coherence, 6) AS coherence, round(exclusivity, 6) AS exclusivity, round(a, 6) AS coherence_norm, round(b, 6) AS exclusivity_norm, round((a + b) / 2, 6) AS balanced_score, round(0.6 * a + 0.4 * b, 6) AS weighted_score, CAST(row_number() OVER (ORDER BY round((a + b) / 2, 9) DESC, round(coherence, 9) DESC, k) AS INTEGER) AS selection_rank FROM sc""",
)
def k_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = topic_words(spark, sf_dir)
    each = keep(topics.semantic_coherence(tokenized(spark, sf_dir), words), "coherence")
    rows = None
    for k in WORD_MODELS:
        coherence = each.where(F.col("topic_id") < k).agg(F.avg("coherence").alias("coherence"))
        exclusive = topics.exclusivity(words.where(F.col("topic_id") < k).withColumn("model", F.lit("one"))).select("exclusivity")
        one = coherence.crossJoin(exclusive).withColumn("k", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    out = topics.k_selection(rows.select("k", "coherence", "exclusivity"))
    return rounded(out, "coherence", "exclusivity", "coherence_norm", "exclusivity_norm", "balanced_score", "weighted_score")


_BEST = f"""WITH {THETA}, ks AS (SELECT unnest({list(THETA_MODELS)}) AS k), r AS (SELECT k, doc_id, topic_id, theta / sum(theta) OVER (PARTITION BY k, doc_id) AS theta FROM ks JOIN th ON topic_id < k),
c AS (SELECT k, avg(m) AS concentration, exp(avg(e)) AS perplexity FROM (SELECT k, doc_id, max(theta) AS m, sum(-theta * ln(theta)) AS e FROM r GROUP BY ALL) GROUP BY k), z AS (SELECT k, count(*) FILTER (s < 0.01) AS near_empty_topics FROM (SELECT k, topic_id, sum(theta) AS s FROM r GROUP BY ALL) GROUP BY k)
SELECT k, near_empty_topics, round(perplexity, 6) AS perplexity, round(concentration, 6) AS concentration FROM c JOIN z USING (k) ORDER BY near_empty_topics > 0, round(perplexity, 9), concentration DESC, k LIMIT 1"""


@register("best_k", _BEST)
def best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = keep(theta(spark, sf_dir), "theta"), None
    for k in THETA_MODELS:
        own = rows.where(F.col("topic_id") < k).withColumn("theta", F.col("theta") / F.sum("theta").over(Window.partitionBy("doc_id")))
        one = topics.theta_diagnostics(own).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return rounded(topics.best_k(out).select("k", "near_empty_topics", "perplexity", "concentration"), "perplexity", "concentration")


@register(
    "theta_regression",
    f"""WITH {THETA}, x AS (SELECT *, CAST(1850 + doc_id % 90 AS DOUBLE) AS year FROM th), g AS (SELECT topic_id, label, avg(year) AS my, avg(theta) AS mt FROM x GROUP BY ALL),
w AS (SELECT topic_id, sum((year - my) * (theta - mt)) / nullif(sum((year - my) * (year - my)), 0) AS slope_within FROM x JOIN g USING (topic_id, label) GROUP BY 1)
SELECT topic_id, count(*) AS documents, round(regr_slope(theta, year), 9) AS slope, round(regr_r2(theta, year), 9) AS r2, round(any_value(slope_within), 9) AS slope_within FROM x JOIN w USING (topic_id) GROUP BY topic_id""",
)
def theta_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = theta(spark, sf_dir).withColumn("year", (F.col("doc_id") % 90 + 1850).cast("double"))
    return rounded(topics.prevalence_regression(rows, "year", "label"), "slope", "r2", "slope_within", digits=9)


@register("lda_topics")
def lda_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.lda_topics(tokenized(spark, sf_dir))


@register("nmf_topics")
def nmf_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenized(spark, sf_dir)
    kept = text.kept_list(docs)
    rows = text.unnested(text.kept_counts(docs, kept), "_c", "x", "doc_id", "doc_len")
    return models.nmf_topics(rows.select("doc_id", "x.term", (F.col("x.tf") / F.col("doc_len")).alias("value")), sorted(kept))


@register("embedding_clusters")
def embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.embedding_clusters(table(spark, sf_dir, "embeddings"))


# Multi-valued subjects, pivots.


@register("top_subjects", "SELECT subject, count(*) AS n FROM (SELECT DISTINCT l_orderkey, p_type AS subject FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY subject ORDER BY n DESC, subject LIMIT 15")
def top_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.scalar import joined_distinct

    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    cells = lines.join(part, lines["l_partkey"] == part["p_partkey"]).groupBy("l_orderkey").agg(joined_distinct("p_type", " | ").alias("cell"))
    return cells.select(F.explode(F.split("cell", r" \| ")).alias("subject")).groupBy("subject").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject").limit(15)


_BY_YEAR = "SELECT year, volume, count(*) AS n FROM art GROUP BY ALL"


@register("subjects_by_decade", with_articles(f"SELECT year, volume, n FROM ({_BY_YEAR}) WHERE volume IN (SELECT volume FROM art GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)"))
def subjects_by_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans.roles import articles

    rows = articles(spark, sf_dir).select("year", "volume")
    top = rows.groupBy("volume").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "volume").limit(3).select("volume")
    return rows.join(F.broadcast(top), "volume", "left_semi").groupBy("year", "volume").agg(F.count("*").alias("n"))


@register("pivot_decade", "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source")
def pivot_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1))).na.fill(0)


@register("topic_heatmap", f"WITH {TOPIC_ROWS}, c AS (SELECT topic_id, lang, count(*) AS n FROM tr WHERE topic_id <> -1 GROUP BY ALL), t AS (SELECT topic_id FROM c GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 8) SELECT topic_id, lang, n, round(n / max(n) OVER (), 6) AS intensity FROM c WHERE topic_id IN (SELECT topic_id FROM t)")
def topic_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = topics.counts(topic_rows(spark, sf_dir).where("topic_id != -1"), "topic_id", "lang", name="n")
    top = cells.groupBy("topic_id").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "topic_id").limit(8).select("topic_id")
    return cells.join(F.broadcast(top), "topic_id", "left_semi").withColumn("intensity", F.round(F.col("n") / F.max("n").over(topics.whole()), 6))


@register("topk_semi", f"WITH {TOPIC_ROWS} SELECT doc_id, topic_id FROM tr WHERE topic_id IN (SELECT topic_id FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)")
def topk_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topic_rows(spark, sf_dir)
    top = rows.groupBy("topic_id").count().orderBy(F.desc("count"), "topic_id").limit(5).select("topic_id")
    return rows.join(F.broadcast(top), "topic_id", "left_semi").select("doc_id", "topic_id")
