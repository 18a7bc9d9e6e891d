"""The input tables in the roles of a bibliographic corpus, and the same as SQL.

Article: an order. Author: its first supplier by name. Subjects: types and brands of its
parts; parts of a size over 45 have none ('Unknown'). Title: a benchmark item. Windows: two
years from 1995. Topics: labels of the embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import biblio
from tessera.sources.written import keep

BASE_YEAR, WINDOW_YEARS = 1995, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """master_id, year, author, volume, and item, which stands for the titles that articles() joins."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("master_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("volume"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("master_id"), "l_suppkey")
    author = lines.join(supplier, lines["l_suppkey"] == supplier["s_suppkey"]).groupBy("master_id").agg(F.min("s_name").alias("author"))
    return orders.join(author, "master_id").withColumn("item", F.col("master_id") % 40).join(titles(spark, sf_dir).select("item"), "item", "left_semi")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("title"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """master_id, year, author, title, volume."""
    return items(spark, sf_dir).join(titles(spark, sf_dir), "item").select("master_id", "year", "volume", "author", "title")


def windowed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items() with window. They are written once, as the windows need the last year of all; titles come later, so that they neither shuffle nor sort."""
    return biblio.time_window(keep(items(spark, sf_dir), "items"), "year", BASE_YEAR, WINDOW_YEARS)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct master_id, subject_l1, subject_l2."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 45, "Unknown").otherwise(F.col("p_type")).alias("subject_l1"),
        F.when(F.col("p_size") > 45, "Unknown").otherwise(F.concat_ws(" / ", "p_type", "p_brand")).alias("subject_l2"),
    )
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("master_id"), "l_partkey")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).select("master_id", "subject_l1", "subject_l2").distinct()


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article-subject rows with window and weight; pos is the order of the rows."""
    rows = biblio.subject_weight(windowed_items(spark, sf_dir).join(subjects(spark, sf_dir), "master_id"))
    return rows.join(titles(spark, sf_dir), "item").drop("item").withColumn("pos", F.concat_ws("|", F.format_string("%012d", "master_id"), "subject_l2"))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biblio.known_subjects(expanded(spark, sf_dir))


ARTICLES_SQL = """
art0 AS (
  SELECT o_orderkey AS master_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS volume, author, b.text AS title
  FROM orders JOIN (SELECT l_orderkey, min(s_name) AS author FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) a ON o_orderkey = l_orderkey
  JOIN benchmark b ON b.item_id = o_orderkey % 40
), art1 AS (
  SELECT *, (SELECT max(year) FROM art0) AS last, 1995 + (year - 1995) // 2 * 2 AS s FROM art0
), art AS (
  SELECT master_id, year, volume, author, title,
    CAST(CASE WHEN s = last AND s > 1995 THEN s - 2 ELSE s END AS INTEGER) AS window_start,
    CAST(CASE WHEN (s = last AND s > 1995) OR s = last - 2 THEN last ELSE least(s + 1, last) END AS INTEGER) AS window_end,
    (CASE WHEN s = last AND s > 1995 THEN s - 2 ELSE s END) || '-' || (CASE WHEN (s = last AND s > 1995) OR s = last - 2 THEN last ELSE least(s + 1, last) END) AS time_window
  FROM art1
)"""

EXPANDED_SQL = (
    ARTICLES_SQL
    + """, sub AS (
  SELECT DISTINCT l_orderkey AS master_id, CASE WHEN p_size > 45 THEN 'Unknown' ELSE p_type END AS subject_l1,
    CASE WHEN p_size > 45 THEN 'Unknown' ELSE p_type || ' / ' || p_brand END AS subject_l2
  FROM lineitem JOIN part ON l_partkey = p_partkey
), exp0 AS (
  SELECT art.*, subject_l1, subject_l2,
    CAST((SELECT count(DISTINCT subject_l2) FROM sub x WHERE x.master_id = art.master_id) AS INTEGER) AS n_subjects_article_all,
    CAST((SELECT count(DISTINCT subject_l2) FROM sub x WHERE x.master_id = art.master_id AND subject_l2 <> 'Unknown') AS INTEGER) AS n_subjects_article_network,
    lpad(CAST(master_id AS VARCHAR), 12, '0') || '|' || subject_l2 AS pos
  FROM art JOIN sub USING (master_id)
), expanded AS (
  SELECT *, CASE WHEN subject_l2 = 'Unknown' OR n_subjects_article_network = 0 THEN 0.0 ELSE 1.0 / n_subjects_article_network END::DOUBLE AS subject_weight FROM exp0
), known AS (SELECT * FROM expanded WHERE subject_l1 <> 'Unknown' AND subject_l2 <> 'Unknown')"""
)


def with_articles(sql: str) -> str:
    return f"WITH {ARTICLES_SQL.strip()}\n{sql}"


def with_expanded(sql: str) -> str:
    return f"WITH {EXPANDED_SQL.strip()}\n{sql}"
