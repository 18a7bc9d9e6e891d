"""Bibliometric operators over article-subject rows: windows, weights, distributions,
diversity, author and network tables.

The rows have master_id, author, title, year, subject_l1, subject_l2, and the columns the
earlier operators add: time_window, subject_weight. All are DataFrame-to-DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbering import labelled
from tessera.functions.scalar import joined_distinct
from tessera.sources.written import keep

BROADCAST_NODES = 500_000


def time_window(rows: DataFrame, year: str = "year", base: int = 1858, size: int = 10) -> DataFrame:
    """Adds window_start, window_end, time_window. A last window of one year joins the one before.

    The largest year is a one-row aggregate, so its cross join is a broadcast of one row.
    """
    last = rows.agg(F.max(year).alias("_last"))
    first = (F.lit(base) + F.floor((F.col(year) - base) / size) * size).cast("int")
    out = rows.crossJoin(F.broadcast(last)).withColumn("_s", first).withColumn("_e", F.least(F.col("_s") + size - 1, F.col("_last")))
    alone = (F.col("_s") == F.col("_last")) & (F.col("_s") > base)
    out = out.withColumn("window_end", F.when(alone, F.col("_last")).otherwise(F.col("_e")).cast("int")).withColumn("window_start", F.when(alone, F.col("_s") - size).otherwise(F.col("_s")).cast("int"))
    folded = (F.col("window_start") == F.col("_last") - size) & ((F.col("_last") - base) % size == 0)
    out = out.withColumn("window_end", F.when(folded, F.col("_last")).otherwise(F.col("window_end")).cast("int"))
    return out.withColumn("time_window", F.concat_ws("-", "window_start", "window_end")).drop("_s", "_e", "_last")


def known_subjects(rows: DataFrame) -> DataFrame:
    """Rows whose two subject levels are there and not 'Unknown'."""
    return rows.where("subject_l1 != 'Unknown' AND subject_l2 != 'Unknown'")


def dedupe_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, by `order`, of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def subject_weight(rows: DataFrame) -> DataFrame:
    """Adds n_subjects_article_all, n_subjects_article_network and subject_weight: an article's
    weight of 1 is shared by its known distinct second-level subjects."""
    w = Window.partitionBy("master_id")
    known = F.when(F.col("subject_l2") != "Unknown", F.col("subject_l2"))
    out = rows.withColumn("n_subjects_article_all", F.size(F.collect_set("subject_l2").over(w))).withColumn("n_subjects_article_network", F.size(F.collect_set(known).over(w)))
    return out.withColumn("subject_weight", F.when((F.col("subject_l2") == "Unknown") | (F.col("n_subjects_article_network") == 0), 0.0).otherwise(1.0 / F.col("n_subjects_article_network")))


def with_share(rows: DataFrame, value: str, by: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Adds each row's part of the total of `value`, in its group or overall."""
    total = F.sum(value).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return rows.withColumn(name, F.when(total > 0, F.col(value) / total).otherwise(0.0))


def distribution(rows: DataFrame, keys: Sequence[str], share_by: Sequence[str] = ()) -> DataFrame:
    """Weighted and distinct counts, authors and years by `keys`, with the share of weight in `share_by`."""
    out = rows.groupBy(*keys).agg(
        F.sum("subject_weight").alias("weighted_article_count"),
        F.countDistinct("master_id").alias("article_count"),
        F.countDistinct("author").alias("author_count"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )
    return with_share(out, "weighted_article_count", share_by, "share_of_articles")


def level_by_time(rows: DataFrame, level: str) -> DataFrame:
    """By window and subject level: weight, distinct articles and authors, share, and for the
    first level its distinct second-level subjects."""
    aggregates = [F.sum("subject_weight").alias("weighted_article_count"), F.countDistinct("master_id").alias("article_count"), F.countDistinct("author").alias("author_count")]
    if level == "subject_l1":
        aggregates.append(F.countDistinct("subject_l2").alias("l2_count"))
    keys = ["time_window", "subject_l1"] + (["subject_l2"] if level == "subject_l2" else [])
    return with_share(rows.groupBy(*keys).agg(*aggregates), "weighted_article_count", ["time_window"], "share_of_window")


def diversity(rows: DataFrame) -> DataFrame:
    """Per window: total weight, Shannon entropy, HHI, top-3 and top-5 shares of second-level
    subjects, numbers of subjects; article_count adds up per-subject counts and so counts an
    article once per subject, distinct_article_count counts it once."""
    each = rows.groupBy("time_window", "subject_l1", "subject_l2").agg(F.sum("subject_weight").alias("w"), F.countDistinct("master_id").alias("n"))
    each = with_share(each, "w", ["time_window"], "p").withColumn("rank", F.row_number().over(Window.partitionBy("time_window").orderBy(F.desc("p"), "subject_l2")))
    out = each.groupBy("time_window").agg(
        F.sum("w").alias("total_weighted"),
        (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("shannon"),
        F.sum(F.col("p") * F.col("p")).alias("hhi"),
        F.sum(F.when(F.col("rank") <= 3, F.col("p")).otherwise(0.0)).alias("top3_share"),
        F.sum(F.when(F.col("rank") <= 5, F.col("p")).otherwise(0.0)).alias("top5_share"),
        F.countDistinct("subject_l1").alias("n_l1"),
        F.countDistinct("subject_l2").alias("n_l2"),
        F.sum("n").alias("article_count"),
    )
    return out.join(rows.groupBy("time_window").agg(F.countDistinct("master_id").alias("distinct_article_count")), "time_window")


def subject_degree(rows: DataFrame) -> DataFrame:
    """Strength (weight) and degree (distinct authors) of each subject in each window."""
    return rows.groupBy("time_window", "subject_l1", "subject_l2").agg(F.sum("subject_weight").alias("strength"), F.countDistinct("author").alias("degree"), F.countDistinct("master_id").alias("article_count"))


def author_stats(rows: DataFrame, keys: Sequence[str] = ("author",), count_unknown: bool = False) -> DataFrame:
    """Articles and subjects by author; 'Unknown' counts as a subject only on demand."""
    subject = F.col("subject_l2") if count_unknown else F.when(F.col("subject_l2") != "Unknown", F.col("subject_l2"))
    return rows.groupBy(*keys).agg(F.countDistinct("master_id").alias("article_count"), F.countDistinct(subject).alias("subject_count"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def author_articles(rows: DataFrame) -> DataFrame:
    """One row per author and article with its subjects, distinct and sorted, joined by '; '."""
    return rows.groupBy("author", "master_id").agg(F.min("title").alias("title"), F.min("year").alias("year"), joined_distinct("subject_l1").alias("subjects_l1"), joined_distinct("subject_l2").alias("subjects_l2"))


def collapse_metadata(rows: DataFrame, order: str) -> DataFrame:
    """One row per article: first values in row order, subjects joined in order of first
    appearance, subject:weight pairs, and the number of rows."""

    def ordered(value: Column) -> Column:
        pairs = F.sort_array(F.collect_list(F.struct(F.col(order), value.alias("v"))))
        return F.array_join(F.array_distinct(F.transform(pairs, lambda p: p["v"])), " | ")

    pair = F.concat_ws(":", "subject_l2", F.format_string("%.4f", "subject_weight"))
    return rows.groupBy("master_id").agg(
        F.min_by("author", order).alias("author"),
        F.min_by("title", order).alias("title"),
        F.min_by("year", order).alias("year"),
        ordered(F.col("subject_l1")).alias("subject_l1_list"),
        ordered(F.col("subject_l2")).alias("subject_l2_list"),
        ordered(pair).alias("subject_weights"),
        F.count("*").alias("metadata_row_count"),
    )


def author_nodes(rows: DataFrame, order: str = "pos") -> DataFrame:
    """A_i by first appearance, with years and counts."""
    out = rows.groupBy("author").agg(F.min(order).alias("_at"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("master_id").alias("article_count"), F.countDistinct("subject_l2").alias("subject_count"))
    return labelled(out, "node_id", "A_%d", "_at", "author").select("node_id", F.col("author").alias("node_label"), F.lit("author").alias("node_type"), "first_year", "last_year", "article_count", "subject_count", F.lit(None).cast("string").alias("subject_l1"), F.lit(None).cast("bigint").alias("author_count"))


def subject_nodes(rows: DataFrame, order: str = "pos") -> DataFrame:
    """S_i by first appearance, with years and counts."""
    out = rows.groupBy("subject_l2", "subject_l1").agg(F.min(order).alias("_at"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("master_id").alias("article_count"), F.countDistinct("author").alias("author_count"))
    return labelled(out, "node_id", "S_%d", "_at", "subject_l2").select("node_id", F.col("subject_l2").alias("node_label"), F.lit("subject").alias("node_type"), "first_year", "last_year", "article_count", F.lit(None).cast("bigint").alias("subject_count"), "subject_l1", "author_count")


def article_edges(rows: DataFrame, order: str = "pos") -> DataFrame:
    """Author-subject edges of every article, with the nodes' ids. Nodes are numbered by first
    appearance alone; up to a bound they are broadcast, so that articles don't shuffle."""
    a = labelled(rows.groupBy("author").agg(F.min(order).alias("_at")), "from_id", "A_%d", "_at", "author").select("from_id", "author")
    s = labelled(rows.groupBy("subject_l2", "subject_l1").agg(F.min(order).alias("_at")), "to_id", "S_%d", "_at", "subject_l2").select("to_id", "subject_l2")
    for nodes, key in ((keep(a, "nodes"), "author"), (keep(s, "nodes"), "subject_l2")):
        rows = rows.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes, key)
    return rows.select("from_id", "to_id", "author", "subject_l2", "subject_l1", "master_id", "title", "year", "time_window", "subject_weight")


def time_edges(rows: DataFrame) -> DataFrame:
    """Edges by author, subject and window: articles, weight, years, distinct titles."""
    return rows.groupBy("author", "subject_l2", "subject_l1", "time_window").agg(
        F.countDistinct("master_id").alias("article_count"), F.sum("subject_weight").alias("weight"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), joined_distinct("title", " | ").alias("titles")
    )


def override_mapping(base: DataFrame, corrected: DataFrame, key: str) -> DataFrame:
    """`corrected`, and the rows of `base` whose key it lacks."""
    return base.join(corrected.select(key).distinct(), key, "left_anti").unionByName(corrected)
