"""Sinks: CSV tables, the relational export with its DDL, and metadata columns by alias."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import first_present
from tessera.operators import biblio, places, relational, text

#: The columns that may hold a field, in order of preference.
ALIASES: Mapping[str, Sequence[str]] = {
    "master_id": ("master_id", "matched_master_id"),
    "filename": ("text_file", "filename"),
    "title": ("title", "matched_title"),
    "author": ("author", "matched_author", "author_raw"),
    "year": ("year", "matched_year", "filename_year_hint"),
    "volume": ("volume",),
    "issue": ("issue", "number"),
    "decade": ("decade",),
    "L1": ("subject_l1_list", "subject_l1", "L1 subject", "L1"),
    "L2": ("subject_l2_list", "subject_l2", "L2 subject", "L2"),
    "language": ("detected_language", "language"),
}


def existing(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that the frame has."""
    return frame.select(*[F.col(f"`{c}`") for c in columns if c in frame.columns])


def ordered(frame: DataFrame, first: Sequence[str]) -> DataFrame:
    """The frame with `first` in front, as far as it has them, and the rest as it was."""
    front = [c for c in first if c in frame.columns]
    return frame.select(*[F.col(f"`{c}`") for c in front + [c for c in frame.columns if c not in front]])


def by_alias(frame: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """One text column per field: the first alias that isn't blank, null where there is none."""
    out = []
    for field, names in aliases.items():
        own = [F.col(f"`{n}`").cast("string") for n in names if n in frame.columns]
        out.append((first_present(*own) if own else F.lit(None).cast("string")).alias(field))
    return frame.select(*out)


def write_csv(frame: DataFrame, path: str) -> None:
    """A folder of CSV files with headers and doubled quotes; the committer swaps it in whole."""
    frame.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_rows(frame: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the Parquet table at `path` lacks; makes the table if need be."""
    spark = frame.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        frame = frame.join(spark.read.parquet(path).select(key), key, "left_anti")
    frame.write.mode("append").parquet(path)


def title_tables(rows: DataFrame) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
    """Tables of the words of titles: by window, by window and subject, and by article."""
    known = biblio.known_subjects(rows)
    titled = lambda r, *more: r.select("master_id", "time_window", "title", *more).distinct()
    own = titled(rows).select("master_id", "time_window", text.title_tokens(F.col("title")).alias("tokens"))
    terms = text.unnested(own, "tokens", "term", "master_id", "time_window")
    pairs = text.unnested(own, text.bigrams(F.col("tokens")), "bigram", "master_id", "time_window")
    counted = lambda r, *keys: r.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("master_id").alias("article_count"))
    subject = titled(known, "subject_l1").select("master_id", "time_window", "subject_l1", text.title_tokens(F.col("title")).alias("tokens"))
    by_subject = counted(text.unnested(subject, "tokens", "term", "master_id", "time_window", "subject_l1"), "time_window", "subject_l1", "term")
    return {
        "title_term_time_stats": (counted(terms, "time_window", "term"), ("time_window", "term")),
        "title_bigram_time_stats": (counted(pairs, "time_window", "bigram"), ("time_window", "bigram")),
        "title_tfidf_time_stats": (text.count_tfidf(counted(terms, "time_window", "term").drop("article_count"), "term", "time_window", "n"), ("time_window", "term")),
        "title_term_subject_time_stats": (text.count_tfidf(by_subject, "term", "time_window", "n"), ("time_window", "subject_l1", "term")),
        "article_title_terms": (terms.groupBy("master_id", "time_window", "term").agg(F.count("*").alias("n")), ("master_id", "term")),
    }


def place_tables(found: DataFrame, rows: DataFrame) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
    """Tables of places (master_id, time_window, historical_name, modern_name) of articles."""
    subjects = biblio.known_subjects(rows).select("master_id", "subject_l1", "subject_l2").distinct()
    return {
        "title_place_time_stats": (places.place_counts(found, "time_window"), ("time_window", "modern_name")),
        "title_place_subject_time_stats": (places.place_counts(found.join(subjects, "master_id"), "time_window", "subject_l1", "subject_l2"), ("time_window", "subject_l2", "modern_name")),
        "article_title_places": (places.article_places(found), ("master_id", "modern_name")),
        "title_place_name_mapping": (places.name_mapping(found), ("historical_name", "modern_name")),
    }


def export_tables(rows: DataFrame, found: DataFrame | None = None) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
    """The relational tables of article-subject rows by name, each with its primary key; with
    those of places if `found`, the articles' places, is given."""
    known = biblio.known_subjects(rows)
    return {
        "articles": (relational.articles(rows), ("master_id",)),
        "authors": (relational.authors(rows), ("author_id",)),
        "article_authors": (relational.article_authors(rows), ("master_id", "author_id")),
        "author_article_details": (relational.author_details(rows), ()),
        "author_article_stats": (biblio.author_stats(rows, count_unknown=True), ("author",)),
        "author_article_stats_by_time_window": (biblio.author_stats(rows, ["author", "time_window"], count_unknown=True), ("author", "time_window")),
        "subjects": (relational.subjects(rows), ("subject_id",)),
        "article_subjects": (relational.article_subjects(rows), ("master_id", "subject_id")),
        "time_windows": (relational.time_windows(rows), ("time_window",)),
        "subject_distribution_all_years": (biblio.distribution(known, ["subject_l1", "subject_l2"]), ("subject_l2",)),
        "subject_distribution_time_window": (biblio.distribution(known, ["time_window", "subject_l1", "subject_l2"], ["time_window"]), ("time_window", "subject_l2")),
        "subject_l1_time_stats": (biblio.level_by_time(known, "subject_l1"), ("time_window", "subject_l1")),
        "subject_l2_time_stats": (biblio.level_by_time(known, "subject_l2"), ("time_window", "subject_l2")),
        "subject_diversity_stats": (biblio.diversity(known), ("time_window",)),
        "subject_network_centrality_stats": (biblio.subject_degree(known), ("time_window", "subject_l2")),
        "network_nodes": (biblio.author_nodes(known).unionByName(biblio.subject_nodes(known)), ("node_id",)),
        "network_article_edges": (biblio.article_edges(known), ()),
        "network_time_edges": (biblio.time_edges(known), ()),
        **title_tables(rows),
        **(place_tables(found, rows) if found is not None else {}),
    }


def export(spark: SparkSession, tables: Mapping[str, tuple[DataFrame, tuple[str, ...]]], folder: str, url: str | None = None, properties: Mapping[str, str] | None = None) -> str:
    """Writes each table as Parquet under `folder`, and to a JDBC database if `url` is given;
    returns the DDL of all. Columns are written by name, so their order can't shift."""
    for name, (frame, _) in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
        if url:
            spark.read.parquet(f"{folder}/{name}").write.mode("overwrite").jdbc(url, name, properties=dict(properties or {}))
    return "\n\n".join(relational.ddl(frame, name, keys) for name, (frame, keys) in tables.items())
