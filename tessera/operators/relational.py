"""Relational export tables with surrogate keys, and the read-side queries of the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbering import labelled


def articles(rows: DataFrame) -> DataFrame:
    return rows.select("master_id", "title", "year", "volume", "time_window").distinct()


def _numbered(rows: DataFrame, prefix: str, name: str, *order: str) -> DataFrame:
    """Dense keys by sorted value."""
    return labelled(rows, name, f"{prefix}_%05d", *order)


def authors(rows: DataFrame) -> DataFrame:
    return _numbered(rows.select(F.col("author").alias("author_name")).distinct(), "AUTH", "author_id", "author_name").select("author_id", "author_name")


def subjects(rows: DataFrame) -> DataFrame:
    return _numbered(rows.select("subject_l1", "subject_l2").distinct(), "SUBJ", "subject_id", "subject_l1", "subject_l2").select("subject_id", "subject_l1", "subject_l2")


def article_authors(rows: DataFrame) -> DataFrame:
    return rows.select("master_id", F.col("author").alias("author_name")).distinct().join(authors(rows), "author_name").select("master_id", "author_id")


def article_subjects(rows: DataFrame) -> DataFrame:
    return rows.select("master_id", "subject_l1", "subject_l2", "subject_weight").distinct().join(subjects(rows), ["subject_l1", "subject_l2"]).select("master_id", "subject_id", "subject_weight")


def author_details(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("author").alias("author_name"), "master_id", "subject_l2").distinct()


def time_windows(rows: DataFrame) -> DataFrame:
    """Windows with the years their label names."""
    year = lambda k: F.regexp_extract("time_window", "^([0-9]{4})-([0-9]{4})$", k).cast("int")
    return rows.select("time_window").distinct().select("time_window", year(1).alias("start_year"), year(2).alias("end_year"))


def page_filter(rows: DataFrame, window: str | None = None, l1_prefix: str | None = None, needles: dict[str, str] | None = None) -> DataFrame:
    """Rows of the window and first-level subjects in which any needle occurs in its column."""
    if window is not None:
        rows = rows.where(F.col("time_window") == window)
    if l1_prefix is not None:
        rows = rows.where(F.col("subject_l1").startswith(l1_prefix))
    if needles:
        hit = F.lit(False)
        for column, needle in needles.items():
            hit = hit | F.contains(F.lower(column), F.lit(needle.lower()))
        rows = rows.where(hit)
    return rows


def top_by_sum(rows: DataFrame, key: str, value: str, n: int, name: str = "weight") -> DataFrame:
    """The n keys of the largest sums; ties by key."""
    return rows.groupBy(key).agg(F.sum(value).alias(name)).orderBy(F.desc(F.round(name, 9)), key).limit(n)


def heatmap(rows: DataFrame, key: str, by: str, value: str, n: int) -> DataFrame:
    """Sums by key and `by` for the n keys of the largest sums."""
    top = top_by_sum(rows, key, value, n).select(key)
    return rows.join(F.broadcast(top), key, "left_semi").groupBy(key, by).agg(F.sum(value).alias("weight"))


def ddl(frame: DataFrame, name: str, keys: tuple[str, ...] = ()) -> str:
    """CREATE TABLE text for a frame's columns."""
    kinds = {"string": "TEXT", "int": "INT", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}
    columns = [f"  `{f.name}` {'VARCHAR(255)' if f.name in keys and f.dataType.simpleString() == 'string' else kinds.get(f.dataType.simpleString(), 'TEXT')}" for f in frame.schema]
    if keys:
        columns.append("  PRIMARY KEY (" + ", ".join(f"`{k}`" for k in keys) + ")")
    return f"CREATE TABLE `{name}` (\n" + ",\n".join(columns) + "\n);"
