"""Set and dictionary operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_aliases(value: Column, aliases: dict[str, str]) -> Column:
    """The alias of a value, or the value itself."""
    pairs = [F.lit(x) for pair in aliases.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[value], value) if pairs else value


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those already processed."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def multiset_overlap(left: DataFrame, right: DataFrame, key: str, token: str) -> DataFrame:
    """(key, common): the size of the multiset intersection of both sides' tokens by key."""
    a = left.groupBy(key, token).agg(F.count("*").alias("_a"))
    b = right.groupBy(key, token).agg(F.count("*").alias("_b"))
    return a.join(b, [key, token]).groupBy(key).agg(F.sum(F.least("_a", "_b")).alias("common"))
