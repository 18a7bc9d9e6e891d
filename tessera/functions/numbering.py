"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.written import keep


def numbered(rows: DataFrame, name: str, *order: str, buckets: int = 128) -> DataFrame:
    """Adds 1, 2, ... in the order of the columns, nulls first.

    Rows are dealt out by all of the columns: at most `buckets` - 1 of their values, those of
    the smallest hashes, are boundaries. Each bucket numbers its rows; its offset comes from
    the buckets' counts, a table of `buckets` rows. Only rows that are equal in all columns
    are sure to share a bucket. The rows are written once: boundaries, counts and numbers each
    read them.
    """
    rows = keep(rows, "numbered")
    key = F.struct(*order)
    kinds = [rows.schema[c].dataType for c in order]
    pivots = rows.select(*order).distinct().orderBy(F.xxhash64(*order), *order).limit(buckets - 1).collect()
    bounds = [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(r, kinds, order)]) for r in pivots]
    bucket = F.size(F.filter(F.array(*bounds), lambda b: b <= key)) if bounds else F.lit(0)
    dealt = rows.withColumn("_bucket", bucket)
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(offsets), "_bucket").withColumn(name, (F.col("_own") + F.col("_before")).cast("bigint")).drop("_bucket", "_own", "_before")


def labelled(rows: DataFrame, name: str, pattern: str, *order: str) -> DataFrame:
    """numbered(), as text by a printf pattern."""
    return numbered(rows, "_number", *order).withColumn(name, F.format_string(pattern, F.col("_number"))).drop("_number")
