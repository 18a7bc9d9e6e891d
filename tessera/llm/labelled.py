"""A bounded, reproducible sample of labelled rows to fit a classifier on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.llm.shared import discard, keep


def class_sample(documents: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int) -> tuple[DataFrame, float]:
    """(doc_id, text, y) of at most `per_class` ids of each class, those with the smallest
    hashes; and the log odds of class 1 among all usable labels.

    Only ids are sorted; as at most 2 * per_class of them are kept they are broadcast to the
    documents, whose texts don't shuffle. An id with several labels has their largest; null
    labels and ids don't count; labels of no document are dropped by the join.
    """
    own = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    each = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = each[0].unionByName(each[1])
    sample = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return sample, math.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))


def within(rows: DataFrame, most: int) -> list[Row]:
    """Rows (doc_id, y, size, data) whose sizes add up to at most `most`, half of it for each
    class, in the order of the hashes of their ids, whatever their place in the files. A row
    that doesn't fit in what is left is passed over; the ones after it still count.
    """
    table = keep(rows.withColumn("row", F.monotonically_increasing_id()), "sample")
    order = sorted(table.select(F.xxhash64("doc_id").alias("hash"), "doc_id", "row", "y", "size").collect())
    left, chosen = {0: most // 2, 1: most - most // 2}, {}
    for r in order:
        if r["size"] <= left[r.y]:
            left[r.y] -= r["size"]
            chosen[r.row] = len(chosen)
    ids = table.sparkSession.createDataFrame([(k,) for k in chosen], "row long")
    found = list(table.join(F.broadcast(ids), "row", "left_semi").toLocalIterator())
    discard(table)
    return sorted(found, key=lambda r: chosen[r.row])
