"""Connected components by alternating large-star and small-star steps.

Every step is a min-aggregate and an equi-join, so no neighbourhood is ever collected
into one task or the driver. Each round's edges are written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, keep


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for each node of the edges that isn't its own root.

    Within one task this turns any number of edges into fewer than there are nodes.
    """
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of `edges` (a, b); component is the smallest node.

    Nulls and loops are ignored, repeated and reversed edges count once, an empty table
    gives an empty table. Raises if `rounds` rounds, enough for any path that fits in
    2**60 nodes, don't settle.
    """
    at = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    at, before = keep(at, "edges"), None
    for _ in range(rounds):
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
        last, at = at, keep(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        discard(last)
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
