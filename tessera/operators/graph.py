"""Graph measures of the author-subject network."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.written import keep

#: The most nodes of the right side, and the longest ways between them in steps of two, that
#: a table of all their pairs is made for; the left nodes of one block.
NARROW, DEPTH, BLOCK = 2048, 16, 8192


def degrees(edges: DataFrame, by: Sequence[str], left: str, right: str) -> DataFrame:
    """(by, node, node_type, degree): distinct neighbours of the nodes of either side."""
    pairs = edges.select(*by, left, right).distinct()
    side = lambda c: pairs.groupBy(*by, F.col(c).alias("node"), F.lit("author" if c == left else "subject").alias("node_type")).agg(F.count("*").alias("degree"))
    return side(left).unionByName(side(right))


class Network:
    """An undirected graph as two integer arrays: each node's neighbours, one after the other."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        """a, b: the numbers of the ends of each edge, which are distinct pairs; every node from 0 on has an edge."""
        ends, others = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(ends, kind="stable")
        self.neighbour = others[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(ends))[:-1]])

    def _summed(self, values: np.ndarray) -> np.ndarray:
        """For each row of node values the sum over each node's neighbours."""
        return np.add.reduceat(values[:, self.neighbour], self.start, axis=1)

    def betweenness(self, sources: np.ndarray, room: int = 8_000_000) -> np.ndarray:
        """Each node's share of the shortest paths from the sources to all others, halved: many
        sources at a time, their breadth-first levels ahead and back."""
        out, step = np.zeros(len(self.start)), max(1, room // max(1, len(self.neighbour)))
        for at in range(0, len(sources), step):
            own = sources[at : at + step]
            rows = np.arange(len(own))
            level = np.full((len(own), len(self.start)), -1, np.int32)
            paths = np.zeros(level.shape)
            level[rows, own], paths[rows, own], depth = 0, 1.0, 0
            while (front := level == depth).any():
                reached = self._summed(np.where(front, paths, 0.0))
                new = (reached > 0) & (level < 0)
                depth += 1
                level[new], paths[new] = depth, reached[new]
            flow = np.zeros(level.shape)
            for d in range(depth - 1, 0, -1):
                share = self._summed(np.divide(1 + flow, paths, out=np.zeros(level.shape), where=level == d))
                flow += np.where(level == d - 1, paths * share, 0.0)
            flow[rows, own] = 0.0
            out += flow.sum(axis=0) / 2
        return out


class Sides:
    """A two-sided graph by its right side: distances and numbers of shortest paths between
    right nodes, by which those of any two nodes follow from their neighbours.

    Left nodes of the same neighbours are one row with a weight. A shortest path between left
    nodes passes one right node at each odd distance, so that products of a block's rows with
    another's give paths and shares of all pairs at once.
    """

    def __init__(self, distance: np.ndarray, paths: np.ndarray):
        self.distance, self.paths = distance, paths
        self.levels = list(range(2, int(distance.max()) + 1, 2))

    @classmethod
    def of(cls, common: np.ndarray, depth: int = DEPTH) -> Sides | None:
        """From the numbers of common neighbours; None if ways are longer than `depth` steps."""
        n = len(common)
        step = common.astype(float)
        np.fill_diagonal(step, 0.0)
        distance, paths = np.full((n, n), -1, np.int16), np.zeros((n, n))
        np.fill_diagonal(distance, 0)
        front = np.eye(n)
        for level in range(1, n + 1):
            reached = front @ step
            front = np.where(distance < 0, reached, 0.0)
            new = front > 0
            if not new.any():
                return cls(distance, paths)
            if level > depth:
                return None
            distance[new], paths[new] = 2 * level, front[new]
        return cls(distance, paths)

    def at(self, level: int) -> np.ndarray:
        return np.where(self.distance == level, self.paths, 0.0)

    def rows(self, near: np.ndarray) -> dict[int, np.ndarray]:
        """By odd distance: paths from left nodes, given by their neighbours, to the right nodes so far away."""
        out, free = {1: near}, near == 0
        for level in self.levels:
            if not free.any():
                break
            found = np.where(free, near @ self.at(level), 0.0)
            if (new := found > 0).any():
                out[level + 1], free = found, free & ~new
        return out

    def between_right(self) -> np.ndarray:
        """Each right node's share of the shortest paths between two others."""
        out = np.zeros(len(self.distance))
        for level in self.levels:
            share = _inverse(self.at(level))
            for k in range(2, level, 2):
                out += (self.at(k) * (share @ self.at(level - k))).sum(axis=0) / 2
        return out

    def from_left(self, near: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """... between a left node and a right one."""
        out, rows = np.zeros(near.shape[1]), self.rows(near)
        for far, paths in rows.items():
            share = _inverse(paths) if far > 1 else None
            for k in (k for k in rows if k < far):
                out += weight @ (rows[k] * (share @ self.at(far - k)))
        return out

    def between_left(self, a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, same: bool, size: int = 1024) -> np.ndarray:
        """... between a left node of one block and one of another; of a block and itself each pair once."""
        out = np.zeros(a.shape[1])
        for i in range(0, len(a), size):
            own, w = self.rows(a[i : i + size]), wa[i : i + size]
            for j in range(i if same else 0, len(b), size):
                others, v = self.rows(b[j : j + size]), wb[j : j + size]
                pairs = np.outer(w, v)
                if same and i == j:
                    pairs[np.diag_indices(len(w))] = w * (w - 1)
                    pairs /= 2
                free = pairs > 0
                for far in sorted(others):
                    # Nodes without a common neighbour are farther apart: most graphs end here.
                    paths = own[1] @ others[far].T
                    share = np.divide(pairs, paths, out=np.zeros(pairs.shape), where=free & (paths > 0))
                    for k in range(1, far + 1, 2):
                        if k in own and far + 1 - k in others:
                            out += (own[k] * (share @ others[far + 1 - k])).sum(axis=0)
                    free &= paths == 0
                    if not free.any():
                        break
        return out


def _inverse(x: np.ndarray) -> np.ndarray:
    return np.divide(1.0, x, out=np.zeros(x.shape), where=x > 0)


def _near(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, (n + 7) // 8), axis=1, count=n).astype(float)


def betweenness(edges: DataFrame, by: str, left: str, right: str, work: int = 400_000_000, narrow: int = NARROW, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(by, node, betweenness) of the right side's nodes, unweighted and undirected.

    Where a window has at most `narrow` right nodes, its left nodes are rows of a bit for each
    right node, in blocks of about `block`, and a task takes two blocks: its memory doesn't
    grow with the graph. Every two left nodes are a pair whose paths count, so that the time
    grows with the square of the different rows. Windows of more right nodes, or of ways
    of over `depth` steps between them, go to by_sources(), in parts of `work` nodes times edges.
    """
    pairs = keep(edges.select(by, F.col(left).alias("_l"), F.col(right).alias("_r")).where(F.col(by).isNotNull() & F.col("_l").isNotNull() & F.col("_r").isNotNull()).distinct(), "edges")
    names = keep(pairs.select(by, "_r").distinct(), "nodes")
    sizes = names.groupBy(by).agg(F.count("*").cast("int").alias("_n"))
    index = names.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy("_r")) - 1).join(F.broadcast(sizes.where(F.col("_n") <= narrow)), by)
    rows = pairs.join(F.broadcast(index), [by, "_r"]).groupBy(by, "_n", "_l").agg(F.sort_array(F.collect_list("_k")).alias("_near"))
    rows = keep(rows.groupBy(by, "_n", "_near").agg(F.count("*").alias("_weight")), "rows")
    blocks = rows.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    rows = rows.join(F.broadcast(blocks), by).withColumn("_block", F.pmod(F.xxhash64("_near"), F.col("_blocks")).cast("int"))

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        n = int(own["_n"].iloc[0])
        bits = np.zeros((len(own), n), np.uint8)
        bits[np.repeat(np.arange(len(own)), own["_near"].map(len)), np.concatenate(own["_near"].tolist())] = 1
        return pd.DataFrame({by: own[by].iloc[:1], "_n": [n], "_block": own["_block"].iloc[:1], "_bits": [np.packbits(bits, axis=1).tobytes()], "_weights": [own["_weight"].to_numpy(float).tobytes()]})

    packed = keep(rows.groupBy(by, "_block").applyInPandas(pack, f"{by} string, _n int, _block int, _bits binary, _weights binary"), "blocks")

    def centre(own: pd.DataFrame) -> pd.DataFrame:
        n, common = int(own["_n"].iloc[0]), 0.0
        for bits, weights in zip(own["_bits"], own["_weights"]):
            near = _near(bits, n)
            common = common + near.T @ (near * np.frombuffer(weights)[:, None])
        sides = Sides.of(common, depth)
        none = sides is None
        return pd.DataFrame({by: own[by].iloc[:1], "_distance": [b"" if none else sides.distance.tobytes()], "_paths": [b"" if none else sides.paths.tobytes()]})

    centres = keep(packed.groupBy(by).applyInPandas(centre, f"{by} string, _distance binary, _paths binary"), "centres")
    known = centres.where(F.length("_distance") > 0)
    number = packed.groupBy(by).count().agg(F.sum(F.col("count") * (F.col("count") + 1) / 2)).first()[0]
    other = packed.select(by, F.col("_block").alias("_other"), F.col("_bits").alias("_other_bits"), F.col("_weights").alias("_other_weights"))
    units = packed.join(other, by).where("_block <= _other").join(F.broadcast(known), by).repartition(int(min(4000, max(1, number or 1))), by, "_block", "_other")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                n, same = r["_n"], r["_block"] == r["_other"]
                sides = Sides(np.frombuffer(r["_distance"], np.int16).reshape(n, n), np.frombuffer(r["_paths"]).reshape(n, n))
                a, wa, b, wb = _near(r["_bits"], n), np.frombuffer(r["_weights"]), _near(r["_other_bits"], n), np.frombuffer(r["_other_weights"])
                found = sides.between_left(a, wa, b, wb, same)
                if same:
                    found = found + sides.from_left(a, wa)
                if same and r["_block"] == r["_first"]:
                    found = found + sides.between_right()
                yield pd.DataFrame({by: r[by], "_k": np.arange(n, dtype=np.int32), "_s": found})

    units = units.join(F.broadcast(packed.groupBy(by).agg(F.min("_block").alias("_first"))), by)
    parts = units.mapInPandas(run, f"{by} string, _k int, _s double").groupBy(by, "_k").agg(F.sum("_s").alias("betweenness"))
    out = parts.join(F.broadcast(index.select(by, "_k", "_r")), [by, "_k"]).select(by, F.col("_r").alias("node"), "betweenness")
    rest = keep(sizes.select(by).join(known.select(by), by, "left_anti"), "rest")
    return out if rest.isEmpty() else out.unionByName(by_sources(pairs.join(F.broadcast(rest), by), by, work))


def by_sources(pairs: DataFrame, by: str, work: int = 400_000_000, most: int = 32) -> DataFrame:
    """betweenness() of distinct edges (by, _l, _r) from one source after the other.

    A window's graph is packed in one task, whose memory bounds it: some 100 bytes an edge, so
    ten million edges a window in a gigabyte. It goes to at most `most` tasks, at 8 bytes an
    edge each; a task takes a part of the sources, and the contributions add up.
    """

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        a, _ = pd.factorize(own["_l"], sort=True)
        b, names = pd.factorize(own["_r"], sort=True)
        first = int(a.max()) + 1
        blocks = int(min(most, -(-(first + len(names)) * len(own) // work)))
        return pd.DataFrame({by: own[by].iloc[:1], "_a": [a.astype(np.int32).tobytes()], "_b": [(b + first).astype(np.int32).tobytes()], "_names": [list(names)], "_blocks": [blocks]})

    graphs = keep(pairs.groupBy(by).applyInPandas(pack, f"{by} string, _a binary, _b binary, _names array<string>, _blocks int"), "graphs")
    spread = graphs.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).repartition(most, by, "_block")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                a, b = np.frombuffer(r["_a"], np.int32), np.frombuffer(r["_b"], np.int32)
                first = int(a.max()) + 1
                found = Network(a, b).betweenness(np.arange(r["_block"], first + len(r["_names"]), r["_blocks"]))
                yield pd.DataFrame({by: r[by], "node": list(r["_names"]), "betweenness": found[first:]})

    parts = spread.mapInPandas(run, f"{by} string, node string, betweenness double")
    return parts.groupBy(by, "node").agg(F.sum("betweenness").alias("betweenness"))
