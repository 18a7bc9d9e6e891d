"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Every shard is queried by the vectors of the others, each pair of shards once. The beam is
widened until audits against brute force pass: on noisy copies of the shard's members, which
always have true pairs, and on a sample of each batch of queries. Found pairs are verified by
cosine in double precision. Tasks return counts at both ends and a forest of their links,
never all pairs of a group; components are then united over the shards.

Graphs are tables of one row per node, so they are written, dealt out and read in batches of
rows like the vectors, and no cell grows with a shard.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import connected_components, forest
from tessera.llm.shared import discard, keep, table


#: Entries that the lists of a block of queries may have before the block is made smaller.
MOST_MET = 2_000_000


class Graph:
    """A layered proximity graph over unit vectors, built and searched many rows at a time."""

    def __init__(self, x: np.ndarray, links: int = 12, width: int = 48, seed: int = 3):
        """x: unit length. links: neighbours a node chooses; it keeps up to twice as many."""
        self.x, self.links, self.n = x.astype(np.float32, copy=False), links, len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(self.n)) / np.log(links)).astype(int), 6)
        self.order = np.argsort(-level, kind="stable").astype(np.int32)
        self.x = self.x[self.order]
        level = level[self.order]
        self.sizes = [int((level >= k).sum()) for k in range(int(level[0]) + 1)] if self.n else []
        self.layers = [self._layer(size, width) for size in self.sizes]

    @classmethod
    def of_rows(cls, x: np.ndarray, neighbours: np.ndarray, lengths: np.ndarray, links: int = 12) -> Graph:
        """The graph of node_links() of all nodes, whose vectors in the same order are x."""
        out = cls.__new__(cls)
        out.x, out.links, out.n, out.order = x.astype(np.float32), links, len(x), np.arange(len(x), dtype=np.int32)
        begins, width = np.cumsum(lengths) - lengths, 2 * links
        out.sizes = [int((lengths > k * width).sum()) for k in range(int(lengths.max(initial=0)) // width)]
        out.layers = [neighbours[begins[:size, None] + (k * width + np.arange(width))] for k, size in enumerate(out.sizes)]
        return out

    def node_links(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of nodes low..high-1, each node's layers from the lowest up, and how many each node has."""
        high = min(high, self.n)
        every, held = np.full((high - low, len(self.sizes), 2 * self.links), -1, np.int32), np.zeros((high - low, len(self.sizes)), bool)
        for k, (size, layer) in enumerate(zip(self.sizes, self.layers)):
            some = layer[low : min(high, size)]
            every[: len(some), k], held[: len(some), k] = some, True
        return every[held].ravel(), held.sum(axis=1) * (2 * self.links)

    def _layer(self, size: int, width: int) -> np.ndarray:
        """Nodes 0..size-1, which are the layer's, in batches: the first by brute force, then
        each by searching what is there, together with its own batch."""
        held = np.full((size, 2 * self.links), -1, np.int32)
        score = np.full((size, 2 * self.links), -np.inf, np.float32)
        done = 0
        while done < size:
            stop = min(size, max(done + 256, done + done // 4))
            stop = min(stop, done + 1024)
            new = np.arange(done, stop)
            within = self.x[new] @ self.x[new].T
            np.fill_diagonal(within, -np.inf)
            top = min(self.links * 2, len(new) - 1)
            near = np.argpartition(-within, top - 1, axis=1)[:, :top] if top else np.zeros((len(new), 0), int)
            ids, sims = new[near], np.take_along_axis(within, near, axis=1)
            if done:
                parts = []
                for some in np.array_split(new, -(-len(new) // self._rows())):
                    found, found_sims = self._beam(held[:done], self.x[some], np.zeros(len(some), np.int32), width, np.inf)
                    best = np.argsort(-found_sims, axis=1, kind="stable")[:, : 2 * width]  # a beam's lists have at least four times its width
                    parts.append((np.take_along_axis(found, best, axis=1), np.take_along_axis(found_sims, best, axis=1)))
                found, found_sims = map(np.vstack, zip(*parts))
                ids, sims = np.hstack([ids, found]), np.hstack([sims, found_sims])
            chosen, near = self._choose(new, ids, sims, self.links)
            held[done:stop, : self.links], score[done:stop, : self.links] = chosen, near
            k, at = np.nonzero(chosen >= 0)
            self._link_back(held, score, chosen[k, at], new[k], near[k, at])
            done = stop
        return held

    def _rows(self, rows: int = 256) -> int:
        """Queries in a block: a byte for each of them and each node."""
        return max(8, min(rows, 64_000_000 // max(1, self.n)))

    def _choose(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node, of its row of candidates those nearer to it than to any already
        chosen, then the nearest of the rest: `most` ids and similarities, padded with -1."""
        out, out_sims = np.full((len(nodes), most), -1, np.int32), np.full((len(nodes), most), -np.inf, np.float32)
        step = max(16, 32_000_000 // (16 * most * self.x.shape[1] + 1))
        for a in range(0, len(nodes), step):
            i, s = ids[a : a + step], np.where((ids[a : a + step] >= 0) & (ids[a : a + step] != nodes[a : a + step, None]), sims[a : a + step], -np.inf)
            order = np.argsort(-s, axis=1, kind="stable")[:, : 4 * most]
            i, s = np.take_along_axis(i, order, axis=1), np.take_along_axis(s, order, axis=1)
            usable = np.isfinite(s)
            usable &= ~np.tril(i[:, :, None] == i[:, None, :], -1).any(axis=2)
            v = self.x[np.where(usable, i, 0)]
            between = v @ v.transpose(0, 2, 1)
            chosen = np.zeros(usable.shape, bool)
            for k in range(usable.shape[1]):
                nearest = np.where(chosen, between[:, k], -np.inf).max(axis=1)
                chosen[:, k] = usable[:, k] & (nearest < s[:, k]) & (chosen.sum(axis=1) < most)
            rest = usable & ~chosen
            chosen |= rest & (np.cumsum(rest, axis=1) <= most - chosen.sum(axis=1)[:, None])
            order = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
            kept = np.take_along_axis(chosen, order, axis=1)
            out[a : a + step, : order.shape[1]] = np.where(kept, np.take_along_axis(i, order, axis=1), -1)
            out_sims[a : a + step, : order.shape[1]] = np.where(kept, np.take_along_axis(s, order, axis=1), -np.inf)
        return out, out_sims

    def _link_back(self, held: np.ndarray, score: np.ndarray, to: np.ndarray, new: np.ndarray, sims: np.ndarray) -> None:
        """Offers each of `to` its link from `new`; a node keeps the best choice of what it has
        and its nearest offers, as many of these as it can hold links."""
        width = held.shape[1]
        order = np.lexsort((-sims, to))
        to, new, sims = to[order], new[order], sims[order]
        nodes, first, of_node = np.unique(to, return_index=True, return_inverse=True)
        place = np.arange(len(to)) - first[of_node]
        fits = place < width
        offered, offered_sims = np.full((len(nodes), width), -1, np.int32), np.full((len(nodes), width), -np.inf, np.float32)
        offered[of_node[fits], place[fits]], offered_sims[of_node[fits], place[fits]] = new[fits], sims[fits]
        held[nodes], score[nodes] = self._choose(nodes, np.hstack([held[nodes], offered]), np.hstack([score[nodes], offered_sims]), width)

    def _beam(self, held: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int, threshold: float, most_met: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, similarities) of all nodes that each query has met, -1 where there is none.

        Best first: each query opens its nearest unopened node, `width` times, and goes on
        for as long as that node passes `threshold`, so no number of partners is a limit.
        None if the lists of several queries would hold more than `most_met` entries: they
        are then to be asked in smaller blocks.
        """
        size, rows = len(held), np.arange(len(q))
        met = np.zeros((len(q), size), bool)
        met[rows, entry] = True
        cap = 4 * width
        ids, sims, open_sims = np.full((len(q), cap), -1, np.int32), np.full((len(q), cap), -np.inf, np.float32), np.full((len(q), cap), -np.inf, np.float32)
        ids[:, 0] = entry
        sims[:, 0] = open_sims[:, 0] = np.einsum("ij,ij->i", q, self.x[entry])
        used, opened, active = np.ones(len(q), int), np.zeros(len(q), int), rows
        while len(active):
            at = np.argmax(open_sims[active], axis=1)
            best = open_sims[active, at]
            going = np.isfinite(best) & ((opened[active] < width) | (best >= threshold))
            active, at = active[going], at[going]
            if not len(active):
                break
            open_sims[active, at] = -np.inf
            opened[active] += 1
            near = held[ids[active, at]]
            fresh = (near >= 0) & ~met[active[:, None], near]
            met[active[:, None], np.where(fresh, near, ids[active, at][:, None])] = True
            most = int(fresh.sum(axis=1).max(initial=0))
            if not most:
                continue
            order = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
            near, fresh = np.take_along_axis(near, order, axis=1), np.take_along_axis(fresh, order, axis=1)
            s = np.where(fresh, np.einsum("ij,ikj->ik", q[active], self.x[near]), -np.inf).astype(np.float32)
            if int(used[active].max()) + most > cap:
                more = max(cap, most)
                if most_met and len(q) > 1 and len(q) * (cap + more) > most_met:
                    return None
                ids, sims, open_sims = (np.hstack([a, np.full((len(q), more), f, a.dtype)]) for a, f in ((ids, -1), (sims, -np.inf), (open_sims, -np.inf)))
                cap += more
            to = used[active][:, None] + np.arange(most)
            ids[active[:, None], to] = np.where(fresh, near, -1)
            sims[active[:, None], to] = s
            open_sims[active[:, None], to] = s
            used[active] += fresh.sum(axis=1)
        return ids, sims

    def search(self, q: np.ndarray, width: int, threshold: float, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs whose single-precision similarity comes near `threshold`, block by block."""
        q = q.astype(np.float32)
        rows = step = self._rows(rows)
        a = 0
        while a < len(q):
            own = q[a : a + step]
            at = np.zeros(len(own), np.int32)
            for layer in self.layers[:0:-1]:
                ids, sims = self._beam(layer, own, at, 4, np.inf)
                at = ids[np.arange(len(own)), np.argmax(sims, axis=1)]
            met = self._beam(self.layers[0], own, at, width, threshold - 1e-3, MOST_MET)
            if met is None:
                step = max(1, len(own) // 2)
                continue
            ids, sims = met
            i, j = np.nonzero((ids >= 0) & (sims >= threshold - 1e-4))
            found = self.order[ids[i, j]]
            del met, ids, sims, j
            yield a + i, found
            a, step = a + len(own), min(rows, step + max(1, step // 4))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def directions(x: np.ndarray, dtype: type = np.float64) -> np.ndarray:
    """Unit vectors of finite ones of any size, computed in double precision block by block."""
    out = np.empty(x.shape, dtype)
    for a in range(0, len(x), 5000):
        v = x[a : a + 5000].astype(np.float64)
        out[a : a + 5000] = unit(v / np.abs(v).max(axis=1, keepdims=True))
    return out


def probes(x: np.ndarray, threshold: float, count: int, seed: int = 7) -> np.ndarray:
    """Unit vectors whose cosine to a member of `x` is `threshold` at least: noisy copies of
    members spread through it, so that an audit always has true pairs to find."""
    rng = np.random.default_rng(seed)
    near = x[np.unique(np.linspace(0, len(x) - 1, min(count, len(x))).astype(int))]
    noise = rng.normal(size=near.shape)
    noise -= np.einsum("ij,ij->i", noise, near)[:, None] * near
    size = np.sqrt(np.einsum("ij,ij->i", noise, noise))[:, None]
    cosine = threshold + (1 - threshold) * rng.uniform(0.02, 1, (len(near), 1))
    return unit(cosine * near + np.where(size > 1e-9, np.sqrt(1 - cosine**2) * noise / np.maximum(size, 1e-9), 0.0))


def _true(q: np.ndarray, x: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, MOST_MET // len(x))
    for a in range(0, len(q), step):
        i, j = np.nonzero(q[a : a + step] @ x.T >= threshold)
        yield a + i, j


class Shard:
    """A graph with its vectors, and the beam that its audits have found wide enough."""

    def __init__(self, graph: Graph, x: np.ndarray, threshold: float, recall: float = 0.98, width: int = 16):
        self.graph, self.x, self.threshold, self.recall, self.width = graph, x, threshold, recall, width
        self.true = self.found = 0
        self._audit(probes(x, threshold, 256))

    def _audit(self, q: np.ndarray) -> None:
        """Doubles the beam until `recall` of the brute-force pairs of `q` are found."""
        true = sum(len(i) for i, _ in _true(q, self.x, self.threshold))
        while True:
            found = true if self.width >= len(self.x) else sum(len(i) for i, _ in _verified(self.graph.search(q, self.width, self.threshold), q, self.x, self.threshold))
            if found >= self.recall * true:
                break
            self.width *= 2
        self.true, self.found = self.true + true, self.found + min(found, true)

    def linked(self, q: np.ndarray, sample: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Verified (query, node) pairs, after an audit on `sample` of the queries; once the
        beam would open every node the queries are compared by brute force instead."""
        self._audit(q[np.unique(np.linspace(0, len(q) - 1, min(sample, len(q))).astype(int))])
        if self.width < len(self.x):
            yield from _verified(self.graph.search(q, self.width, self.threshold), q, self.x, self.threshold)
        else:
            yield from _true(q, self.x, self.threshold)


def _verified(pairs: Iterator[tuple[np.ndarray, np.ndarray]], q: np.ndarray, x: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, j in pairs:
        cosine = np.concatenate([np.einsum("ij,ij->i", q[i[a : a + 20_000]], x[j[a : a + 20_000]]) for a in range(0, len(i), 20_000)]) if len(i) else np.zeros(0)
        yield i[cosine >= threshold], j[cosine >= threshold]


def _pieces(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Each run of rows that agree in the columns `names`, as a stream of slices."""

    def cut() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in names])
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    yield tuple(keys[low].tolist()), batch.slice(low, high - low)

    for key, run in groupby(cut(), key=lambda x: x[0]):
        yield key, (x for _, x in run)


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    return part.column("embedding").flatten().to_numpy().reshape(part.num_rows, -1)


def shard_graphs(members: DataFrame, shards: int) -> DataFrame:
    """(dim, shard, at, rep, copies, embedding, neighbours) for each row of `members`, which has
    all but `at` and `neighbours`: the node's place in the graph of its shard, and its links
    in all its layers."""
    value = members.schema["embedding"].dataType.elementType.simpleString()
    vector = pa.list_(pa.float32() if value == "float" else pa.float64())
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("at", pa.int32()), ("rep", pa.int64()), ("copies", pa.int64()), ("embedding", vector), ("neighbours", pa.list_(pa.int32()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, shard), parts in _pieces(batches, ("dim", "shard")):
            raw, reps, copies = zip(*((_matrix(p), p.column("rep").to_numpy(), p.column("copies").to_numpy()) for p in parts))
            raw, reps, copies = np.concatenate(raw), np.concatenate(reps), np.concatenate(copies)
            graph = Graph(directions(raw, np.float32))
            for low in range(0, len(reps), 5000):
                own = graph.order[low : low + 5000]
                neighbours, lengths = graph.node_links(low, low + 5000)
                lists = [(np.full(len(own), dim), raw[own].ravel()), (lengths, neighbours)]
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(v)) for n, v in lists]
                columns = [np.full(len(own), dim), np.full(len(own), shard), np.arange(low, low + len(own)), reps[own], copies[own]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, schema)), *lists], schema=schema)

    dealt = members.select("dim", "shard", "rep", "copies", "embedding").repartition(4 * shards, "dim", "shard").sortWithinPartitions("dim", "shard", "rep")
    return dealt.mapInArrow(build, f"dim int, shard int, at int, rep long, copies long, embedding array<{value}>, neighbours array<int>")


def _read_graph(parts: list[pa.RecordBatch]) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """The graph of rows of shard_graphs(), its vectors, and their ids and copies."""
    x = np.concatenate([directions(_matrix(p)) for p in parts])
    lengths = np.concatenate([p.column("neighbours").value_lengths().to_numpy() for p in parts])
    neighbours = np.concatenate([p.column("neighbours").flatten().to_numpy() for p in parts])
    reps, copies = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("rep", "copies"))
    return Graph.of_rows(x, neighbours, lengths), x, reps, copies


def near_vectors(vectors: DataFrame, threshold: float = 0.9, shards: int = 8, shard_bytes: int = 96_000_000, task_rows: int = 10_000, most_splits: int = 16, wave_bytes: int = 500_000_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) for each row of `vectors` (vec_id, embedding).

    Linked are vectors of one length whose cosine is at least `threshold`. Null or zero
    vectors and those with null or non-finite components link with nothing: 0 links, their
    own component, kept. Equal vectors are found as one class, which counts for all its
    rows. Repeated rows stay and count as links of each other; labels and other columns are
    ignored. audited_recall: the part of brute-force pairs found in all audits; null if there
    was nothing to audit.

    There are `shards` graphs, more only when one would exceed `shard_bytes`. Every shard is
    queried, each pair of shards once: the vectors of one query the graph of the other, and
    what is found counts at both ends. In a shard's own graph the later id of a pair finds
    the earlier. A task holds one graph and reads its queries as a stream; queries are split
    over at most `most_splits` tasks a graph, so a graph moves that often.

    Shards meet in waves: those at some distances of their numbers, then those at the next.
    A wave sends as many copies of all vectors as `wave_bytes` hold, and of all graphs as many
    again; one at the least. So disk grows with the vectors, not with vectors times shards.
    """
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    classes = rows.where("fine").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = keep(classes.select("embedding", "rep", "copies", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("key")), "vectors")
    count, longest = classes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    shards = max(shards, -(-count * (8 * longest + 128) // shard_bytes))
    copies_held = max(1, wave_bytes // max(1, count * ((4 if single else 8) * longest + 40)))
    splits = max(1, min(count // task_rows, most_splits, copies_held))
    home = F.pmod("key", F.lit(shards)).cast("int")
    split = F.pmod(F.hash("key"), F.lit(splits))
    graphs = keep(shard_graphs(classes.withColumn("shard", home), shards), "graphs")
    met = graphs.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def asked(distances: list[int]) -> DataFrame:
        # The other half of the shards sends its vectors here; of an even number the one opposite is asked from the lower side.
        to = F.transform(F.filter(F.array(*map(F.lit, distances)), lambda d: (2 * d != shards) | (home < shards // 2)), lambda d: F.pmod(home + d, F.lit(shards)).cast("int"))
        return classes.select("dim", F.explode(to).alias("shard"), split.alias("split"), home.alias("home"), "rep", "copies", "embedding")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of a graph come before those that ask it; a partition may hold several graphs, one after the other.
        for (_, at, _), parts in _pieces(batches, ("dim", "shard", "split")):
            nodes, shard, reps, copies = [], None, None, None
            for part in parts:
                own = len(part) - part.column("at").null_count
                if own:
                    nodes.append(part.slice(0, own))
                part = part.slice(own)
                if not part.num_rows or not (nodes or shard):  # a shard without members has no graph
                    continue
                if not shard:
                    graph, x, reps, copies = _read_graph(nodes)
                    nodes, shard = [], Shard(graph, x, threshold)
                q = directions(_matrix(part))
                ids, own = part.column("rep").to_numpy(), part.column("home").to_numpy() == at
                times, mine, theirs, a, b = part.column("copies").to_numpy(), np.zeros(len(q), np.int64), np.zeros(len(reps), np.int64), [], []
                for i, j in shard.linked(q):
                    once = ~own[i] | (ids[i] > reps[j])
                    i, j = i[once], j[once]
                    np.add.at(mine, i, copies[j])
                    np.add.at(theirs, j, times[i])
                    edges = forest(ids[i], reps[j])
                    a.append(edges[0])
                    b.append(edges[1])
                edges = forest(np.concatenate(a), np.concatenate(b)) if a else ([], [])
                some, others = np.flatnonzero(mine), np.flatnonzero(theirs)
                yield outcome(*edges, [(ids[some], mine[some]), (reps[others], theirs[others])], [])
            if shard:
                yield outcome([], [], [], [shard.true, shard.found])

    def outcome(a, b, counts, audit) -> pa.RecordBatch:
        """Edges with 0 links; counts as edges of a node to itself; an audit's sums as nodes -1 and -2 of no id."""
        rows = [(np.asarray(a, np.int64), np.asarray(b, np.int64), np.zeros(len(a), np.int64))]
        rows += [(i, i, n) for i, n in counts]
        left, right, links = (np.concatenate(x) for x in zip(*rows))
        if not audit:
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(links)], schema=schema)
        return pa.RecordBatch.from_arrays([pa.array([None, None], pa.int64()), pa.array([0, 1], pa.int64()), pa.array(audit, pa.int64())], schema=schema)

    def wave(distances: list[int]) -> DataFrame:
        dealt = met.unionByName(asked(distances), allowMissingColumns=True).repartition(4 * shards * splits, "dim", "shard", "split")
        dealt = dealt.sortWithinPartitions("dim", "shard", "split", F.col("at").asc_nulls_last(), "rep")
        return keep(dealt.mapInArrow(ask, "a long, b long, links long"), "links")

    every = list(range(shards // 2 + 1))
    waves = []
    for low in range(0, len(every), copies_held):
        waves.append(wave(every[low : low + copies_held]))
        if low + copies_held < len(every):  # Spark deletes a wave's shuffled rows only when the driver's collector has met it
            gc.collect()
            vectors.sparkSession.sparkContext._jvm.System.gc()
    found = vectors.sparkSession.read.schema(waves[0].schema).parquet(*(w._kept_at for w in waves))
    discard(graphs)
    true, hits = found.where("a IS NULL").agg(F.sum(F.when(F.col("b") == 0, F.col("links"))), F.sum(F.when(F.col("b") == 1, F.col("links")))).first()
    parts = connected_components(found.where("links = 0 AND a IS NOT NULL").select("a", "b"))
    degree = found.where("links > 0 AND a IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = classes.select("embedding", "rep", "copies").join(degree, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = rows.where("fine").join(known, "embedding").select("vec_id", "n_links", "component_id")
    lone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    recall = F.lit(hits / true if true else None).cast("double")
    return good.unionByName(lone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), recall.alias("audited_recall"))


def op6_hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings against all."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
