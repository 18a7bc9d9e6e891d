"""SimHash near-duplicates: fingerprints of word shingles, linked by vantage-point trees.

A fingerprint's distance to a vantage point obeys the triangle inequality on every block
of bits, and bounds on disjoint blocks add up. Pairs within `radius` bits of 64 are
within `radius // 2` bits on one half at least, so each half has a tree of its own: its
upper levels deal fingerprints into shards by their rings around vantage points, a
fingerprint is also sent to the shards whose boundary lies within reach, and a tree in
the shard prunes the rest before the whole fingerprints are compared. All pairs are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import connected_components, forest
from tessera.llm.shared import as_bytes, keep, small_batches, table

SEED = 42
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of each run of `size` words; of the whole sequence if there are fewer."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - size] + 1])
    return [hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())]


def fingerprints(texts: list[bytes], size: int = 4) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text: a bit is 1 if set in over half the hashes."""
    each = [shingle_hashes(t, size) for t in texts]
    counts = np.array([len(x) for x in each], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    hashes = np.fromiter((h for x in each for h in x), np.uint64, int(counts.sum()))
    first = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    # Eight byte-wide counters in a word hold up to 255 hashes before they are widened.
    parts = np.concatenate([np.arange(a, a + n, 255) for a, n in zip(first, counts[full])])
    part_of = np.searchsorted(parts, first)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, parts)
        wide = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), part_of, axis=0)
        ones = 2 * wide > counts[full, None]
        for byte in range(8):
            out[full] |= ones[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprint(documents: DataFrame, size: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns `carry`: the fingerprint of each whole text as a signed
    long. Null text: as empty, zero."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*carry, F.lit(0).alias("_")).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2_000_000):  # a shingle's hash takes some forty bytes while it is counted
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(as_bytes(batch.column("text")), size).view(np.int64)), batch.column("row")], names=["doc_id", "fp", "row"])

    found = rows.mapInArrow(run, f"doc_id long, fp long, row {rows.schema['row'].dataType.simpleString()}")
    return found.select("doc_id", "fp", *[F.col("row")[c].alias(c) for c in carry])


def spread_most(tried: np.ndarray, others: np.ndarray) -> np.uint64:
    """Of the points tried, the one whose distances to the others spread most: its rings part them best."""
    return tried[np.argmax(np.bitwise_count(tried[:, None] ^ others[None, :]).std(axis=1))]


def within(members: np.ndarray, queries: np.ndarray, radius: int, mask: int, reach: int, leaf: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all pairs (query, member) within `radius` bits, of which at most
    `reach` lie in `mask`; as a forest where a block of pairs is dense.

    A vantage-point tree: each level takes a vantage point among the members and 4 bits of
    `mask`, deals members by their distance to it there, and gives a query's branch what
    its distance to the ring leaves of `reach`.
    """
    bits = [b for b in range(64) if mask >> b & 1]
    blocks = [np.uint64(sum(1 << b for b in bits[i : i + 4])) for i in range(0, len(bits), 4)]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(m: np.ndarray, q: np.ndarray) -> None:
        step = max(1, 4_000_000 // len(m))
        for a in range(0, len(q), step):
            i, j = np.nonzero(np.bitwise_count(q[a : a + step, None] ^ m[None, :]) <= radius)
            if len(i):
                x, y = q[a + i], m[j]
                other = x != y
                x, y = x[other], y[other]
                found.append(forest(x, y) if len(x) > 4 * (len(m) + step) else (x, y))

    def descend(m: np.ndarray, q: np.ndarray, left: np.ndarray, level: int) -> None:
        if not len(m) or not len(q):
            return
        if len(m) * len(q) <= leaf or len(m) <= 8 or level == len(blocks):
            compare(m, q)
            return
        vantage = spread_most(m[:: len(m) // 8 + 1] & blocks[level], m[:: len(m) // 512 + 1] & blocks[level])
        ring_m, ring_q = np.bitwise_count((m & blocks[level]) ^ vantage).astype(np.int8), np.bitwise_count((q & blocks[level]) ^ vantage).astype(np.int8)
        for ring in range(5):
            rest = left - np.abs(ring_q - ring)
            on = rest >= 0
            descend(m[ring_m == ring], q[on], rest[on], level + 1)

    descend(members, queries, np.full(len(queries), reach, np.int8), 0)
    if not found:
        return members[:0], members[:0]
    return forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def _blocks(half: int, width: int) -> list[int]:
    """Masks of the `width`-bit blocks of a half."""
    return [((1 << width) - 1) << (32 * half + i) for i in range(0, 32, width)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _offsets(levels: int, reach: int) -> list[tuple[int, ...]]:
    """Steps between shards in reach, one of each opposite pair: pairs are found once."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(levels):
        out = [(*o, d) for o in out for d in range(-reach, reach + 1) if sum(map(abs, o)) + abs(d) <= reach]
    return [o for o in out if o >= (0,) * levels]


def vantage_points(sample: np.ndarray, half: int, width: int, candidates: int = 16) -> list[int]:
    """For each block the fingerprint of the sample whose distances to the others spread most."""
    out = []
    for mask in _blocks(half, width):
        own = sample & np.uint64(mask)
        out.append(int(spread_most(own[:candidates], own)))
    return out


def near_links(fps: DataFrame, radius: int = 4, count: int | None = None, sample_rows: int = 1024, block_rows: int = 250_000) -> DataFrame:
    """(a, b): edges between distinct fingerprints `fp` (long) that connect all pairs within
    `radius` bits, and no others; a dense group gives a forest, not its pairs.

    Vantage points come from at most `sample_rows` fingerprints. A shard of over
    `block_rows` is cut into blocks of members and blocks of queries that all meet.

    Growth: narrower blocks give more shards, up to 100 million distinct fingerprints; beyond
    that the shards stay 2 * 5**8, the fullest, in the middle of all rings, holds (3/8)**8 of
    all rows, four in ten thousand, and what it compares grows with the square of that.
    """
    reach = radius // 2
    n = fps.count() if count is None else count
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(sample_rows).collect()], np.int64).view(np.uint64)
    if len(sample) < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    width = 16 if n <= 4_000_000 else 8 if n <= 100_000_000 else 4
    routed = None
    for half in (0, 1):
        vantage = vantage_points(sample, half, width)
        ring = lambda mask, v: F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long")).bitwiseXOR(F.lit(_signed(v)).cast("long"))).cast("int")
        at = fps.select("fp", F.array(*[ring(m, v) for m, v in zip(_blocks(half, width), vantage)]).alias("rings"))
        steps = F.array(*[F.array(*[F.lit(x) for x in o]) for o in _offsets(32 // width, reach)])
        sent = at.select("fp", F.explode(steps).alias("step"), "rings").select(
            "fp", F.zip_with("rings", "step", lambda r, s: r + s).alias("to"), (F.aggregate("step", F.lit(0), lambda a, s: a + F.abs(s)) == 0).alias("home")
        )
        sent = sent.where(~F.exists("to", lambda r: (r < 0) | (r > width)))
        shard = F.aggregate("to", F.lit(half).cast("long"), lambda a, r: a * (width + 1) + r)
        sent = sent.select(shard.alias("shard"), F.lit(half).alias("half"), "fp", "home")
        routed = sent if routed is None else routed.unionByName(sent)
    sizes = routed.groupBy("shard", "half").agg(F.count(F.when(F.col("home"), 1)).alias("own"), F.count("*").alias("sent")).where("own > 0 and sent > 1")
    sizes = sizes.select("shard", "half", F.ceil(F.col("own") / block_rows).cast("int").alias("mb"), F.ceil(F.col("sent") / (4 * block_rows)).cast("int").alias("qb"))
    # The number of shards is fixed by `width`, whatever the input: at most 2 * 9**4 or 2 * 5**8 rows, of which few are full.
    dealt = routed.join(F.broadcast(sizes) if width == 16 else sizes, ["shard", "half"])
    spot = lambda seed, n: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_query = F.transform(every("mb"), lambda i: F.struct(i.alias("m"), spot(2, "qb").alias("q"), (F.col("home") & (i == spot(1, "mb")) & (F.col("qb") == 1)).alias("member"), F.lit(True).alias("query")))
    as_member = F.when(F.col("home") & (F.col("qb") > 1), F.transform(every("qb"), lambda j: F.struct(spot(1, "mb").alias("m"), j.alias("q"), F.lit(True).alias("member"), F.lit(False).alias("query")))).otherwise(F.array().cast("array<struct<m:int,q:int,member:boolean,query:boolean>>"))
    dealt = dealt.select("shard", "half", "fp", F.explode(F.concat(as_query, as_member)).alias("x")).select("shard", "half", "fp", "x.m", "x.q", "x.member", "x.query")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        member, query = rows["member"].to_numpy(bool), rows["query"].to_numpy(bool)
        a, b = within(fp[member], fp[query], radius, 0xFFFFFFFF << 32 * int(rows["half"].iloc[0]), reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("shard", "half", "m", "q").applyInPandas(search, "a long, b long")


def simhash_components(documents: DataFrame, radius: int = 4, size: int = 4) -> DataFrame:
    """(doc_id, fp, component_id, root): groups of texts whose fingerprints link at `radius` bits or fewer.

    root is one fingerprint of the group, the same for all of it; component_id is the smallest doc_id reachable, a document's own if it has no link.
    Null and empty texts have fingerprint zero and link as any other; repeated rows stay;
    a null doc_id gets the smallest other id of its group, or null. Other columns are
    ignored. An empty table gives an empty result.
    """
    docs = keep(fingerprint(documents, size), "fingerprints")
    classes = keep(docs.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    count = classes.count()
    links = keep(near_links(classes.select("fp"), radius, count), "links")
    parts = connected_components(links)
    roots = parts.join(classes, parts["node"] == classes["fp"]).groupBy("component").agg(F.min("low").alias("least"))
    moved = parts.join(roots, "component").select(F.col("node").alias("fp"), "least", "component")
    own = classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id"), F.coalesce("component", "fp").alias("root"))
    return docs.join(own, "fp").select("doc_id", "fp", "component_id", "root")


def op8_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for all documents."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
