"""Joins with domain rules: title matching, year overlap, containment, positions, nearest
rows. Candidates come from an index of the titles or from equi-joins on years, anchors or
time buckets, never from a full product."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_EVEN, Decimal
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import normalize_for_match
from tessera.operators.text import unnested


def map_subjects(rows: DataFrame, rules: DataFrame, key: str = "subject") -> DataFrame:
    """Second and first levels and a note by a table of rules; 'Unknown' where there is none."""
    out = rows.join(rules, key, "left")
    return out.withColumns({"subject_l2": F.coalesce("subject_l2", F.lit("Unknown")), "subject_l1": F.coalesce("subject_l1", F.lit("Unknown")), "mapping_note": F.coalesce("mapping_note", F.lit("no rule"))})


def containment(texts: DataFrame, items: DataFrame, text: str = "text", item: str = "item_text") -> DataFrame:
    """(doc_id, item_id) where the text holds the item, character by character.

    The inner words of an item stand as whole words in any text that holds it, so up to four
    of them are an anchor for an equi-join of ids and runs of words; only pairs that meet
    fetch their texts. Items of one or two words have no inner word and are compared with
    every text.
    """
    own = items.select("item_id", F.col(item).alias("_item"), F.split(item, " ").alias("_w")).where(F.length(item) > 0)
    own = own.withColumn("_size", F.least(F.lit(4), F.size("_w") - 2))
    long = own.where("_size > 0").select("item_id", "_item", "_size", F.array_join(F.slice("_w", F.lit(2), F.col("_size")), " ").alias("_anchor"))
    sizes = sorted(r[0] for r in long.select("_size").distinct().collect())  # of 1 to 4

    def runs(n: int) -> Column:
        return F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    short = own.where("_size <= 0").select("item_id", "_item")
    found = texts.select("doc_id", F.col(text).alias("_text")).join(short, F.contains("_text", "_item")).select("doc_id", "item_id")
    for n in sizes:
        words = texts.select("doc_id", F.split(text, " ").alias("_w"))
        rows = unnested(words, F.array_distinct(runs(n)), "_anchor", "doc_id")
        met = rows.join(long.where(F.col("_size") == n), "_anchor").select("doc_id", "item_id", "_item").distinct()
        found = found.unionByName(texts.select("doc_id", F.col(text).alias("_text")).join(met, "doc_id").where(F.contains("_text", "_item")).select("doc_id", "item_id"))
    return found.distinct()


def title_tokens(title: Column) -> Column:
    return F.filter(F.split(normalize_for_match(title), " "), lambda t: F.length(t) > 2)


def confidence(score: Column, margin: Column, tied: Column, bonus: Column) -> Column:
    """Label of the best match; conflicting years go first, then ties."""
    return (
        F.when(bonus < 0, F.when(score >= 70, "review_year_conflict").otherwise("unmatched"))
        .when(tied & (score < 100), "review_tied_best")
        .when((score >= 92) & (margin >= 5), "high")
        .when((score >= 84) & (margin >= 4), "medium")
        .when(score >= 70, "review")
        .otherwise("unmatched")
    )


class TitleIndex:
    """Titles by their tokens: scores a text against every title without a pair per title."""

    def __init__(self, rows: list[tuple[int, int | None, str, list[str]]]):
        """rows: (master_id, title_year, normalised title, its tokens of over two letters)."""
        rows = sorted(rows, key=lambda r: r[0])
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.years = np.array([np.nan if r[1] is None else r[1] for r in rows], np.float64)
        self.norms = [r[2] for r in rows]
        self.sizes = np.array([len(r[3]) for r in rows], np.int64)
        found: dict[str, list[int]] = {}
        for k, r in enumerate(rows):
            for token in r[3]:
                found.setdefault(token, []).append(k)
        self.postings = {t: np.array(at, np.int32) for t, at in found.items()}
        # Scores of k of n tokens, rounded half to even once for every n that occurs.
        lengths = sorted(set(self.sizes.tolist()))
        starts = dict(zip(lengths, np.concatenate([[0], np.cumsum([n + 1 for n in lengths])[:-1]]).tolist())) if lengths else {}
        self.at = np.array([starts[n] for n in self.sizes.tolist()], np.int64)
        self.cheap, self.near = ([float(Decimal(repr(k / n * most if n else 0.0)).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) for n in lengths for k in range(n + 1)] for most in (75.0, 85.0))
        self.cheap, self.near = np.array(self.cheap), np.array(self.near)

    def _counts(self, groups: list[set[str]], slots: np.ndarray, width: int) -> np.ndarray:
        """How many tokens of the titles in `slots` each group of words holds."""
        found = [[self.postings[t] for t in g if t in self.postings] for g in groups]
        flat = [p for own in found for p in own]
        if not flat:
            return np.zeros((len(groups), width), np.int64)
        of_group = np.repeat(np.arange(len(groups)), [sum(map(len, own)) for own in found])
        at = slots[np.concatenate(flat)]
        return np.bincount((of_group * width + at)[at >= 0], minlength=len(groups) * width).reshape(len(groups), width)

    def best(self, lines: list[str], year: int | None, preselect: int) -> list[tuple[int, float, int, float]]:
        """(master_id, title_score, year_bonus, cheap score) of the `preselect` best by cheap score, best first."""
        if not len(self.ids):
            return []
        whole = " ".join(filter(None, lines))
        hits = self._counts([set(whole.split(" "))], np.arange(len(self.ids)), len(self.ids))[0]
        cheap = self.cheap[self.at + hits]
        # Only the first and the last token of a title can be parts of longer words of a text that holds it.
        inside = np.zeros(len(self.ids), bool)
        for k in np.flatnonzero(hits >= self.sizes - 2).tolist():
            inside[k] = self.norms[k] != "" and self.norms[k] in whole
        cheap[inside] = 100.0
        bonus = np.zeros(len(self.ids)) if year is None else np.where(self.years == year, 12, -12)
        score = cheap + bonus
        least = np.partition(score, -preselect)[-preselect] if len(score) > preselect else -np.inf
        kept = np.flatnonzero(score >= least)
        kept = kept[np.lexsort((self.ids[kept], -score[kept]))][:preselect]
        slots = np.full(len(self.ids), -1, np.int64)
        slots[kept] = np.arange(len(kept))
        words = [set(x.split(" ")) for x in lines[:45]]
        windows = [a | b for a, b in zip(words, [*words[1:], set()])]
        local = self._counts(windows, slots, len(kept)).max(axis=0, initial=0)
        sure = (local >= 0.99 * self.sizes[kept]) & (self.sizes[kept] > 0)
        full = np.where(inside[kept], 100.0, np.where(sure, 92.0, np.maximum(self.cheap[self.at[kept] + hits[kept]], self.near[self.at[kept] + local])))
        return list(zip(self.ids[kept].tolist(), full.tolist(), bonus[kept].astype(int).tolist(), cheap[kept].tolist()))


def match_titles(texts: DataFrame, titles: DataFrame, preselect: int = 18, top: int = 5, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, master_id, rank, title_score, year_bonus, combined_score): the best titles of
    each text (doc_id, text, year) among titles (master_id, title, title_year).

    Texts count with their first 8,000 characters. Every title counts: a cheap score keeps
    `preselect` of them, the full score ranks those. Ties by master_id; ids are unique. The
    titles are an index that is sent to the tasks in blocks of `block_chars` characters, so
    texts don't shuffle and no pairs are made; of several blocks each gives its own first
    `preselect`, which hold the first of all.
    """
    lines = F.transform(F.filter(F.split(F.substring("text", 1, 8000), "\n"), lambda x: F.trim(x) != ""), normalize_for_match)
    heads = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("year").cast("long").alias("year"), F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    title = F.coalesce("title", F.lit(""))
    metas = titles.select(F.col("master_id").cast("long").alias("master_id"), F.col("title_year").cast("int").alias("title_year"), normalize_for_match(title).alias("norm"), title_tokens(title).alias("tokens"))
    size = metas.agg(F.coalesce(F.sum(F.length("norm") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    spark, parts = texts.sparkSession, []
    for block in range(blocks):
        own = metas if blocks == 1 else metas.where(F.pmod(F.xxhash64("master_id"), F.lit(blocks)) == block)
        index = spark.sparkContext.broadcast(TitleIndex([(r.master_id, r.title_year, r.norm, r.tokens) for r in own.collect()]))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    rows = []
                    for doc, year, own in zip(*(batch.slice(at, 500).column(c).to_pylist() for c in ("doc_id", "year", "lines"))):
                        rows += [(doc, *r) for r in index.value.best(own, year, preselect)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

        names, kinds = ["doc_id", "master_id", "title_score", "year_bonus", "cheap"], [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64()]
        parts.append(heads.mapInArrow(run, "doc_id long, master_id long, title_score double, year_bonus int, cheap double"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    if blocks > 1:
        first = Window.partitionBy("doc_id").orderBy(F.desc(F.col("cheap") + F.col("year_bonus")), "master_id")
        rows = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= preselect)
    rows = rows.withColumn("combined_score", F.col("title_score") + F.col("year_bonus"))
    last = Window.partitionBy("doc_id").orderBy(F.desc("combined_score"), "master_id")
    return rows.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top).select("doc_id", "master_id", "rank", "title_score", "year_bonus", "combined_score")


def match_labels(ranked: DataFrame) -> DataFrame:
    """The best title of each text with its margin and label."""
    w = Window.partitionBy("doc_id").orderBy("rank")
    second, second_combined = F.lead("title_score").over(w), F.lead("combined_score").over(w)
    out = ranked.withColumn("margin", F.col("title_score") - F.coalesce(second, F.lit(0.0))).withColumn("_tied", F.coalesce(F.abs(F.col("combined_score") - second_combined) < 0.01, F.lit(False))).where("rank = 1")
    return out.select("doc_id", "master_id", "title_score", "margin", "year_bonus", confidence(F.col("title_score"), F.col("margin"), F.col("_tied"), F.col("year_bonus")).alias("match_confidence"))


def token_f1(a: Column, b: Column) -> Column:
    """Multiset F1 of two token arrays."""
    both = F.array_distinct(F.array_intersect(a, b))
    times = lambda x, t: F.size(F.filter(x, lambda y: y == t))
    common = F.aggregate(both, F.lit(0), lambda s, t: s + F.least(times(a, t), times(b, t)))
    return F.when(F.size(a) + F.size(b) > 0, 2.0 * common / (F.size(a) + F.size(b))).otherwise(0.0)


def year_overlap_best(left: DataFrame, right: DataFrame, score: Column, left_title: str = "a", right_title: str = "b") -> DataFrame:
    """For each row of left (l_id, l_years, left_title) the row of right (r_id, r_years,
    right_title) with a year in common and the best score; ties by r_id. The score is of the titles.

    A shared year is the join key. Rows of one title and years are one row of the join, with
    the smallest r_id, and each pair of titles is scored once: a year costs its distinct
    titles of one side times those of the other, which a score of any two titles asks for.
    """
    asks = left.select("l_years", left_title).distinct().withColumn("year", F.explode("l_years"))
    offers = right.withColumn("year", F.explode("r_years")).groupBy("year", right_title).agg(F.min("r_id").alias("r_id"))
    pairs = asks.join(offers, "year").groupBy("l_years", left_title, right_title).agg(F.min("r_id").alias("r_id"))
    scores = pairs.select(left_title, right_title).distinct().withColumn("score", score)
    best = F.min(F.struct((-F.round("score", 9)).alias("s"), "r_id", "score"))
    best = pairs.join(scores, [left_title, right_title]).groupBy("l_years", left_title).agg(best.alias("_b"))
    return left.join(best, ["l_years", left_title]).select("l_id", F.col("_b.r_id").alias("r_id"), F.col("_b.score").alias("score"))


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_id, r_id, score, match_status): every row of left (l_id, l_years, a) with its best
    title of right (r_id, r_years, b) by bag_title_score(); 'no_year_candidate' without one."""
    best = year_overlap_best(left, right, bag_title_scores("a", "b"))
    rows = left.select("l_id", "a").join(best, "l_id", "left")
    status = F.when(F.col("r_id").isNull(), "no_year_candidate").otherwise(match_status(F.col("score"), F.size(F.array_distinct("a"))))
    return rows.select("l_id", "r_id", "score", status.alias("match_status"))


def bag_title_score(a: Sequence[str], b: Sequence[str]) -> float:
    """Title similarity by bags of tokens, letter order and containment, 0 to 1."""
    a, b = list(a), list(b)
    if not a or not b:
        return 0.0
    common = sum((Counter(a) & Counter(b)).values())
    if common < min(len(a), len(b)):
        left, spare = [t for t in a if t not in b], [t for t in b if t not in a]
        for t in left:
            best = max(spare, key=lambda u: SequenceMatcher(None, t, u).ratio(), default=None)
            if best is not None and SequenceMatcher(None, t, best).ratio() >= 0.86:
                spare.remove(best)
                common += 1
    f1 = 2 * common / (len(a) + len(b))
    ratio = SequenceMatcher(None, " ".join(sorted(a)), " ".join(sorted(b))).ratio()
    shorter = min(len(set(a)), len(set(b)))
    inside = 1.0 if set(a) <= set(b) or set(b) <= set(a) else 0.98 if shorter >= 4 and common >= 3 and common / shorter >= 0.75 else 0.0
    return max(0.72 * f1 + 0.28 * ratio, 0.94 * inside)


def bag_title_scores(a: str | Column, b: str | Column) -> Column:
    """bag_title_score() of two array columns."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([bag_title_score(p, q) for p, q in zip(x, y)])

    return run(a, b)


def match_status(score: Column, distinct_tokens: Column) -> Column:
    return F.when((score >= 0.92) & (distinct_tokens >= 2), "accepted").when((score >= 0.82) & (distinct_tokens >= 3), "review").otherwise("manual")


def zip_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], order_left: str, order_right: str) -> DataFrame:
    """Rows of both sides joined by position within `keys`, with why a pair is incomplete."""
    number = lambda o: F.row_number().over(Window.partitionBy(*keys).orderBy(o))
    a, b = left.withColumn("position", number(order_left)), right.withColumn("position", number(order_right))
    reason = F.when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right").otherwise("")
    return a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), [*keys, "position"], "full_outer").withColumn("reason", reason).drop("_a", "_b")


def nearest(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, tolerance: float) -> DataFrame:
    """Each left row with the nearest right row of its key within `tolerance`, if any; ties by
    right_id. Buckets as wide as the tolerance make it an equi-join of three buckets."""
    bucket = lambda c: F.floor(F.col(c) / tolerance)
    a = left.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket(left_at) + d)))
    pairs = a.join(right.withColumn("_bucket", bucket(right_at)), [key, "_bucket"]).withColumn("distance", F.abs(F.col(left_at) - F.col(right_at))).where(F.col("distance") <= tolerance)
    best = pairs.groupBy("left_id").agg(F.min(F.struct("distance", "right_id")).alias("b"))
    return left.join(best, "left_id", "left").select("left_id", F.col("b.right_id").alias("right_id"), F.col("b.distance").alias("distance"))


def greedy_nearest(left: list[tuple[int, float]], right: list[tuple[int, float]], tolerance: float = 28.0) -> list[tuple[int | None, int | None]]:
    """Rows of a page side by side: each left row, from the top, takes the nearest right row
    that is still free within `tolerance`; free right rows follow."""
    free, out = dict(right), []
    for k, y in sorted(left, key=lambda r: (r[1], r[0])):
        best = min(free, key=lambda j: (abs(free[j] - y), j), default=None)
        if best is not None and abs(free[best] - y) <= tolerance:
            out.append((k, best))
            free.pop(best)
        else:
            out.append((k, None))
    return out + [(None, j) for j, _ in sorted(free.items(), key=lambda r: (r[1], r[0]))]


def greedy_nearest_by_page(rows: DataFrame, tolerance: float = 28.0) -> DataFrame:
    """greedy_nearest() for each page of rows (page, side, row_id, y)."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        side = lambda s: list(zip(page.loc[page["side"] == s, "row_id"].tolist(), page.loc[page["side"] == s, "y"].tolist()))
        pairs = greedy_nearest(side("left"), side("right"), tolerance)
        return pd.DataFrame({"page": page["page"].iloc[0], "left_id": pd.array([a for a, _ in pairs], "Int64"), "right_id": pd.array([b for _, b in pairs], "Int64")})

    return rows.groupBy("page").applyInPandas(run, "page long, left_id long, right_id long")
