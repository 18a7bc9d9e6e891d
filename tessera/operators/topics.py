"""Tables around topic models: importance, labels, prevalence over time, diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import min_max
from tessera.operators.text import unnested


def whole() -> Window:
    """The window of all rows, for tables of a row a topic."""
    return Window.partitionBy(F.lit(0))


def counts(rows: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    """Rows by keys, without rows in which a key is null."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def labels(topic_words: DataFrame, n: int, name: str = "topic_words") -> DataFrame:
    """(topic_id, name): the first n words by rank, ', '-joined."""
    own = topic_words.where(F.col("rank") <= n).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w"))
    return own.select("topic_id", F.array_join(F.transform("w", lambda x: x["word"]), ", ").alias(name))


def described(topic_words: DataFrame, n: int) -> DataFrame:
    """(topic_id, interpretability, topic_words): interpretability() and labels() in one pass."""
    top = lambda k: F.sum(F.when(F.col("rank") <= k, F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    own = topic_words.groupBy("topic_id").agg(F.when(top(15) > 0, top(5) / top(15)).otherwise(0.0).alias("interpretability"), F.array_sort(F.collect_list(F.when(F.col("rank") <= n, F.struct("rank", "word")))).alias("w"))
    return own.select("topic_id", "interpretability", F.when(F.size("w") > 0, F.array_join(F.transform("w", lambda x: x["word"]), ", ")).alias("topic_words"))


def interpretability(topic_words: DataFrame) -> DataFrame:
    """(topic_id, interpretability): the part of the first 5 words' weights in the first 15's."""
    top = lambda n: F.sum(F.when(F.col("rank") <= n, F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    return topic_words.groupBy("topic_id").agg(F.when(top(15) > 0, top(5) / top(15)).otherwise(0.0).alias("interpretability"))


def importance(rows: DataFrame, topic_words: DataFrame, article: str = "doc_id") -> DataFrame:
    """Size, coverage and interpretability of each topic, scaled to 0..1, their mean and its
    rank. Topic -1 holds outliers and is left out. The tables are one row a topic."""
    valid = rows.where("topic_id != -1")
    total = valid.agg(F.count("*").alias("_rows"), F.countDistinct(article).alias("_articles"))
    out = valid.groupBy("topic_id").agg(F.count("*").alias("topic_size"), F.countDistinct(article).alias("article_count"))
    out = out.crossJoin(F.broadcast(total)).join(described(topic_words, 12), "topic_id", "left")
    out = out.withColumn("topic_size_share", F.col("topic_size") / F.col("_rows")).withColumn("article_coverage", F.col("article_count") / F.col("_articles")).withColumn("interpretability", F.coalesce("interpretability", F.lit(0.0)))
    return scored(out, {"coverage_score_norm": "article_coverage", "size_score_norm": "topic_size", "interpretability_score_norm": "interpretability"}, ["article_coverage", "topic_size"]).drop("_rows", "_articles")


def scored(rows: DataFrame, norms: dict[str, str], ties: Sequence[str]) -> DataFrame:
    """Adds scaled columns, their mean as importance_score, and importance_rank."""
    rows = rows.withColumns({name: min_max(column, whole()) for name, column in norms.items()})
    score = sum((F.col(n) for n in norms), F.lit(0.0)) / len(norms)
    order = [F.desc(F.round("importance_score", 9)), *[F.desc(t) for t in ties], F.asc("topic_id")]
    return rows.withColumn("importance_score", score).withColumn("importance_rank", F.row_number().over(Window.orderBy(*order)))


def by_decade_detailed(rows: DataFrame, decade: str, topic_words: DataFrame, article: str = "doc_id") -> DataFrame:
    """Counts by decade and topic, with their parts of the decade and of the topic."""
    out = rows.where((F.col("topic_id") != -1) & F.col(decade).isNotNull()).groupBy(decade, "topic_id").agg(F.count("*").alias("count"), F.countDistinct(article).alias("article_count"))
    share = lambda k: F.col("count") / F.sum("count").over(Window.partitionBy(k))
    return out.withColumn("share_of_decade", share(decade)).withColumn("share_of_topic", share("topic_id")).join(labels(topic_words, 6), "topic_id", "left")


def theta_by(theta: DataFrame, group: str, present: float = 0.05) -> DataFrame:
    """Mean prevalence of topics by group, and how many documents hold them."""
    on = F.col("theta") >= present
    return theta.groupBy(group, "topic_id").agg(F.avg("theta").alias("mean_theta"), F.count_if(on).alias("document_count"), F.avg(on.cast("int")).alias("document_share"))


def theta_importance(theta: DataFrame, topic_words: DataFrame, present: float = 0.05) -> DataFrame:
    """As importance(), from prevalences: size is their sum, its share their mean."""
    on = F.col("theta") >= present
    out = theta.groupBy("topic_id").agg(F.sum("theta").alias("topic_size"), F.avg("theta").alias("topic_size_share"), F.count_if(on).alias("article_count"), F.avg(on.cast("int")).alias("article_coverage"))
    out = out.join(interpretability(topic_words), "topic_id", "left").withColumn("interpretability", F.coalesce("interpretability", F.lit(0.0)))
    return scored(out, {"coverage_score_norm": "article_coverage", "size_score_norm": "topic_size", "interpretability_score_norm": "interpretability"}, ["article_coverage"])


def dominant_topic(theta: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, dominant_topic, max_theta): the first topic of the largest prevalence."""
    best = F.max(F.struct(F.col("theta"), (-F.col("topic_id")).alias("t")))
    return theta.groupBy(key).agg(best.alias("b")).select(key, (-F.col("b.t")).alias("dominant_topic"), F.col("b.theta").alias("max_theta"))


def diversity(topic_words: DataFrame, n: int = 10) -> DataFrame:
    """Distinct words as a part of all first n words, by model."""
    return topic_words.where(F.col("rank") <= n).groupBy("model").agg((F.countDistinct("word") / F.count("*")).alias("diversity"))


def exclusivity(topic_words: DataFrame, n: int = 10) -> DataFrame:
    """Mean over distinct first n words of 1 / topics that use them, by model."""
    used = topic_words.where(F.col("rank") <= n).groupBy("model", "word").agg(F.countDistinct("topic_id").alias("k"))
    return used.groupBy("model").agg(F.avg(1 / F.col("k")).alias("exclusivity"))


def concentration(theta: DataFrame) -> DataFrame:
    """Mean of the documents' largest prevalence, and topics of a sum under 0.01."""
    largest = theta.groupBy("doc_id").agg(F.max("theta").alias("m")).agg(F.avg("m").alias("concentration"))
    empty = theta.groupBy("topic_id").agg(F.sum("theta").alias("s")).agg(F.count_if(F.col("s") < 0.01).alias("near_empty_topics"))
    return largest.crossJoin(empty)


def semantic_coherence(docs: DataFrame, topic_words: DataFrame, n: int = 10) -> DataFrame:
    """Sum over ordered pairs of a topic's words of ln((D(i, j) + 1) / D(j)), D by documents.

    A document's tokens are reduced to the topics' words, a bounded list that goes to the
    tasks in one row, before anything is exploded; it then emits at most the pairs of one
    topic's n words for each topic, a word with itself among them, which counts D(j).
    """
    top = topic_words.where(F.col("rank") <= n).select("topic_id", "rank", "word")
    known = top.agg(F.collect_set("word").alias("_known"))
    held = docs.crossJoin(F.broadcast(known)).select("doc_id", F.array_intersect("tokens", "_known").alias("_w"))
    rows = unnested(held, "_w", "word", "doc_id").join(F.broadcast(top), "word")
    own = rows.groupBy("doc_id", "topic_id").agg(F.array_sort(F.collect_list("rank")).alias("w"))
    pairs = own.select("topic_id", F.explode(F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: b <= a), lambda b: F.struct(a.alias("i"), b.alias("j")))))).alias("p"))
    both = pairs.groupBy("topic_id", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.count("*").alias("dij"))
    single = both.where("i = j").select("topic_id", "j", F.col("dij").alias("d"))
    # Pairs that no document holds count as ln(1 / D(j)).
    every = top.alias("a").join(F.broadcast(top).alias("b"), (F.col("a.topic_id") == F.col("b.topic_id")) & (F.col("a.rank") > F.col("b.rank"))).select(F.col("a.topic_id").alias("topic_id"), F.col("a.rank").alias("i"), F.col("b.rank").alias("j"))
    out = every.join(both, ["topic_id", "i", "j"], "left").join(single, ["topic_id", "j"])
    return out.groupBy("topic_id").agg(F.sum(F.log((F.coalesce("dij", F.lit(0)) + 1) / F.col("d"))).alias("coherence"))


def k_selection(diagnostics: DataFrame) -> DataFrame:
    """(k, coherence, exclusivity) with scaled values, balanced and weighted scores and rank."""
    out = diagnostics.withColumn("coherence_norm", min_max_negative("coherence")).withColumn("exclusivity_norm", min_max_negative("exclusivity"))
    out = out.withColumn("balanced_score", (F.col("coherence_norm") + F.col("exclusivity_norm")) / 2).withColumn("weighted_score", 0.6 * F.col("coherence_norm") + 0.4 * F.col("exclusivity_norm"))
    return out.withColumn("selection_rank", F.row_number().over(Window.orderBy(F.desc(F.round("balanced_score", 9)), F.desc("coherence"), "k")))


def min_max_negative(column: str):
    return min_max(column, whole())


def best_k(diagnostics: DataFrame) -> DataFrame:
    """The row without near-empty topics if there is one, of the least perplexity, then the largest concentration."""
    return diagnostics.orderBy(F.col("near_empty_topics") > 0, "perplexity", F.desc("concentration"), "k").limit(1)


def topic_jaccard(topic_words: DataFrame, least: float = 0.2) -> DataFrame:
    """Pairs of topics whose word sets have a Jaccard similarity of `least` or more."""
    words = topic_words.select("topic_id", "word").distinct()
    sizes = words.groupBy("topic_id").agg(F.count("*").alias("n"))
    shared = words.alias("a").join(words.alias("b"), F.col("a.word") == F.col("b.word")).where("a.topic_id < b.topic_id").groupBy(F.col("a.topic_id").alias("topic_a"), F.col("b.topic_id").alias("topic_b")).agg(F.count("*").alias("shared"))
    out = shared.join(sizes.toDF("topic_a", "na"), "topic_a").join(sizes.toDF("topic_b", "nb"), "topic_b")
    return out.select("topic_a", "topic_b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard")).where(F.col("jaccard") >= least)


def representative_docs(theta: DataFrame, n: int = 12) -> DataFrame:
    """The n documents of the largest prevalence in each topic."""
    order = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("theta"), "doc_id"))
    return theta.withColumn("rank", order).where(F.col("rank") <= n)


def prevalence_regression(theta: DataFrame, covariate: str, group: str) -> DataFrame:
    """(topic_id, documents, slope, r2, slope_within): the least-squares change of a topic's
    prevalence by a unit of `covariate`, over all documents and within the groups, which is
    its coefficient beside one effect for each group. Rows without prevalence or covariate
    don't count; one pass of sums by topic and group."""
    x, y = F.col(covariate).cast("double"), F.col("theta")
    rows = theta.where(x.isNotNull() & y.isNotNull())
    own = rows.groupBy("topic_id", group).agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"))
    total = lambda c: F.sum(c)
    spread = lambda p, a, b: F.sum(F.col(p) - F.col(a) * F.col(b) / F.col("n"))
    out = own.groupBy("topic_id").agg(*[total(c).alias(c) for c in ("n", "x", "y", "xx", "xy", "yy")], spread("xx", "x", "x").alias("wxx"), spread("xy", "x", "y").alias("wxy"))
    over = lambda p, a, b: F.col(p) - F.col(a) * F.col(b) / F.col("n")
    sxx, sxy, syy = over("xx", "x", "x"), over("xy", "x", "y"), over("yy", "y", "y")
    return out.select("topic_id", F.col("n").alias("documents"), F.when(sxx > 1e-12, sxy / sxx).alias("slope"), F.when((sxx > 1e-12) & (syy > 1e-12), sxy * sxy / (sxx * syy)).alias("r2"), F.when(F.col("wxx") > 1e-12, F.col("wxy") / F.col("wxx")).alias("slope_within"))


def theta_diagnostics(theta: DataFrame) -> DataFrame:
    """(concentration, near_empty_topics, perplexity): concentration() and the exponent of the
    documents' mean entropy."""
    entropy = theta.groupBy("doc_id").agg(F.sum(F.when(F.col("theta") > 0, -F.col("theta") * F.log("theta")).otherwise(0.0)).alias("e")).agg(F.exp(F.avg("e")).alias("perplexity"))
    return concentration(theta).crossJoin(entropy)
