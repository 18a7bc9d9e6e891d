"""Topic models and clusters by Spark's own learners, with the same tables as results.

The latent Dirichlet model is Spark's variational one; the non-negative factorisation is
by multiplicative updates on the sparse term table; clusters are k-means on embeddings.
They are stand-ins of the same families as sampling and sentence-encoder models.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.written import discard, keep

def lda_topics(docs: DataFrame, k: int = 8, iterations: int = 10, words: int = 10, vocabulary: int = 12000, seed: int = 42) -> DataFrame:
    """(topic_id, rank, word, weight) of a model on (doc_id, tokens)."""
    counter = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=vocabulary, minDF=5.0).fit(docs)
    model = LDA(k=k, maxIter=iterations, seed=seed, featuresCol="features").fit(counter.transform(docs))
    names = docs.sparkSession.createDataFrame(list(enumerate(counter.vocabulary)), "term int, word string")
    rows = model.describeTopics(words).select(F.col("topic").alias("topic_id"), F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "x"))
    return rows.select("topic_id", (F.col("rank") + 1).alias("rank"), F.col("x.termIndices").alias("term"), F.col("x.termWeights").alias("weight")).join(F.broadcast(names), "term").select("topic_id", "rank", "word", "weight")


def nmf_topics(terms: DataFrame, vocabulary: list[str], k: int = 8, iterations: int = 15, words: int = 10, seed: int = 42) -> DataFrame:
    """(topic_id, rank, word, weight) of a factorisation of (doc_id, term, value).

    The topics are `vocabulary` x k numbers, bounded by the vocabulary's cap, and live on the
    driver; documents' weights are recomputed in their partitions and never gathered.
    """
    spark, rng = terms.sparkSession, np.random.default_rng(seed)
    index = {t: i for i, t in enumerate(vocabulary)}
    rows = terms.where(F.col("term").isin(*vocabulary)) if len(vocabulary) <= 1000 else terms.join(F.broadcast(spark.createDataFrame([(t,) for t in vocabulary], "term string")), "term", "left_semi")
    rows = rows.groupBy("doc_id").agg(F.collect_list("term").alias("terms"), F.collect_list("value").alias("values"))

    def number(frames):
        for frame in frames:
            yield pd.DataFrame({"ids": [np.array([index[t] for t in names], np.int32) for names in frame["terms"]], "values": frame["values"]})

    # Written once as numbers: no iteration reads a word.
    rows = keep(rows.mapInPandas(number, "ids array<int>, values array<double>"), "documents")
    topics = rng.random((k, len(vocabulary))) + 0.1
    for _ in range(iterations):
        spread = spark.sparkContext.broadcast(topics)

        def part(frames, spread=spread):
            h = spread.value
            gram = h @ h.T
            top, bottom = np.zeros_like(h), np.zeros((len(h), len(h)))
            for frame in frames:
                lengths = frame["ids"].map(len).to_numpy()
                frame, lengths = frame[lengths > 0], lengths[lengths > 0]
                if not len(frame):
                    continue
                # The documents' terms lie one after the other: weights of all are updated at once.
                ids = np.concatenate(frame["ids"].tolist())
                v = np.concatenate(frame["values"].tolist())
                own = np.add.reduceat(h[:, ids] * v, np.cumsum(lengths) - lengths, axis=1).T
                w = np.full(own.shape, 1.0 / len(h))
                for _ in range(10):
                    w = w * own / (w @ gram + 1e-9)
                of = np.repeat(np.arange(len(lengths)), lengths)
                for j in range(len(h)):
                    top[j] += np.bincount(ids, weights=w[of, j] * v, minlength=h.shape[1])
                bottom += w.T @ w
            yield pd.DataFrame({"top": [top.ravel()], "bottom": [bottom.ravel()]})

        sums = rows.mapInPandas(part, "top array<double>, bottom array<double>").rdd.map(lambda r: (np.array(r.top), np.array(r.bottom))).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
        top, bottom = sums[0].reshape(topics.shape), sums[1].reshape(k, k)
        topics = topics * top / (bottom @ topics + 1e-9)
    best = [(j, r + 1, vocabulary[i], float(topics[j, i])) for j in range(k) for r, i in enumerate(np.lexsort((np.arange(len(vocabulary)), -topics[j]))[:words])]
    discard(rows)
    return spark.createDataFrame(best, "topic_id int, rank int, word string, weight double")


def embedding_clusters(vectors: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """(vec_id, cluster) by k-means under cosine distance."""
    frame = vectors.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=15).fit(frame)
    return model.transform(frame).select("vec_id", F.col("prediction").alias("cluster"))
