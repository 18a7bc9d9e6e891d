"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Its result
is written as Parquet in the shared folder and read again, so a lost executor costs a
stage's tasks and no more. All but the last return the columns of `documents`. A row of
null or empty text passes every filter but the quality classifier's and becomes one token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, packing, quality, secrets, simhash
from tessera.llm.shared import discard, keep, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BROADCAST_IDS = 500_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all their labels, doesn't reject."""
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), F.lit(False), carry=tuple(c for c in COLUMNS if c != "doc_id"))
    return scored.where("predicted = 1").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked fingerprints.

    An id that several rows have is decided for each of its texts: a text goes if its own
    group has a smaller id, or the same id with a smaller fingerprint, and rows that repeat
    an id and a fingerprint stay once. Rows of a null id stay.
    """
    docs = docs.select(*COLUMNS)
    groups = keep(simhash.simhash_components(docs).select("doc_id", "fp", "component_id", "root"), "groups")
    repeated = keep(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    others = groups.where("doc_id != component_id").select("doc_id").distinct()
    if repeated.isEmpty():
        return _without(docs, others).select(*COLUMNS)
    first = groups.where("doc_id = component_id").join(repeated, "doc_id", "left_semi").groupBy("doc_id", "root").agg(F.min("fp").alias("fp")).select("doc_id", "fp")
    some = simhash.fingerprint(docs.join(repeated, "doc_id", "left_semi"), carry=COLUMNS[1:]).join(first, ["doc_id", "fp"], "left_semi").dropDuplicates(["doc_id", "fp"])
    one = _without(docs, others.unionByName(repeated).distinct())
    return one.select(*COLUMNS).unionByName(some.select(*COLUMNS))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of other ids. Ids are eight bytes: up to the bound they are broadcast, so that texts don't shuffle."""
    ids = keep(ids, "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets cut out of the text and n_chars set anew."""
    return secrets.redact(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Neither the models nor the tokenizer can be put in SQL; tests hold each stage against its
#: operator's brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written and read again."""
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
