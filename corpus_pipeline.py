"""A training-data pipeline over the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the
last return the columns of documents.  Between stages the rows are written as
Parquet and read again.

Null and empty texts, null and repeated ids and repeated rows pass each stage as
its operator's docstring states: the classifier scores them, documents without
words are no near-duplicates and hold no benchmark item, rows that share an id are
mixed alike, and equal texts share a shard.  Columns other than doc_id, text,
source and n_chars are carried along, whatever their names.  Empty tables stay
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import decontaminate, mixing, near_dedup, quality_classifier, sharding
from evidentia.llm.storage import read, store
from evidentia.session import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    ship(spark)
    meta = quality_classifier.METADATA
    model = quality_classifier.train(docs, read(spark, sf_dir, "labels"), meta=meta)
    return quality_classifier.accept(docs, model, meta=meta)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest doc_id, of each group of documents with a similarity of 0.8 or more."""
    ship(spark)
    return near_dedup.keep_first(docs, near_dedup.USUAL)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    ship(spark)
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources reach their target weights."""
    ship(spark)
    return mixing.mix_documents(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each document: 8 shards of near-equal bytes, equal texts together."""
    ship(spark)
    return sharding.shard_documents(docs, 8)


STAGES = [
    ("quality_classifier", keep_quality),
    ("near_dedup", keep_distinct),
    ("decontamination", keep_clean),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: The classifier's scores cannot be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, name)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
