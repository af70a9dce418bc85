"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, sharding, substring_dedup, token_counts, token_output
from .storage import read


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, installed with the package on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    pieces = token_counts.load_pieces(vocabulary("piece_bpe_32k.model"))
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), pieces)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near-equal bytes, equal texts together."""
    return sharding.shard_table(read(spark, sf_dir, "documents"), 8)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers of all documents."""
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: five-word shingles, similarity 0.85 or more."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned outside fold 0."""
    docs = read(spark, sf_dir, "documents")
    meta = quality_classifier.METADATA
    return quality_classifier.score(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels"), meta=meta), meta=meta)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without windows of 20 words that start earlier."""
    return substring_dedup.repeat_table(read(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as framed token ids, read back from the files."""
    return token_output.record_table(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.secret_table(read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised ones included."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source to capped targets."""
    return mixing.mix_table(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op4_minhash_near_dedup": op4_minhash,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_output": op7_token_output,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
}

ORACLE: dict[str, str] = {
    "op4_minhash_near_dedup": near_dedup.GROUPS_SQL,
    "op6_substring_dedup": substring_dedup.REPEATS_SQL,
    "op10_mixing": mixing.MIX_SQL,
}
