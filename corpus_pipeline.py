"""From raw documents to token ids: five stages, each an operator of ``cardloom.llm`` over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cardloom.llm import bpe, decontam, jaccard, quality, suffix
from cardloom.llm.common import cut, drop_table, give_back, read, tune

RANKS = "byte_bpe_50k.tiktoken"


def begin(spark: SparkSession) -> None:
    """The session's settings; what the stage before left in the driver goes."""
    tune(spark)
    give_back(spark)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    begin(spark)
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    begin(spark)
    return jaccard.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand anywhere else too are cut out of the texts, at every place where they stand."""
    begin(spark)
    return suffix.cut_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    begin(spark)
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    begin(spark)
    return bpe.encode(docs, bpe.load_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: Training a classifier and merging tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = cut(stage(spark, docs, sf_dir), name)
        drop_table(docs)
        docs = kept
    return docs
