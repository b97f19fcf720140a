"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

All stages but the last give rows of the columns they got, so extra columns pass, whatever their names. Empty tables stay
empty. Documents of equal id and text are one document from the second stage on. Texts are taken whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from cachelens.llm import decontam, mixing, near_dup, quality_classifier, token_files
from cachelens.llm.common import shared_path, ship, table, written
from cachelens.llm.queries import mix_levels
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier doesn't reject; null and word-less texts are kept, equal texts decided alike."""
    ship(spark)
    return quality_classifier.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more. The smallest id stays; null
    and word-less texts are copies of nothing, and a null id stays only where no member of the group has one."""
    ship(spark)
    return near_dup.deduplicate(docs, threshold=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; documents that are mostly such passages go. Null texts pass; n_chars is
    measured anew."""
    ship(spark)
    return _measured(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all tokens, dealt by damped weights; a document comes once for each epoch that takes it. Null and
    word-less texts have no tokens and go; ties of place are ordered by id and a hash of the text."""
    ship(spark)
    return _measured(mixing.prefixed(mixing.mix(docs, mix_levels())))


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back; null ids come first, equal ids by a hash of the text, null texts are empty."""
    ship(spark)
    folder = shared_path(spark, "token-files")
    return token_files.read_tokens(token_files.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json")), folder)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token files", write_token_files),
]
#: No SQL: the learnt classifier, the seeded order and the tokenizer can't be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
