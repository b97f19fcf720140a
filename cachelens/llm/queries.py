"""The queries of this subpackage and their DuckDB SQL, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, katz, mixing, near_dup, quality_classifier, quality_rules, token_counts, token_files, toxicity, warc
from .common import shared_path, ship, table
from .oracles import SQL  # noqa: F401  the entry reads it here


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = quality_classifier.classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("doc_id", "cl_votes as votes", "cl_posterior as posterior", "cl_score as score", "cl_kept as kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    folder = shared_path(spark, "token-files")
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(manifest, folder)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    folder = shared_path(spark, "warc")
    files = warc.pages_to_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def mix_levels() -> list:
    """Domain (sources by fives), language, source."""
    number = F.try_to_number(F.regexp_extract("source", "([0-9]+)$", 1), F.lit("999999999")).cast("long")
    return [F.concat(F.lit("domain"), F.coalesce((F.floor(number / 5)).cast("string"), F.lit("-"))), F.col("lang"), F.col("source")]


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mix_levels())
    return mixed.select("doc_id", "lang", "source", F.col("cl_epoch").alias("epoch"), F.col("cl_tokens").alias("n_tokens"), F.col("cl_taken").alias("taken_tokens"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so each call encodes all distinct texts."""
    import public_tokenizers

    ship(spark)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), shared_path(spark, "token-cache"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    corpus = katz.Corpus(table(spark, sf_dir, "documents"), ~held)
    return katz.score(corpus, katz.train(corpus, order=3))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_quality_rules, op3_token_files, op4_warc, op5_toxicity, op6_mixing, op7_token_counts, op8_decontamination, op9_near_dup, op10_katz)}
