"""Registered queries of the training-data operators, one ``opN_<name>`` each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, decontamination, mixing, secret_scan
from .conversation_repair import repair_conversations
from .decontamination import decontaminate
from .language_id import language_id
from .license_scan import license_scan
from .mixing import mix_sources
from .ngram_join import ngram_join
from .ngram_join import oracle as ngram_oracle
from .permutation_index import nearest_neighbours
from .secret_scan import secret_scan as scan_secrets
from .substring_dedup import oracle as substring_oracle
from .substring_dedup import substring_dedup
from .suffix_dedup import oracle as suffix_oracle
from .suffix_dedup import suffix_dedup
from .token_alignment import align_tokens
from .toxicity import toxicity
from .warc import oracle as warc_oracle
from .warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), "doc_id", "text", width=13)
    return out.drop("kept_text")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", k=10)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), "doc_id", "text", width=100).drop("kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"), min_share=0)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), n=5, similarity=0.8)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_mix_sources, op3_license_scan, op4_permutation_index, op5_warc, op6_suffix_dedup, op7_toxicity, op8_language_id, op9_decontaminate, op10_ngram_join, op11_secret_scan, op12_token_alignment, op13_conversation_repair)}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring_oracle(),
    "op2_mix_sources": mixing.oracle(),
    "op5_warc": warc_oracle(),
    "op6_suffix_dedup": suffix_oracle(),
    "op9_decontaminate": decontamination.oracle(),
    "op10_ngram_join": ngram_oracle(),
    "op11_secret_scan": secret_scan.oracle(),
    "op13_conversation_repair": conversation_repair.oracle(),
}
