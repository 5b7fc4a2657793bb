"""A training corpus from raw documents: five stages, each one of the numbered operators at work.

Every stage reads all that the stage before kept, and is written to a table
before the next one starts, so a lost executor costs a stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontamination import decontaminate
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ngram_join import ngram_join
from tidemark.llm.shared import shared_dir
from tidemark.llm.suffix_dedup import suffix_dedup
from tidemark.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not predict to be toxic (a null text is not)."""
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=COLUMNS[1:])
    return scored.where("predicted = 0").select("doc_id", *[F.col(f"with_{c}").alias(c) for c in COLUMNS[1:]])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the smallest document (rows of an unknown id all stay).

    Rows of one id are judged by their own texts, so that unlike texts stay.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("key"))
    groups = ngram_join(keyed, n=5, similarity=0.8, carry=("key",)).where("stays and doc_id is not null").select("doc_id", F.col("with_key").alias("key")).distinct()
    known = keyed.where("doc_id is not null").join(groups, ["doc_id", "key"]).select(*COLUMNS, "key").dropDuplicates(["doc_id", "key"])
    return known.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def cut_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that occur earlier; what is left of a cut character goes too."""
    cut = suffix_dedup(docs, width=100, carry=COLUMNS[2:4])
    text = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    return cut.select("doc_id", text.alias("text"), *[F.col(f"with_{c}").alias(c) for c in COLUMNS[2:4]]).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with the benchmark."""
    judged = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS[1:])
    return judged.where("not contaminated").select("doc_id", *[F.col(f"with_{c}").alias(c) for c in COLUMNS[1:]])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their source's weight and their number of copies (rows of an unknown id: one copy)."""
    copies = mix_sources(docs.where("doc_id is not null")).groupBy("doc_id").agg(F.max("weight").alias("weight"), F.max("copies").alias("copies"))
    return docs.join(copies, "doc_id", "left").select(*COLUMNS, "weight", F.coalesce("copies", F.lit(1)).cast("long").alias("copies")).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", cut_repeated_bytes),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: Trained scoring and byte matching are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
