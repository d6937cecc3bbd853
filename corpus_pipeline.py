"""From documents to packed sequences: five stages, each written and read again as Parquet.

Every stage works on all that its predecessor kept, and its decisions take effect: rejected
and contaminated documents go, of each class of near-duplicates the least doc_id stays,
repeated passages are cut from the texts. All stages but the last return the columns of
documents; the last returns one row a sequence.

Defined cases: a null or empty text is rejected by the first stage where there is a trusted
document to learn from, and also without one; rows that repeat are one class, of which one
stays; a null doc_id comes after all others; other columns go through unchanged, whatever
their names; an empty table gives an empty result. Texts are long, so a session's Arrow
batches are kept to BATCH rows while stages run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from buildscope.llm import decontamination, near_dedup, packing, quality, suffix_dedup
from buildscope.llm.common import forget, stored
from buildscope.llm.queries import tokenizer_path


BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """A stage's result is computed after the stage has returned, so this holds for the session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(BATCH))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.representatives(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffix_dedup.cleaned_documents(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def power_of_two_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, tokenizer_path(), limits=packing.SPARING)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("power_of_two_packing", power_of_two_packing),
]

#: The stages are beyond SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        forget(before)  # what the stage before stored; the documents themselves were not
    return docs
