"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

Language identification drops documents without an identifiable language, line dedup cuts passages that occurred before, near-dedup keeps one
document of each group, mixing repeats or drops documents to meet the sources' target weights, and encoding returns token ids. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievespark.llm import bpe, langid, line_dedup, mixing, simhash


#: Rows of a batch between Spark and Python. Spark's default of 10,000 documents takes some 20 MB a task, several times over on both sides.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Sets the session's batches; they are as large as that from then on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return langid.keep_accepted(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that loses lines states its new length; one that loses all its words goes."""
    _small_batches(spark)
    cut = line_dedup.dedup_lines(docs)
    changed = F.col("lines_removed") > 0
    cut = cut.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("lines_removed").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixing.mix(docs).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return bpe.encoded(docs, bpe.vocabulary(), ids=True)


STAGES = [
    ("language identification", identified),
    ("line dedup", without_repeated_lines),
    ("near-dedup", without_near_duplicates),
    ("source mixing", mixed),
    ("byte-level BPE", encoded),
]
#: Encoding and similarity can't be told in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, with every result but the last written to the cluster's shared folder and read back."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pipeline-")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{uuid.uuid4().hex}/{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
