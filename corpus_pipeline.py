"""From raw documents to packed training sequences.

Each stage reads all that the one before it kept, and writes all that it keeps, as Parquet in the
shared folder; what they wrote goes when the program ends, or by `tables.release`.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from loanlens.llm import langid, mixing, packing, pii, simhash
from loanlens.llm.queries import tokenizer_path
from loanlens.sources.tables import scratch_folder

MIN_LANGUAGE_SCORE = 0.25  # never undercut with up to four languages; unknown trigrams tell strangers, see langid


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter in which the classifiers recognise a language stay, unchanged."""
    return langid.recognised(docs, langid.learn(docs), MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose 64-bit fingerprints link at three bits or fewer, the one with the smallest id stays."""
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind; documents without any stay unchanged."""
    return pii.redact(docs).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them; one that is cut keeps its first words."""
    mixed = mixing.mix(docs, keep_text=True, prefix="_mix_")
    return mixing.repeat(mixed, "_mix_").select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixture", mixture),
    ("sequences", sequences),
]

ORACLE_SQL = None  # hashing, learning and tokenizing have no SQL; tests compare with a plain version


# Texts that travel to a Python worker at once; the workers and the JVM share an executor's memory.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        for name, stage in STAGES:
            path = os.path.join(scratch_folder(spark), name.replace(" ", "-"))
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
