"""A corpus pipeline of five operators: run(spark, sf_dir) applies STAGES to the documents."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import short_batches, table
from skein.llm.decontaminate import drop_contaminated
from skein.llm.exact_dedup import drop_exact_copies
from skein.llm.language import keep_known_language
from skein.llm.near_dedup import drop_near_copies
from skein.llm.packing import pack
from skein.session import ensure_checkpoint_dir
from skein.sources.versions import remove_folder

TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go: null texts, texts without a letter, and those whose
    posterior is under a score calibrated on held-out labelled rows. Repeated rows are judged each."""
    short_batches(spark)
    return keep_known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the one with the largest doc_id stays; null texts are equal to empty ones,
    a repeated row stays once."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the one with the smallest doc_id stays; texts without words are near one
    another."""
    short_batches(spark)
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words in benchmark windows go; texts without words
    stay, and all do where the benchmark is empty."""
    short_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences; a text without tokens is one piece."""
    short_batches(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Fingerprints, fitted models and token ids are not SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared checkpoint folder and read by the next; when that is
    written too, the one before is deleted. The last but one stays, as the result reads it. An empty
    table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
