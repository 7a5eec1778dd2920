"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import oracles
from skein.llm.byte_bpe import decode_bytes, encode_bytes
from skein.llm.common import short_batches, table
from skein.llm.decontaminate import decontaminate
from skein.llm.exact_dedup import exact_dedup
from skein.llm.fill_middle import fill_middle, restore
from skein.llm.html_text import extract_text
from skein.llm.language import fit_language_model, identify_language, training_rows
from skein.llm.lm_score import score_lm
from skein.llm.near_dedup import near_duplicates
from skein.llm.packing import pack
from skein.llm.pii import KINDS, find_pii, fit_pii_model
from skein.llm.suffix_dedup import remove_repeats
from skein.llm.token_align import SUMS, align_tokenizers
from skein.llm.url_filter import judge_urls

TOKENIZER, RANKS = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(training_rows(docs))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return identify_language(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate(docs, items, keep=["doc_id"]).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, fit_pii_model(docs), keep=["doc_id"])

    def joined(spans: str) -> Column:
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["s"], s["e"]))
        return F.array_join(parts, ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("base_spans"), 256).alias("base_sha256"),
        joined("pii_spans").alias("spans"),
        F.size("pii_spans").cast("long").alias("n_spans"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return score_lm(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    with_ranks = (public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return decode_bytes(encode_bytes(table(spark, sf_dir, "documents"), *with_ranks), *with_ranks).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    found = align_tokenizers(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select("doc_id", *SUMS, digest.alias("groups_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_packing,
        op2_pii,
        op3_language_id,
        op4_decontamination,
        op5_lm_score,
        op6_simhash,
        op7_html_text,
        op8_suffix_dedup,
        op9_exact_dedup,
        op10_url_filter,
        op11_fill_middle,
        op12_byte_bpe,
        op13_token_align,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
