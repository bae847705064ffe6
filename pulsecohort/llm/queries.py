"""The registered queries of this folder, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, neardup, quality, rules, sitetree, store, suffix, toxicity
from .common import load, train_fold

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: The conversation that is added to show that marks inside texts are kept.
PROBE = "\\### Assistant: </turn> ok"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    found = toxicity.score_documents(documents, toxicity.learn(documents, load(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(~train_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, sf_dir, "documents"), size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "n_removed_lines"
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.decontaminate(documents, load(spark, sf_dir, "benchmark")).select("doc_id", "n_items", "item_ids", "lcs_share", "kept")


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(load(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.main_text(load(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("select * from values (-7L, 0L, 'user'), (-7L, 1L, 'assistant') as t(conv_id, turn, role)").withColumn("text", F.lit(PROBE))
    back = chat.read_back(chat.format_conversations(given.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def bpe_digests(documents: DataFrame) -> DataFrame:
    encoded = bpe.encode_documents(documents, BYTE_VOCABULARY, public_tokenizers.PATTERN)
    both = bpe.decode_documents(encoded, BYTE_VOCABULARY, public_tokenizers.PATTERN)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(load(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.write_store(load(spark, sf_dir, "documents"), WORD_VOCABULARY, store.new_folder(spark))
    return store.verify_store(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))
