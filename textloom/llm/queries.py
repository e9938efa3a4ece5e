"""The queries opN_<name> with their production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, html_text, language, packing, quality, simhash, sketches, token_counts, token_ids
from .common import id_remainder, read, scratch


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "op2")
    files = token_ids.write_token_files(read(spark, sf_dir, "documents", "doc_id", "text"), folder, tokenizer("word_bpe_49k.json"), end_id=2)
    return token_ids.read_token_files(spark, folder, files)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.train(language.training_rows(docs))
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return language.identify(docs, model).select("doc_id", held_out, "lang_pred", "score", "distance", "rejected")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"), end_id=0)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.train(docs, quality.training_labels(read(spark, sf_dir, "labels", "doc_id", "quality")))
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return quality.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op7_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_conversations(chat.events_of_turns(turns)))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_token_files, op3_language, op4_packing, op5_decontamination, op6_quality, op7_sketches, op8_chat, op9_html, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontamination.ORACLE, "op8_chat": chat.ORACLE}
