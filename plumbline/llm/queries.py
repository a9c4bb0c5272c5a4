"""Queries of the training-data operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, chat, convrepair, decontam, jaccard, langid, linededup, lmscore, packing, quality, substringdedup, suffixdedup, whitening


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.cut(docs, tokenizer_path(), 2048), 2048)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"), "removed_chunks", "removed_lines")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents held against the language of conversations."""
    return lmscore.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring conversations as chosen and rejected."""
    return chat.format_preferences(chat.neighbours(table(spark, sf_dir, "conversations")))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of every fiftieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by Jaccard similarity of word trigrams."""
    return jaccard.join_components(table(spark, sf_dir, "documents"), 3, 90)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes repeated from smaller ids."""
    return suffixdedup.dedup_bytes(table(spark, sf_dir, "documents"), 50)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, what is wrong with them and their cheapest repair."""
    return convrepair.repair(convrepair.damaged(table(spark, sf_dir, "conversations")))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of 13 words that a smaller id has."""
    return substringdedup.dedup_words(table(spark, sf_dir, "documents"), 13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_preference_formatting": op6_preference_formatting,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op6_preference_formatting": chat.SQL,
}
