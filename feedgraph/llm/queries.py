"""The corpus queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedgraph.llm import chat, mixing, oracles, warc
from feedgraph.llm.alignment import cross_alignment
from feedgraph.llm.chat import chat_format
from feedgraph.llm.class_lm import class_lm_scores
from feedgraph.llm.decontaminate import decontaminate
from feedgraph.llm.jaccard_join import jaccard_join
from feedgraph.llm.mixing import weighted_mix
from feedgraph.llm.packing import pack
from feedgraph.llm.quality_gam import quality_gam
from feedgraph.llm.quality_rules import quality_rules
from feedgraph.llm.scratch import table
from feedgraph.llm.sharding import shard_by_bytes
from feedgraph.llm.suffix_dedup import suffix_dedup
from feedgraph.llm.warc import archive_pages
from feedgraph.llm.whitening import whiten


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_and_piece_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm_scores(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_tokenizer(), ids=False)


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_pos")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = weighted_mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_alignment(table(spark, sf_dir, "documents"), *byte_and_piece_tokenizers())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_class_lm": op3_class_lm,
    "op4_quality_rules": op4_quality_rules,
    "op5_minimax_sharding": op5_minimax_sharding,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_gam": op7_quality_gam,
    "op8_warc_index": op8_warc_index,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_weighted_mix": op12_weighted_mix,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat.ORACLE,
    "op2_jaccard_join": oracles.JACCARD,
    "op4_quality_rules": oracles.RULES,
    "op8_warc_index": warc.ORACLE,
    "op10_decontaminate": oracles.DECONTAMINATE,
    "op12_weighted_mix": mixing.ORACLE,
}
