"""Registered queries of the dealt operators: one ``opN_<name>`` each, over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stagehand.llm import align, chat, decontaminate, divergence, extract, importance, line_dedup, ngram_join, packing, quality_rules, sharding, suffix_dedup, warc
from stagehand.llm.common import read_table

#: The tokenizer file the packing query reads; its place comes from the installed package.
PACK_TOKENIZER = "byte_bpe_50k.json"
#: The two whose tokens the alignment query compares.
ALIGN_TOKENIZERS = ("byte_bpe_50k.json", "piece_bpe_32k.model")


#: Byte limit of a shard: one loader read-ahead unit.
SHARD_BYTES = 1 << 20


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents")).drop("kept")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"), SHARD_BYTES).drop("h")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(read_table(spark, sf_dir, "documents")).drop("class")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read_table(spark, sf_dir, "documents")).drop("failed_rule")


def pack(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(PACK_TOKENIZER)).drop("n_loss")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align_documents(read_table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGN_TOKENIZERS))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = chat.InstTemplate()
    rows = chat.with_hostile(read_table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_conversations(rows, template), template).drop("n_examples")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_warc, op3_line_dedup, op4_quality_classifier, op5_html_extraction, op6_sharding, op7_ngram_join, op8_quality_rules, op9_packing, op10_decontamination,
                               op11_token_alignment, op12_source_divergence, op13_chat_formatting)
}
ORACLE: dict[str, str] = {"op6_sharding": sharding.oracle(SHARD_BYTES), "op12_source_divergence": divergence.oracle()}
