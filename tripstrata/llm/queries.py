"""The operators as queries over the test tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm import (
    byte_bpe,
    filter_audit,
    fuzzy_lines,
    hilbert_shards,
    language_id,
    ordinal_quality,
    phrase_index,
    quality_rules,
    quote_links,
    secret_forest,
    simhash_gph,
    token_alignment,
    warc,
)
from tripstrata.llm.tables import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.link(quote_links.as_mail(table(spark, sf_dir, "conversations")))


RANKS = "byte_bpe_multi_50k.tiktoken"


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = byte_bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.find_repeated(table(spark, sf_dir, "documents"), whole=True)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards.assign(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_forest.scan(table(spark, sf_dir, "documents"), whole=True)
    digest = F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256")
    return found.select("doc_id", "word_no", "run_no", digest, "score", "is_secret")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gph.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; see ``language_id.identify`` for nulls and empty tables."""
    return language_id.identify(table(spark, sf_dir, "documents"))


VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document; see ``token_alignment.align_documents``."""
    paths = public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B)
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), *paths)[0]


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all their orders over every document; see ``filter_audit.audit``."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    query.__name__: _shipped(query)
    for query in (
        op1_quality_rules,
        op2_chat_formatting,
        op3_byte_level_bpe,
        op4_line_dedup,
        op5_sharding,
        op6_benchmark_decontamination,
        op7_secret_scans,
        op8_simhash_near_dedup,
        op9_quality_classifier,
        op10_warc,
        op11_language_id,
        op12_cross_tokenizer_alignment,
        op13_filter_interaction_audit,
    )
}
