"""The queries of the training-data operators, and the SQL that some must equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lamella.llm import mixing, multi_index, ngram_join, warc
from lamella.llm.common import read_table, scratch_path
from lamella.llm.fingerprint import fingerprints
from lamella.llm.packing import pack
from lamella.llm.quality import quality_scores
from lamella.llm.secret_scan import scan
from lamella.llm.training_order import read_slots, write_shards
from lamella.llm.url_filter import judge


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(read_table(spark, sf_dir, "pages"), path, 0)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), 0.3)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(read_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    index = write_shards(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 1024)
    if not index.limit(1).count():
        return index
    # what the shards hold, with the place that the index gives it; a plan can't guess the size of what is read from shards
    return index.select("slot", "shard", "place", "doc_ids").join(read_slots(spark, path).hint("merge"), "slot")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(read_table(spark, sf_dir, "documents"), 5, 75)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(read_table(spark, sf_dir, "embeddings"), 0.9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_dictionary": op1_warc_dictionary,
    "op2_prefix_fingerprints": op2_prefix_fingerprints,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_mix_sources": op5_mix_sources,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_training_order": op7_training_order,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_url_filter": op9_url_filter,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_dictionary": warc.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op8_ngram_jaccard_join": ngram_join.ORACLE,
    "op10_embedding_near_dedup": multi_index.ORACLE,
}
