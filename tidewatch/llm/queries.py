"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    fill_in_middle,
    html_wrappers,
    merge_replay,
    oracles,
    order_minhash,
    packing,
    quality,
    secret_scan,
    sharding,
    simhash,
    spelling,
    token_counts,
    token_files,
    warc,
)
from tidewatch.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op5_quality_rules": oracles.QUALITY, "op7_warc_derivatives": oracles.WARC}

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
MERGE_RANKS = "byte_bpe_multi_50k.tiktoken"


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.findings(docs, secret_scan.forest_for(docs))
    return found.select("doc_id", "start", "length", F.sha2("secret", 256).alias("secret_sha256"), "score")


@query
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_likeness(table(spark, sf_dir, "documents"))


@query
def op4_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_text("fingerprint").alias("fingerprint"), "component_id")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(spark, docs, public_tokenizers.path(WORD_TOKENIZER), end_id=1, capacity=4096)


@query
def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    size = F.octet_length("block").cast("long").alias("content_length")
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", size, "block_digest", "source_payload_digest")


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.token_files(spark, docs, public_tokenizers.path(WORD_TOKENIZER), end_id=2)


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op10_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    file, pattern = public_tokenizers.path(MERGE_RANKS), public_tokenizers.PATTERN
    return merge_replay.round_trip(table(spark, sf_dir, "documents"), file, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transformed(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"),
    )


@query
def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_wrappers.extracted(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
