"""The registered queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_dedup, media, near_dup, packing, quality, secret_scan, substring_dedup, tokenstore, urls
from .common import pick, shared_dir, table, written
from .oracles import ORACLES


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(substring_dedup.file_batches(table(spark, sf_dir, "documents"))).drop("kept")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(table(spark, sf_dir, "documents"), n=3, percent=85)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-store")
    tokenstore.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenstore.read_records(tokenstore.read_store(spark, path), zlib.crc32)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents")).select("doc_id", *quality.COLUMNS, "base_failed", "kept")


def op6_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    text = F.coalesce("text", F.lit(""))
    payload = F.encode(text, "UTF-8")
    stored = written(media.store(docs.select(payload.alias("payload"))), "media")
    pages = docs.select("doc_id", media.page(text, media.reference(F.sha2(payload, 256), F.coalesce("source", F.lit("")))).alias("html"))
    # Written, so that nothing but the join needs the rows of a digest together: then those of a
    # digest that very many documents share can be split.
    known = written(media.measured(stored), "measured")
    return media.resolve(media.sequences(pages, "doc_id", "html"), "doc_id", known).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_elements"
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.judge(table(spark, sf_dir, "documents")).drop("kept")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.model(urls.labelled())).drop("score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_substring_dedup, op3_near_duplicates, op4_token_store, op5_quality_rules, op6_media_sequences, op7_secret_scan, op8_packing, op9_line_dedup, op10_url_filter)
}
ORACLE_SQL: dict[str, str] = {k: v for k, v in ORACLES.items() if k in QUERIES}
