"""From raw documents to packed token sequences, in five stages.

Each stage takes the documents that the one before kept, with their columns, and
is written as Parquet before the next one reads it:

1. ``quality``: documents that fail the repetition rules go.
2. ``line_dedup``: lines that an earlier document or line holds, up to one edit, go;
   a document that has no word left goes with them.
3. ``near_dup``: of each group of near-duplicates (five-word shingles, similarity of
   0.8 or more) one document stays, that of the smallest doc_id.
4. ``secrets``: spans of secrets, in plain sight or under layers of encoding, are
   replaced in the text.
5. ``packing``: documents are encoded and packed into sequences of 1,024 ids; the
   result has a row for each piece, with its ids.

Nulls, empty and very long texts, repeated rows, empty tables and further columns are
handled as each operator's docstring says.  Decisions of a stage depend on the whole of
its input, never on how it is partitioned; only the layout of sequences does.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from archivelake.llm import line_dedup, near_dup, packing, quality, secret_scan
from archivelake.llm.common import bounded_batches, table, written

#: Pieces of texts that a worker of the last stage remembers: few, as it runs beside a heap that the
#: shuffles of the stages before have filled.
MEMORY_PIECES = 250_000

#: Tokenizers and exact set overlaps are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_dup.dedup(docs, n=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return secret_scan.redact(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), memory_pieces=MEMORY_PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of ``documents`` below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
