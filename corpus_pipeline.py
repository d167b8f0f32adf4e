"""From raw documents to token ids: quality, near duplicates, repeated passages, benchmark leaks, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; it is written as Parquet to the shared folder and read again
before the next one. All but the last return the columns of documents.

Null, empty and repeated rows pass as the operators define it: texts without
words are kept by every stage, of exactly repeated rows one is kept by the
near-duplicate stage if they hold words, a document that loses all its text goes,
n_chars follows the text, and columns that documents may have besides travel along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkvec.llm import decontaminate, importance, ngram_join, sentencepiece_codec, suffix_dedup
from sparkvec.llm.common import STORED, drop_stored, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what importance resampling towards good labelled text does not draw."""
    return importance.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that the n-gram Jaccard join connects."""
    return ngram_join.keep_one(docs, n=3, threshold=0.5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out windows of 50 words that occur earlier."""
    return suffix_dedup.remove_repeats(docs, length=50, gram=8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out stretches of benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_words=10, min_cover=0.6, cover_words=8)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, exact, parity."""
    return sentencepiece_codec.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: Hashed models, Gumbel noise and token ids are beyond SQL: tests/llm/test_pipeline.py holds each stage's rows and texts against a version of its own.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage stored besides its result goes, and so does the result once the next one is there."""
    docs, before = table(spark, sf_dir, "documents"), len(STORED)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        drop_stored(spark, STORED[before:-1])
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
