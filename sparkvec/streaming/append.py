"""Micro-batches on top of the batch operators: an extension for collections that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkvec.operators import search
from sparkvec.schema import Metric


def search_new(stream: DataFrame, queries: DataFrame, k: int, metric: Metric | str, sink) -> object:
    """A query that searches every micro-batch of dense vectors and hands (batch id, result) to sink."""
    return stream.writeStream.foreachBatch(lambda rows, number: sink(number, search.top_k(rows, queries, k, metric)))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> object:
    """A query that appends vectors to a stored collection."""
    return stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", checkpoint).outputMode("append")
