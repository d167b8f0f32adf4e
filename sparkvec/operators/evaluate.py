"""Recall and overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """recall: the share of the (query_id, doc_id) of truth that are found; queries without results count as missed."""
    hits = truth.join(found.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hits.agg((F.count("hit") / F.count("*")).alias("recall"))


def intersection(found: Column, truth: Column) -> Column:
    """How many elements of truth are in found; repeated ones count as often as they are there."""
    return F.size(F.filter(truth, lambda x: F.array_contains(found, x)))
