"""Distances and predicates as expressions. Sums run in element order in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkvec.schema import Metric


def fold(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different lengths")))


def dot(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    """The squared Euclidean distance."""

    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return fold(F.zip_with(a, b, square))


def distance(a: Column, b: Column, metric: Metric | str) -> Column:
    return dot(a, b) if Metric(metric) is Metric.DOT else l2(a, b)


def checked_distance(a: Column, b: Column, metric: Metric | str) -> Column:
    return same_length(a, b, distance(a, b, metric))


def euclidean(squared: Column) -> Column:
    return F.sqrt(squared)


def norm(values: Column) -> Column:
    """The squared length of a dense vector or of the values of a sparse one."""
    return fold(F.transform(values, lambda v: v.cast("double") * v.cast("double")))


def dense_sparse_dot(query: Column, components: Column, values: Column) -> Column:
    """A dense query with a sparse vector; a component beyond the query's length fails."""

    def at(c: Column, v: Column) -> Column:
        q = F.when((c >= 0) & (c < F.size(query)), F.get(query, c.cast("int"))).otherwise(F.raise_error(F.lit("component out of range")))
        return q.cast("double") * v.cast("double")

    return fold(F.zip_with(components, values, at))


def sparse_dot(a_components: Column, a_values: Column, b_components: Column, b_values: Column) -> Column:
    """Two sparse vectors, over the components that both have; no common component gives 0. Both are sorted into one array, in which the common ones are side by side."""

    def side(components: Column, values: Column, n: int) -> Column:
        return F.zip_with(components, values, lambda c, v: F.struct(c.cast("long").alias("c"), F.lit(n).alias("side"), v.cast("double").alias("v")))

    def add(s: Column, x: Column) -> Column:
        ours = (x["side"] == 1) & (s["c"] == x["c"])
        return F.struct(F.when(x["side"] == 0, x["c"]).otherwise(s["c"]).alias("c"), F.when(x["side"] == 0, x["v"]).otherwise(s["v"]).alias("v"), F.when(ours, s["sum"] + x["v"] * s["v"]).otherwise(s["sum"]).alias("sum"))

    merged = F.sort_array(F.concat(side(b_components, b_values, 0), side(a_components, a_values, 1)))
    start = F.struct(F.lit(None).cast("long").alias("c"), F.lit(0.0).alias("v"), F.lit(0.0).alias("sum"))
    bad = (F.size(a_components) != F.size(a_values)) | (F.size(b_components) != F.size(b_values)) | (F.size(F.array_distinct(b_components)) != F.size(b_components))
    return F.when(bad, F.raise_error(F.lit("components and values differ in number, or components repeat"))).otherwise(F.aggregate(merged, start, add, lambda s: s["sum"]))


def sparse_l2(dot_product: Column, a_norm: Column, b_norm: Column) -> Column:
    return a_norm + b_norm - F.lit(2.0) * dot_product


def maxsim(query: Column, tokens: Column) -> Column:
    """Sum over query tokens of the best dot product: -Infinity for a document, 0 for a query without tokens."""
    best = F.transform(query, lambda q: F.coalesce(F.array_max(F.transform(tokens, lambda t: dot(q, t))), F.lit(float("-inf"))))
    return fold(best)


def better(a: Column, b: Column, metric: Metric | str) -> Column:
    return a > b if Metric(metric).larger_is_better else a < b


def order(score: Column, metric: Metric | str) -> Column:
    """Best first."""
    return score.desc() if Metric(metric).larger_is_better else score.asc()


def within_relaxation(score: Column, threshold: Column, slack: float, metric: Metric | str) -> Column:
    """Whether a score is no worse than the threshold relaxed by the share `slack`, in 32-bit arithmetic."""
    if not math.isfinite(slack) or slack < 0:
        raise ValueError("the relaxation must be finite and not negative")
    score, threshold, share = score.cast("float"), threshold.cast("float"), F.lit(slack).cast("float")
    if Metric(metric) is Metric.L2:
        return score <= (threshold * (F.lit(1.0).cast("float") + share).cast("float")).cast("float")
    return score >= (threshold - (F.abs(threshold) * share).cast("float")).cast("float")


def not_nan(score: Column) -> Column:
    return F.when(F.isnan(score), F.raise_error(F.lit("the distance is not a number"))).otherwise(score)
