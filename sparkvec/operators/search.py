"""Exhaustive top-k search.

Two strategies give the same rows, bit for bit:

expr   a join of queries and documents on nothing, the distance as an
       expression, and row_number() <= k, which Spark cuts to k rows a query in
       every partition before it shuffles.
block  for dense vectors: documents stream through Arrow batches, a block of
       queries is scored by one matrix product, the rows that may be among the k
       best are scored again in the order of the expression, and what
       remains, k rows a query and task, goes through the same row_number(). Sparse
       vectors are scored in blocks too.

Ties go to the lower document id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvec.functions import distance as D
from sparkvec.operators import common
from sparkvec.operators.common import best_rows, fold_dot, fold_l2, matrix, scores, sized, small
from sparkvec.operators.sparse_boxes import top_scores
from sparkvec.schema import Metric

#: Queries that one matrix product takes.
QUERY_BLOCK = 512


def rank(scored: DataFrame, k: int, metric: Metric | str, by: tuple[str, ...] = ("query_id",), tie: str = "doc_id") -> DataFrame:
    """The k best rows a query of (query_id, doc_id, score), with their ranks from 1."""
    order = Window.partitionBy(*by).orderBy(D.order(F.col("score"), metric), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 0))


def result(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "doc_id", "rank", "score")


def cross(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """All pairs; the queries go to every executor while they are small."""
    return docs.crossJoin(sized(queries))


def top_k(docs: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.DOT, strategy: str = "block") -> DataFrame:
    """query_id, doc_id, rank, score for dense docs (vec_id, vector) and queries (query_id, vector)."""
    metric = Metric(metric)
    if strategy == "expr" or k <= 0:
        d, q = docs.select(F.col("vec_id").alias("doc_id"), F.col("vector").alias("dv")), queries.select("query_id", F.col("vector").alias("qv"))
        return result(rank(cross(q, d).select("query_id", "doc_id", D.checked_distance(F.col("qv"), F.col("dv"), metric).alias("score")), k, metric))
    if strategy != "block":
        raise ValueError("the strategy is expr or block")
    return result(rank(block_scores(docs, queries, k, metric), k, metric))


def block_scores(docs: DataFrame, queries: DataFrame, k: int, metric: Metric) -> DataFrame:
    """query_id, doc_id, score of at least the k best documents of each query in every task."""

    def prepare(table):
        return table.column("query_id").to_numpy(), matrix(table.column("vector"))

    def score(state, batch):
        yield _batch(_candidates(*state, np.asarray(batch.column("vec_id").to_numpy(zero_copy_only=False)), matrix(batch.column("vector")), k, metric))

    return scores(docs.select("vec_id", "vector"), queries.select("query_id", "vector"), QUERY_BLOCK, prepare, score)


def _candidates(q_id, q, d_id, d, k, metric):
    if not len(d) or not len(q):
        return [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)]
    if q.shape[1] != d.shape[1]:
        raise ValueError(f"queries have {q.shape[1]} dimensions, documents {d.shape[1]}")
    wide_q, wide_d = q.astype(np.float64), d.astype(np.float64)
    product = wide_d @ wide_q.T
    qq, dd = np.einsum("ij,ij->i", wide_q, wide_q), np.einsum("ij,ij->i", wide_d, wide_d)
    slack = 1e-13 * q.shape[1] * (qq + dd.max())
    score = product if metric is Metric.DOT else 2 * product - qq[None, :] - dd[:, None]
    if np.isnan(score).any():
        raise ValueError("a vector holds a value that is not a number")
    col, row = best_rows(score, k, slack)
    value = (fold_dot if metric is Metric.DOT else fold_l2)(q[col], d[row])
    # Of the exact scores only the k best are needed.
    order = np.lexsort((d_id[row], -value if metric is Metric.DOT else value, col))
    col, row, value = col[order], row[order], value[order]
    place = np.arange(len(col)) - np.searchsorted(col, col)
    keep = place < k
    return q_id[col[keep]], d_id[row[keep]], value[keep]


def _batch(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "doc_id", "score"])


def nearest(docs: DataFrame, queries: DataFrame, metric: Metric | str = Metric.DOT, strategy: str = "block") -> DataFrame:
    """query_id, doc_id, score of the best document; no row where there are no documents."""
    return top_k(docs, queries, 1, metric, strategy).drop("rank")


def top_k_by(docs: DataFrame, queries: DataFrame, score: Column, k: int, metric: Metric | str) -> DataFrame:
    """Top-k by any expression over the columns of docs (with doc_id) and queries (with query_id)."""
    return result(rank(cross(queries, docs).select("query_id", "doc_id", D.not_nan(score).alias("score")), k, metric))


def pair_distance(docs: DataFrame, pairs: DataFrame, metric: Metric | str = Metric.DOT) -> DataFrame:
    """a, b, score for pairs (a, b) of vec_ids of dense docs."""
    a, b = docs.select(F.col("vec_id").alias("a"), F.col("vector").alias("va")), docs.select(F.col("vec_id").alias("b"), F.col("vector").alias("vb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", D.checked_distance(F.col("va"), F.col("vb"), metric).alias("score"))


def vectors_as_queries(docs: DataFrame, ids: Column | None = None) -> DataFrame:
    """Stored vectors (those that meet the condition) as queries."""
    chosen = docs if ids is None else docs.where(ids)
    return chosen.select(F.col("vec_id").alias("query_id"), "vector")


def sparse_scores(docs: DataFrame, queries: DataFrame, metric: Metric | str = Metric.DOT) -> DataFrame:
    """query_id, doc_id, score of all pairs of sparse docs and queries that share a component, by a join on components."""
    from_docs = docs.select(F.col("vec_id").alias("doc_id"), F.explode(F.arrays_zip("components", "values")).alias("e")).select("doc_id", F.col("e.components").alias("c"), F.col("e.values").cast("double").alias("dv"))
    from_queries = queries.select("query_id", F.explode(F.arrays_zip("components", "values")).alias("e")).select("query_id", F.col("e.components").alias("c"), F.col("e.values").cast("double").alias("qv"))
    return from_docs.join(sized(from_queries), "c").groupBy("query_id", "doc_id").agg(F.sum(F.col("dv") * F.col("qv")).alias("score"))


#: Sparse queries that are scored at once, and products that are held at once.
SPARSE_BLOCK, PRODUCTS = 128, 1 << 22
#: Bytes of sparse queries that documents stream past; more are boxed.
SPARSE_BYTES = 4 << 20


class SparseQueries:
    """Some sparse queries as a dense matrix over the components that they have."""

    def __init__(self, q_id: np.ndarray, components: pa.Array, values: pa.Array):
        count = np.asarray(pc.fill_null(pc.list_value_length(components), 0))
        c, v = components.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.q_id, row = q_id, np.repeat(np.arange(len(count)), count)
        self.used, at = np.unique(c, return_inverse=True)
        self.dense = np.zeros((len(self.used), len(count)))
        self.dense[at, row] = v
        self.norm = np.bincount(row, weights=v * v, minlength=len(count))

    def products(self, c: np.ndarray, v: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(documents, queries) from documents' components and values one after another."""
        out = np.zeros((len(count), len(self.q_id)))
        if not len(self.used) or not len(c):
            return out
        at = np.minimum(np.searchsorted(self.used, c), len(self.used) - 1)
        hit = np.flatnonzero(self.used[at] == c)
        at, row, v = at[hit], np.repeat(np.arange(len(count)), count)[hit], v[hit].astype(np.float64)
        step = max(1, PRODUCTS // max(1, len(self.q_id)))
        for lo in range(0, len(hit), step):
            part = self.dense[at[lo : lo + step]] * v[lo : lo + step, None]
            mine = row[lo : lo + step]
            first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            out[mine[first]] += np.add.reduceat(part, first, axis=0)
        return out


def sparse_top_k(docs: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.DOT, strategy: str = "block") -> DataFrame:
    """Top-k of sparse docs (vec_id, components, values) and queries (query_id, components, values).

    Every document competes: one that shares no component with a query has the product 0. By "block", documents stream past
    the queries, or boxes of many queries meet boxes of documents in files (sparse_boxes); each task cuts them to k a query, and nothing else is shuffled. By "join", they meet on components by a
    shuffle, which pays where few documents share any component with a query; for the dot product only the k documents of the lowest ids
    among those that don't can matter then, for L2 all pairs are scored.
    """
    metric = Metric(metric)
    if strategy not in ("block", "join"):
        raise ValueError("the strategy is block or join")
    if strategy == "block":

        def prepare(table):
            return SparseQueries(table.column("query_id").to_numpy(), table.column("components").combine_chunks(), table.column("values").combine_chunks())

        def score(state, batch):
            count = np.asarray(pc.fill_null(pc.list_value_length(batch.column("components")), 0))
            c, v = (batch.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("components", "values"))
            found = state.products(c, v, count)
            if metric is Metric.L2:
                norm = np.bincount(np.repeat(np.arange(len(count)), count), weights=v.astype(np.float64) ** 2, minlength=len(count))
                found = state.norm[None, :] + norm[:, None] - 2.0 * found
            yield from local_best(found, np.asarray(batch.column("vec_id").to_numpy(zero_copy_only=False)), state.q_id, k, metric)

        columns = [F.col("components").cast("array<long>").alias("components"), F.col("values").cast("array<float>").alias("values")]
        if not small(queries, min(SPARSE_BYTES, common.BROADCAST_BYTES)):
            return result(rank(top_scores(docs, queries, k, metric), k, metric))
        found = scores(docs.select(F.col("vec_id").cast("long").alias("vec_id"), *columns), queries.select(F.col("query_id").cast("long").alias("query_id"), *columns), SPARSE_BLOCK, prepare, score)
        return result(rank(found, k, metric))
    met = sparse_scores(docs, queries)
    if metric is Metric.L2:
        d = docs.select(F.col("vec_id").alias("doc_id"), D.norm(F.col("values")).alias("dn"))
        q = queries.select("query_id", D.norm(F.col("values")).alias("qn"))
        scored = cross(q, d).join(met, ["query_id", "doc_id"], "left").select("query_id", "doc_id", D.sparse_l2(F.coalesce("score", F.lit(0.0)), F.col("qn"), F.col("dn")).alias("score"))
        return result(rank(scored, k, metric))
    # A query that k documents score above 0 on needs no others.
    ranked = rank(met, k, metric)
    have = ranked.where("score > 0").groupBy("query_id").agg(F.count("*").alias("have"))
    open_ = queries.select("query_id").join(have, "query_id", "left").where(F.coalesce("have", F.lit(0)) < max(k, 0)).select("query_id")
    others = docs.select(F.col("vec_id").alias("doc_id")).crossJoin(open_).join(met.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    zeros = rank(others.withColumn("score", F.lit(0.0)), k, metric)
    return result(rank(ranked.drop("rank").unionByName(zeros.drop("rank")), k, metric))


def local_best(score: np.ndarray, ids: np.ndarray, q_id: np.ndarray, k: int, metric: Metric):
    """The k best rows of each column as a batch; ties go to the lower id."""
    if not score.size or k <= 0:
        return
    good = score if metric.larger_is_better else -score
    if len(good) > k:
        kth = np.partition(good, len(good) - k, axis=0)[len(good) - k]
        row, col = np.nonzero(good >= kth[None, :])
    else:
        row, col = (x.ravel() for x in np.indices(good.shape))
    order = np.lexsort((ids[row], -good[row, col], col))
    row, col = row[order], col[order]
    keep = np.arange(len(col)) - np.searchsorted(col, col) < k
    row, col = row[keep], col[keep]
    yield _batch((q_id[col], ids[row], score[row, col]))


def relaxed(scored: DataFrame, threshold: Column, slack: float, metric: Metric | str) -> DataFrame:
    """The rows whose score is within the relaxed threshold."""
    return scored.where(D.within_relaxation(F.col("score"), threshold, slack, metric))
