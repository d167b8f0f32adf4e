"""Two-stage search: candidates of a first stage, scored again by another collection with the same ids."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvec.functions import distance as D
from sparkvec.operators.common import sized
from sparkvec.schema import Metric


def prune(candidates: DataFrame, k_final: int, alpha: float, metric: Metric | str = Metric.DOT) -> DataFrame:
    """Candidates whose raw score is at least (1 - alpha) times that of rank k_final; all, where there are fewer."""
    if Metric(metric) is Metric.L2:
        warnings.warn("pruning keeps the larger distances: it suits scores of which larger is better", stacklevel=2)
    limit = F.max(F.when(F.col("rank") == k_final, F.col("score"))).over(Window.partitionBy("query_id")) * F.lit(1.0 - alpha)
    return candidates.withColumn("limit", limit).where(F.col("limit").isNull() | (F.col("score") >= F.col("limit"))).drop("limit")


#: Bytes of a candidate: its ids and its rank.
CANDIDATE = 24


def rescore(candidates: DataFrame, queries: DataFrame, docs: DataFrame, score: Column, most: int | None = None) -> DataFrame:
    """query_id, doc_id, first_rank, score: `score` is over the columns of queries (query_id, ...) and docs (doc_id, ...).

    most: candidates that there are at most; while these are small they go to the documents, which are never shuffled.
    """
    found = candidates.select("query_id", "doc_id", F.col("rank").alias("first_rank"))
    small = sized(found, most=None if most is None else most * CANDIDATE)
    return docs.join(small, "doc_id").join(sized(queries), "query_id").select("query_id", "doc_id", "first_rank", score.alias("score"))


def plain(scored: DataFrame, k_final: int, metric: Metric | str) -> DataFrame:
    """The k_final best; equal scores in first-stage order."""
    order = Window.partitionBy("query_id").orderBy(D.order(F.col("score"), metric), "first_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_final).select("query_id", "doc_id", "rank", "score")


def early_exit(scored: DataFrame, k_final: int, beta: int, metric: Metric | str) -> DataFrame:
    """Candidates in first-stage order, until beta in a row don't get among the k_final best; nothing where there are fewer than k_final."""
    # Scores as "larger is better", so that the worst of the kept ones is the least.
    sign = 1.0 if Metric(metric).larger_is_better else -1.0
    item = F.struct("first_rank", "doc_id", (F.col("score") * F.lit(sign)).alias("good"))
    per = scored.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items")).where((F.size("items") >= k_final) & (F.lit(k_final) > 0))
    # The state holds the kept ones as (good, -first_rank, doc_id), least first, and the stalls so far.
    as_kept = lambda x: F.struct(x["good"].alias("good"), (-x["first_rank"]).alias("back"), x["doc_id"].alias("doc_id"))
    start = F.struct(F.sort_array(F.transform(F.slice("items", 1, k_final), as_kept)).alias("kept"), F.lit(0).alias("stalls"))

    def step(state: Column, x: Column) -> Column:
        better = x["good"] > F.get(state["kept"], 0)["good"]
        replaced = F.sort_array(F.concat(F.slice(state["kept"], 2, k_final), F.array(as_kept(x))))
        done = state["stalls"] >= F.lit(max(beta, 1))
        return F.when(done, state).when(better, F.struct(replaced.alias("kept"), F.lit(0).alias("stalls"))).otherwise(F.struct(state["kept"].alias("kept"), (state["stalls"] + 1).alias("stalls")))

    rest = F.slice("items", k_final + 1, F.greatest(F.size("items") - k_final, F.lit(0)))
    final = per.select("query_id", F.explode(F.aggregate(rest, start, step)["kept"]).alias("x"))
    order = Window.partitionBy("query_id").orderBy(F.desc("x.good"), F.desc("x.back"))
    return final.withColumn("rank", F.row_number().over(order)).select("query_id", F.col("x.doc_id").alias("doc_id"), "rank", (F.col("x.good") * F.lit(sign)).alias("score"))


def two_stage(candidates: DataFrame, queries: DataFrame, docs: DataFrame, score: Column, k_candidates: int, k_final: int, metric: Metric | str = Metric.DOT, alpha: float | None = None, beta: int | None = None, first_metric: Metric | str = Metric.DOT) -> DataFrame:
    """query_id, doc_id, rank, score of the k_final best of the first k_candidates, pruned by alpha, scanned with early exit after beta."""
    candidates = candidates.where(F.col("rank") <= (k_candidates if k_final > 0 else 0))
    if alpha is not None:
        candidates = prune(candidates, k_final, alpha, first_metric)
    scored = rescore(candidates, queries, docs, score, queries.count() * k_candidates)  # the first stage isn't run to be measured
    return plain(scored, k_final, metric) if beta is None else early_exit(scored, k_final, beta, metric)


class RerankIndex:
    """A first stage and a collection with the same ids that scores its candidates again."""

    def __init__(self, first, second):
        """first: an Index or a collection; second: a collection, plain or encoded."""
        self.first_stage_index, self.rerank_dataset = first, second

    def __len__(self) -> int:
        return len(self.rerank_dataset)

    def is_empty(self) -> bool:
        return self.rerank_dataset.is_empty()

    def search(self, first_queries: DataFrame, queries: DataFrame, k_candidates: int, k_final: int, alpha: float | None = None, beta: int | None = None) -> DataFrame:
        """query_id, doc_id, rank, score; first_queries are in the form of the first stage, queries in that of the second (plain)."""
        second = self.rerank_dataset.decoded()
        metric = second.meta.metric
        first = getattr(self.first_stage_index, "data", self.first_stage_index)
        q, d, score = second.pairwise(queries)
        return two_stage(self.first_stage_index.search(first_queries, k_candidates), q, d, score, k_candidates, k_final, metric, alpha, beta, first.meta.metric)
