"""k-means as DataFrame steps: assignment and update are distributed, only the k centroids reach the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.functions import distance as D
from sparkvec.operators.common import matrix, small, task_number, tree_sum

#: A copied centroid and its original move apart by this share.
NUDGE = 1 / 1024


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec_id, cluster, distance: the nearest centroid (cluster, centroid), the lowest of equals."""
    if not small(centroids):
        d = D.checked_distance(F.col("vector"), F.col("centroid"), "euclidean")
        joined = points.select("vec_id", "vector").crossJoin(centroids.select("cluster", "centroid"))
        near = joined.groupBy("vec_id").agg(F.min(F.struct(d.alias("distance"), F.col("cluster").alias("cluster"))).alias("n"))
        return near.select("vec_id", F.col("n.cluster").alias("cluster"), F.col("n.distance").alias("distance"))
    # All centroids are one row beside each point, so the least is found without a shuffle.
    row = centroids.agg(F.sort_array(F.collect_list(F.struct("cluster", "centroid"))).alias("centroids"))
    each = F.transform("centroids", lambda c: F.struct(D.checked_distance(F.col("vector"), c["centroid"], "euclidean").alias("distance"), c["cluster"].alias("cluster")))
    near = points.select("vec_id", "vector").crossJoin(F.broadcast(row)).select("vec_id", F.array_min(each).alias("n")).where("n is not null")
    return near.select("vec_id", F.col("n.cluster").alias("cluster"), F.col("n.distance").alias("distance"))


def update(points: DataFrame, assigned: DataFrame, weight: str | None = None) -> DataFrame:
    """cluster, dim, mean, weight: the (weighted) mean of every dimension, long form; each task adds up its own points of a cluster."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    wide = points.join(assigned.select("vec_id", F.col("cluster").cast("long").alias("cluster")), "vec_id").select("cluster", w.alias("w"), "vector")

    def work(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            c, w_ = batch.column("cluster").to_numpy(), np.asarray(batch.column("w").to_numpy(zero_copy_only=False), dtype=np.float64)
            x = matrix(batch.column("vector")).astype(np.float64)
            names, at = np.unique(c, return_inverse=True)
            part = np.zeros((len(names), x.shape[1] + 1))
            np.add.at(part, at, np.hstack([x * w_[:, None], w_[:, None]]))
            for n, row in zip(names.tolist(), part):
                sums[n] = sums[n] + row if n in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["cluster", "sums"])

    parts = wide.mapInArrow(work, "cluster long, sums array<double>").select("cluster", F.posexplode("sums").alias("dim", "x"), F.element_at("sums", -1).alias("w"), (F.size("sums") - 1).alias("n"))
    means = parts.where(F.col("dim") < F.col("n")).groupBy("cluster", "dim").agg((F.sum("x") / F.sum("w")).alias("mean"), F.sum("w").alias("weight"))
    return means.withColumn("cluster", F.col("cluster").cast(assigned.schema["cluster"].dataType))


def objective(assigned: DataFrame, k: int | None = None) -> DataFrame:
    """objective: the sum of distances; imbalance: k * sum(h^2) / sum(h)^2, over the clusters that have points unless their number k is given."""
    sizes = assigned.groupBy("cluster").agg(F.count("*").cast("double").alias("h"), F.sum("distance").alias("d"))
    number = F.count("*") if k is None else F.lit(k)
    return sizes.agg(F.sum("d").alias("objective"), (number * F.sum(F.col("h") * F.col("h")) / (F.sum("h") * F.sum("h"))).alias("imbalance"))


def imbalance(histogram: np.ndarray) -> float:
    h = np.asarray(histogram, dtype=np.float64)
    return float(len(h) * (h * h).sum() / h.sum() ** 2)


def split_empty(centroids: np.ndarray, histogram: np.ndarray, total: float, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Gives every empty cluster half of a donor, drawn by size; the two move apart by NUDGE."""
    centroids, h, k = centroids.copy(), histogram.astype(np.float64).copy(), len(histogram)
    for empty in np.flatnonzero(h == 0):
        donor = -1
        if total > k:
            for step in range(100 * k):
                j = step % k
                if random.random() < (h[j] - 1) / (total - k):
                    donor = j
                    break
        if donor < 0:  # all clusters are small
            donor = int(np.argmax(h))
        centroids[empty] = centroids[donor]
        sign = np.where(np.arange(centroids.shape[1]) % 2 == 0, 1.0, -1.0)
        centroids[empty] *= 1 + sign * NUDGE
        centroids[donor] *= 1 - sign * NUDGE
        h[empty] = h[donor] / 2
        h[donor] -= h[empty]
    return centroids, h


def nearest_rows(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of each row; exact between the few that a matrix product can't tell apart."""
    c = centroids.astype(np.float64)
    wide = x.astype(np.float64)
    score = np.einsum("ij,ij->i", c, c)[None, :] - 2 * (wide @ c.T)
    best = score.min(axis=1, keepdims=True)
    scale = np.einsum("ij,ij->i", wide, wide) + np.abs(best[:, 0]) + 1e-300
    row, col = np.nonzero(score <= best + 1e-12 * scale[:, None])
    out = np.zeros(len(row))
    for j in range(x.shape[1]):
        d = wide[row, j] - c[col, j]
        out += d * d
    order = np.lexsort((col, out, row))
    first = order[np.unique(row[order], return_index=True)[1]]
    return col[first], out[first]


@dataclass(frozen=True)
class KMeans:
    """Lloyd's iterations, always n_iter of them, n_redo times; the run with the least objective wins.

    The objective is that of the centroids before the last update, the
    centroids kept are those after it; weights count for means, not for the objective.
    """

    n_iter: int = 25
    n_redo: int = 1
    seed: int = 42

    def initial(self, points: DataFrame, k: int) -> np.ndarray:
        """k points, by the least md5 of seed and id: the same in every engine."""
        rows = points.select("vec_id", "vector").orderBy(F.md5(F.concat(F.lit(f"{self.seed}:"), F.col("vec_id").cast("string"))), "vec_id").limit(k)
        return matrix(rows.toArrow().column("vector")).astype(np.float64)

    def train(self, points: DataFrame, k: int, weight: str | None = None) -> np.ndarray:
        """The centroids, (k, dim)."""
        if self.n_iter < 1 or self.n_redo < 1 or k < 1:
            raise ValueError("k, n_iter and n_redo must be positive")
        n = points.count()
        if n < k:
            raise ValueError(f"{n} points can't make {k} clusters")
        if n == k:
            return matrix(points.select("vec_id", "vector").orderBy("vec_id").toArrow().column("vector")).astype(np.float64)
        start, best, kept = self.initial(points, k), np.inf, None
        columns = ["vec_id", "vector", *([weight] if weight else [])]
        points = points.select(*columns).persist()
        try:
            for redo in range(self.n_redo):
                random = np.random.default_rng((self.seed, redo))
                centroids = start
                for _ in range(self.n_iter):
                    means, h, loss = step(points, centroids, weight)
                    centroids, _ = split_empty(means, h, float(h.sum()), random)
                    if loss < best:
                        best, kept = loss, centroids
        finally:
            points.unpersist()
        return kept


def step(points: DataFrame, centroids: np.ndarray, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """One assignment and update: every task adds up its own points, and the sums are added up in a tree, in the order of tasks."""
    k, dim = centroids.shape

    def work(batches):
        total, h, loss = np.zeros((k, dim)), np.zeros(k), 0.0
        for batch in batches:
            x = matrix(batch.column("vector"))
            if not len(x):
                continue
            at, d = nearest_rows(x, centroids)
            w = np.ones(len(x)) if weight is None else np.asarray(batch.column(weight).to_numpy(zero_copy_only=False), dtype=np.float64)
            np.add.at(total, at, x.astype(np.float64) * w[:, None])
            h += np.bincount(at, weights=w, minlength=k)
            loss += float(d.sum())
        yield pa.RecordBatch.from_arrays([task_number(), *[pa.array([np.asarray(x, dtype=np.float64).tobytes()], pa.binary()) for x in (total, h, loss)]], names=["task", "total", "h", "loss"])

    partial = points.mapInArrow(work, "task long, total binary, h binary, loss binary")
    r = tree_sum(partial, ("total", "h", "loss"), points.rdd.getNumPartitions())
    total, h = np.frombuffer(r.total, dtype=np.float64).reshape(k, dim), np.frombuffer(r.h, dtype=np.float64)
    return np.where(h[:, None] > 0, total / np.maximum(h, 1e-300)[:, None], centroids), h, float(np.frombuffer(r.loss)[0])


def as_frame(spark, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(np.asarray(centroids))], "cluster int, centroid array<float>")
