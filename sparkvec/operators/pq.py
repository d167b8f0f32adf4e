"""Product quantization: one codebook of 256 centroids for each of M equal parts of a vector."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.operators.common import matrix, scores, task_number, tree_sum
from sparkvec.operators.kmeans import KMeans, nearest_rows, split_empty
from sparkvec.operators.search import QUERY_BLOCK, local_best, rank, result
from sparkvec.schema import Metric

CENTROIDS = 256
SAMPLE_ALL, SAMPLE_SHARE = 1_000_000, 0.1
AUTOMATIC = (128, 96, 64, 32, 16, 8, 4)


def choose_subspaces(dim: int, asked: int = 0) -> int:
    """asked, if it is possible; else the first usual number that divides the dimension."""
    if asked:
        if asked % 4 or dim % asked or asked > dim:
            raise ValueError(f"{asked} subspaces don't fit {dim} dimensions: a multiple of 4 that divides them is needed")
        return asked
    for m in AUTOMATIC:
        if m <= dim and dim % m == 0:
            return m
    raise ValueError(f"no usual number of subspaces divides {dim} dimensions")


def training_sample(points: DataFrame, seed: int) -> DataFrame:
    """All points up to a million, else a tenth of them or a million, whichever is more, by hash of the id."""
    n = points.count()
    if n <= SAMPLE_ALL:
        return points
    share = max(SAMPLE_SHARE, SAMPLE_ALL / n)
    return points.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def list_of(array: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    rows, width = array.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(array.ravel(), kind))


@dataclass(frozen=True)
class ProductQuantizer:
    """codebook: (M, centroids, dim / M), float32."""

    codebook: np.ndarray
    metric: Metric = Metric.DOT

    def __post_init__(self):
        m, k, width = self.codebook.shape
        if m % 4 or not 1 <= k <= CENTROIDS or width < 1:
            raise ValueError(f"a codebook of shape {self.codebook.shape}")

    @property
    def m(self) -> int:
        return self.codebook.shape[0]

    @property
    def dim(self) -> int:
        return self.m * self.codebook.shape[2]

    @staticmethod
    def from_frame(codebook: DataFrame, metric: Metric | str = Metric.DOT) -> ProductQuantizer:
        """From rows m, code, centroid."""
        t = codebook.select("m", "code", "centroid").orderBy("m", "code").toArrow()
        m = t.column("m").to_numpy()
        parts = len(np.unique(m))
        if len(m) % parts:
            raise ValueError("the parts have different numbers of centroids")
        return ProductQuantizer(matrix(t.column("centroid")).reshape(parts, len(m) // parts, -1), Metric(metric))

    def to_frame(self, spark) -> DataFrame:
        rows = [(j, c, [float(v) for v in self.codebook[j, c]]) for j in range(self.m) for c in range(self.codebook.shape[1])]
        return spark.createDataFrame(rows, "m int, code short, centroid array<float>")

    @staticmethod
    def fit(points: DataFrame, m: int = 0, metric: Metric | str = Metric.DOT, n_iter: int = 25, seed: int = 42) -> ProductQuantizer:
        """k-means of all parts at once, by squared Euclidean distance whatever the metric: one pass an iteration."""
        first = points.select("vector").first()
        if first is None:
            raise ValueError("no points to train on")
        dim = len(first.vector)
        m = choose_subspaces(dim, m)
        sample = training_sample(points.select("vec_id", "vector"), seed)
        n = sample.count()
        if n < CENTROIDS:
            raise ValueError(f"{n} points can't make {CENTROIDS} centroids")
        start = KMeans(seed=seed).initial(sample, CENTROIDS)
        books = start.reshape(CENTROIDS, m, dim // m).transpose(1, 0, 2)
        if n > CENTROIDS:
            sample = sample.persist()
            try:
                books = _train(sample, books, n_iter, seed)
            finally:
                sample.unpersist()
        return ProductQuantizer(books.astype(np.float32), Metric(metric))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each part, the lowest of equals: (rows, M)."""
        width = self.codebook.shape[2]
        if x.shape[1] != self.dim:
            raise ValueError(f"vectors of {x.shape[1]} dimensions, a codebook of {self.dim}")
        return np.stack([nearest_rows(x[:, j * width : (j + 1) * width], self.codebook[j])[0] for j in range(self.m)], axis=1).astype(np.int16)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.codebook[np.arange(self.m)[None, :], codes].reshape(len(codes), -1)

    def encode(self, points: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
        """vec_id, codes."""

        def work(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), list_of(self.codes(matrix(batch.column("vector"))), pa.int16())], names=["vec_id", "codes"])

        return points.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").mapInArrow(work, "vec_id long, codes array<short>")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """vec_id, vector."""

        def work(batches):
            for batch in batches:
                if batch.num_rows:
                    codes = matrix(batch.column("codes")).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), list_of(self.decoded(codes), pa.float32())], names=["vec_id", "vector"])

        return encoded.select("vec_id", "codes").mapInArrow(work, "vec_id long, vector array<float>")

    def tables(self, q: np.ndarray, metric: Metric | None = None) -> np.ndarray:
        """The distance of each part of each query to each centroid: (queries, M, centroids)."""
        width, out = self.codebook.shape[2], np.zeros((len(q), self.m, self.codebook.shape[1]))
        parts = q.astype(np.float64).reshape(len(q), self.m, width)
        for j in range(width):
            a, b = parts[:, :, j][:, :, None], self.codebook[:, :, j].astype(np.float64)[None, :, :]
            out += a * b if (metric or self.metric) is Metric.DOT else (a - b) ** 2
        return out

    def top_k(self, encoded: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, rank, score by asymmetric distance: exact queries, coded documents."""
        metric = self.metric

        def prepare(table):
            return table.column("query_id").to_numpy(), self.tables(matrix(table.column("vector")))

        def score(state, batch):
            q_id, tables = state
            codes = matrix(batch.column("codes")).astype(np.int64)
            total = np.zeros((len(codes), len(q_id)))
            for j in range(self.m):
                total += tables[:, j, :].T[codes[:, j]]
            yield from local_best(total, np.asarray(batch.column("vec_id").to_numpy(zero_copy_only=False)), q_id, k, metric)

        return result(rank(scores(encoded.select("vec_id", "codes"), queries.select("query_id", "vector"), QUERY_BLOCK, prepare, score), k, metric))

    def space_bytes(self) -> int:
        """Two sizes and the centroids."""
        return 16 + 4 * self.codebook.size

    def state(self) -> dict[str, np.ndarray]:
        return {"codebook": self.codebook, "metric": np.array(self.metric.value)}

    @staticmethod
    def from_state(state: dict[str, np.ndarray]) -> ProductQuantizer:
        return ProductQuantizer(state["codebook"], Metric(str(state["metric"])))


def _train(points: DataFrame, books: np.ndarray, n_iter: int, seed: int) -> np.ndarray:
    m, k, width = books.shape
    best, kept = np.full(m, np.inf), books
    random = [np.random.default_rng((seed, j)) for j in range(m)]
    for _ in range(n_iter):
        held = books

        def work(batches, held=held):
            total, h, loss = np.zeros((m, k, width)), np.zeros((m, k)), np.zeros(m)
            for batch in batches:
                x = matrix(batch.column("vector"))
                for j in range(m if len(x) else 0):
                    part = x[:, j * width : (j + 1) * width]
                    at, d = nearest_rows(part, held[j])
                    np.add.at(total[j], at, part.astype(np.float64))
                    h[j] += np.bincount(at, minlength=k)
                    loss[j] += d.sum()
            yield pa.RecordBatch.from_arrays([task_number(), *[pa.array([x.tobytes()], pa.binary()) for x in (total, h, loss)]], names=["task", "total", "h", "loss"])

        partial = points.select("vector").mapInArrow(work, "task long, total binary, h binary, loss binary")
        r = tree_sum(partial, ("total", "h", "loss"), points.rdd.getNumPartitions())
        total, h, loss = np.frombuffer(r.total).reshape(m, k, width), np.frombuffer(r.h).reshape(m, k), np.frombuffer(r.loss)
        means = np.where(h[:, :, None] > 0, total / np.maximum(h, 1e-300)[:, :, None], books)
        books = np.stack([split_empty(means[j], h[j], float(h[j].sum()), random[j])[0] for j in range(m)])
        better = loss < best
        best, kept = np.where(better, loss, best), np.where(better[:, None, None], books, kept)
    return kept
