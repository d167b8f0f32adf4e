"""Documents of several token vectors: MaxSim over plain, product-quantized and two-level tokens.

The score of a document is the sum over the query's tokens of the best dot
product with any of the document's tokens: -Infinity without document tokens,
0 without query tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.operators.common import matrix, scores
from sparkvec.operators.kmeans import KMeans, nearest_rows
from sparkvec.operators.pq import ProductQuantizer, list_of
from sparkvec.operators.search import local_best, rank, result
from sparkvec.schema import Metric


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, n+1 offsets) of a column of lists of vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    inner = column.flatten()
    counts = np.asarray(column.value_lengths().fill_null(0))
    return matrix(inner), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _sum_of_best(sim: np.ndarray, d_offsets: np.ndarray, q_offsets: np.ndarray) -> np.ndarray:
    """(documents, queries) from (document tokens, query tokens)."""
    docs, queries = len(d_offsets) - 1, len(q_offsets) - 1
    best = np.full((docs, sim.shape[1]), -np.inf)
    has = np.flatnonzero(np.diff(d_offsets))
    if len(has) and sim.shape[1]:
        best[has] = np.maximum.reduceat(sim, d_offsets[:-1][has], axis=0)
    out = np.zeros((docs, queries))
    for q in range(queries):
        for j in range(q_offsets[q], q_offsets[q + 1]):
            out[:, q] += best[:, j]
    return out


#: Queries that are scored at once, and similarities of tokens that are held at once.
MULTI_BLOCK, SIMILARITIES = 32, 1 << 22


def _search(docs: DataFrame, columns: list[str], queries: DataFrame, k: int, prepare, similarity) -> DataFrame:
    """prepare(query tokens): what similarity(it, documents) needs to give (token similarities, offsets of the documents' tokens)."""

    def ready(table):
        q, offsets = tokens_of(table.column("tokens"))
        return table.column("query_id").to_numpy(), q, offsets, prepare(q)

    def score(state, batch):
        q_id, q, q_offsets, made = state
        tokens = np.asarray(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0)).astype(np.int64)
        ends = np.cumsum(tokens) * max(1, len(q))
        out, lo = np.zeros((batch.num_rows, len(q_id))), 0
        while lo < batch.num_rows:  # some documents at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SIMILARITIES, side="right")))
            sim, offsets = similarity(made, q, batch.slice(lo, hi - lo))
            out[lo:hi] = _sum_of_best(sim, offsets, q_offsets)
            lo = hi
        yield from local_best(out, np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False)), q_id, k, Metric.DOT)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)
    return result(rank(scores(own, queries.select("query_id", "tokens"), MULTI_BLOCK, ready, score), k, Metric.DOT))


def _checked(q: np.ndarray, dim: int) -> None:
    if len(q) and dim and q.shape[1] != dim:
        raise ValueError(f"query tokens have {q.shape[1]} dimensions, documents {dim}")


def maxsim_top_k(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Plain tokens: docs (doc_id, tokens), queries (query_id, tokens)."""

    def similarity(wide, q, batch):
        t, offsets = tokens_of(batch.column("tokens"))
        _checked(q, t.shape[1])
        return (t.astype(np.float64) @ wide if len(t) and len(q) else np.zeros((len(t), len(q)))), offsets

    return _search(docs, ["tokens"], queries, k, lambda q: q.astype(np.float64).T, similarity)


def flat_tokens(docs: DataFrame) -> DataFrame:
    """All tokens as vectors, for training; vec_id is a hash of document and place."""
    return docs.select("doc_id", F.posexplode("tokens").alias("token_id", "vector")).select(F.xxhash64("doc_id", "token_id").alias("vec_id"), "vector")


def _per_token(docs: DataFrame, kind: str, encode) -> DataFrame:
    def work(batches):
        for batch in batches:
            if batch.num_rows:
                t, offsets = tokens_of(batch.column("tokens"))
                inner = encode(t)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), inner)], names=["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInArrow(work, f"doc_id long, tokens array<{kind}>")


@dataclass(frozen=True)
class TokenQuantizer:
    """Product quantization of every token."""

    pq: ProductQuantizer

    def encode(self, docs: DataFrame) -> DataFrame:
        return _per_token(docs, "array<short>", lambda t: list_of(self.pq.codes(t) if len(t) else np.zeros((0, self.pq.m), dtype=np.int16), pa.int16()))

    def decode(self, encoded: DataFrame) -> DataFrame:
        """doc_id, tokens."""

        def work(batches):
            for batch in batches:
                if batch.num_rows:
                    codes, offsets = tokens_of(batch.column("tokens"))
                    t = self.pq.decoded(codes.astype(np.int64)) if len(codes) else np.zeros((0, self.pq.dim), dtype=np.float32)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), list_of(t, pa.float32()))], names=["doc_id", "tokens"])

        return encoded.select("doc_id", "tokens").mapInArrow(work, "doc_id long, tokens array<array<float>>")

    def top_k(self, encoded: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        def similarity(tables, q, batch):
            codes, offsets = tokens_of(batch.column("tokens"))
            _checked(q, self.pq.dim)
            return adc(tables, codes.astype(np.int64), len(q)), offsets

        return _search(encoded, ["tokens"], queries, k, lambda q: _tables(self.pq, q), similarity)

    def space_bytes(self) -> int:
        """Two sizes and, for each part, its centroids in a collection of their own."""
        return 16 + _books(self.pq)

    def state(self) -> dict[str, np.ndarray]:
        return self.pq.state()

    @staticmethod
    def from_state(state: dict[str, np.ndarray]) -> TokenQuantizer:
        return TokenQuantizer(ProductQuantizer.from_state(state))


def _books(pq: ProductQuantizer) -> int:
    """Bytes of each part's centroids as a dense collection: its buffer and its dimension."""
    m, k, width = pq.codebook.shape
    return m * (8 + 16 + 4 * k * width)


def _tables(pq: ProductQuantizer, q: np.ndarray) -> np.ndarray | None:
    return pq.tables(q, Metric.DOT) if len(q) and q.shape[1] == pq.dim else None


def adc(tables: np.ndarray | None, codes: np.ndarray, queries: int) -> np.ndarray:
    """Dot products of coded tokens and query tokens by table look-up."""
    out = np.zeros((len(codes), queries))
    if len(codes) and queries:
        for j in range(tables.shape[1]):
            out += tables[:, j, :].T[codes[:, j]]
    return out


@dataclass(frozen=True)
class TwoLevelQuantizer:
    """The nearest coarse centroid of a token, and product quantization of what remains.

    With norms, remainders are scaled to length 1 before they are coded, and their
    length is kept as a half-precision number.
    """

    coarse: np.ndarray
    pq: ProductQuantizer
    norms: bool = False

    def __post_init__(self):
        if self.coarse.ndim != 2 or self.coarse.shape[1] != self.pq.dim:
            raise ValueError("coarse centroids and codebook differ in their dimensions")

    @staticmethod
    def fit(docs: DataFrame, coarse: int, m: int, n_iter: int = 25, seed: int = 42) -> TwoLevelQuantizer:
        points = flat_tokens(docs)
        return TwoLevelQuantizer.fit_from_coarse(docs, KMeans(n_iter=n_iter, seed=seed).train(points, coarse).astype(np.float32), m, False, n_iter, seed)

    @staticmethod
    def fit_from_coarse(docs: DataFrame, coarse: np.ndarray, m: int, norms: bool = True, n_iter: int = 25, seed: int = 42, assignments: DataFrame | None = None, sample: int | None = None) -> TwoLevelQuantizer:
        """Trains on the remainders of tokens, of about `sample` of them (least hashes) if that is given.

        assignments: doc_id, coarse (a list with the centroid of each token); by default the nearest ones.
        """
        coarse = np.asarray(coarse, dtype=np.float32)

        def work(batches):
            for batch in batches:
                x = matrix(batch.column("vector"))
                if len(x):
                    given = batch.column("coarse")
                    at = None if given.null_count else given.to_numpy(zero_copy_only=False).astype(np.int64)
                    if at is not None and not ((at >= 0) & (at < len(coarse))).all():
                        raise ValueError("an assignment names no coarse centroid")
                    _, rest, _ = remainder(x, coarse, norms, at)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), list_of(rest, pa.float32())], names=["vec_id", "vector"])

        if assignments is None:
            points = flat_tokens(docs).withColumn("coarse", F.lit(None).cast("int"))
        else:
            both = docs.select("doc_id", "tokens").join(assignments.select("doc_id", F.col("coarse").alias("given")), "doc_id")
            same = F.when(F.size("tokens") == F.size("given"), F.arrays_zip("tokens", "given")).otherwise(F.raise_error(F.lit("a document has other numbers of tokens and of assignments")))
            points = both.select("doc_id", F.posexplode(same).alias("token_id", "x")).select(F.xxhash64("doc_id", "token_id").alias("vec_id"), F.col("x.tokens").alias("vector"), F.col("x.given").cast("int").alias("coarse"))
        if sample is not None:
            share = sample / max(1, points.count())
            if share < 1:
                points = points.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
        rest = points.mapInArrow(work, "vec_id long, vector array<float>")
        return TwoLevelQuantizer(coarse, ProductQuantizer.fit(rest, m, Metric.DOT, n_iter, seed), norms)

    def parts(self, t: np.ndarray, coarse: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coarse, codes, norm) of tokens; coarse: their centroids, by default the nearest."""
        if not len(t):
            return np.zeros(0, dtype=np.int32), np.zeros((0, self.pq.m), dtype=np.int16), np.zeros(0, dtype=np.float32)
        at, rest, norm = remainder(t, self.coarse, self.norms, coarse)
        return at.astype(np.int32), self.pq.codes(rest), norm.astype(np.float16).astype(np.float32)

    def encode(self, docs: DataFrame) -> DataFrame:
        """doc_id, tokens of (coarse, codes, norm); norm is 1 without norms."""

        def inner(t):
            at, codes, norm = self.parts(t)
            return pa.StructArray.from_arrays([pa.array(at), list_of(codes, pa.int16()), pa.array(norm)], names=["coarse", "codes", "norm"])

        return _per_token(docs, "struct<coarse:int,codes:array<short>,norm:float>", inner)

    def encode_with_ids(self, docs: DataFrame) -> DataFrame:
        """The same for docs with a column coarse: the centroid of each token, which may be another than the nearest."""

        def work(batches):
            for batch in batches:
                if batch.num_rows:
                    t, offsets = tokens_of(batch.column("tokens"))
                    given = batch.column("coarse")
                    if not (np.asarray(pc.fill_null(pc.list_value_length(given), 0)) == np.diff(offsets)).all():
                        raise ValueError("a document has other numbers of tokens and of coarse ids")
                    at = given.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    if not ((at >= 0) & (at < len(self.coarse))).all():
                        raise ValueError("a coarse id names no centroid")
                    at, codes, norm = self.parts(t, at)
                    inner = pa.StructArray.from_arrays([pa.array(at), list_of(codes, pa.int16()), pa.array(norm)], names=["coarse", "codes", "norm"])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), inner)], names=["doc_id", "tokens"])

        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens", F.col("coarse").cast("array<int>").alias("coarse"))
        return own.mapInArrow(work, "doc_id long, tokens array<struct<coarse:int,codes:array<short>,norm:float>>")

    def from_bytes(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coarse, codes, norm) of to_bytes()."""
        width = 4 + self.pq.m + 2 * self.norms
        if len(raw) % width:
            raise ValueError(f"{len(raw)} bytes are no whole tokens of {width}")
        n = len(raw) // width
        at = np.frombuffer(raw, "<u4", n).astype(np.int32)
        codes = np.frombuffer(raw, np.uint8, n * self.pq.m, 4 * n).reshape(n, self.pq.m).astype(np.int16)
        norm = np.frombuffer(raw, "<f2", n, (4 + self.pq.m) * n).astype(np.float32) if self.norms else np.ones(n, dtype=np.float32)
        return at, codes, norm

    def space_bytes(self) -> int:
        """Two sizes, the coarse centroids and the codebooks as collections."""
        return 16 + 8 + 16 + 4 * self.coarse.size + _books(self.pq)

    def state(self) -> dict[str, np.ndarray]:
        return {**self.pq.state(), "coarse": self.coarse, "norms": np.array(self.norms)}

    @staticmethod
    def from_state(state: dict[str, np.ndarray]) -> TwoLevelQuantizer:
        return TwoLevelQuantizer(state["coarse"], ProductQuantizer.from_state(state), bool(state["norms"]))

    def _read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        inner = column.flatten()
        counts = np.asarray(column.value_lengths().fill_null(0))
        at, codes, norm = inner.field("coarse").to_numpy(zero_copy_only=False), inner.field("codes"), inner.field("norm").to_numpy(zero_copy_only=False)
        return at.astype(np.int64), matrix(codes).astype(np.int64).reshape(len(at), self.pq.m), norm.astype(np.float64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def decode(self, encoded: DataFrame) -> DataFrame:
        """doc_id, tokens."""

        def work(batches):
            for batch in batches:
                if batch.num_rows:
                    at, codes, norm, offsets = self._read(batch.column("tokens"))
                    t = self.coarse[at] + (norm[:, None] * self.pq.decoded(codes)).astype(np.float32) if len(at) else np.zeros((0, self.pq.dim), dtype=np.float32)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), list_of(t, pa.float32()))], names=["doc_id", "tokens"])

        return encoded.select("doc_id", "tokens").mapInArrow(work, "doc_id long, tokens array<array<float>>")

    def to_bytes(self, t: np.ndarray) -> bytes:
        """A document's blocked form: coarse ids (u32), codes (u8), norms (f16, with norms only), little-endian."""
        at, codes, norm = self.parts(t)
        return at.astype("<u4").tobytes() + codes.astype(np.uint8).tobytes() + (norm.astype("<f2").tobytes() if self.norms else b"")

    def top_k(self, encoded: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        def prepare(q):
            tables = _tables(self.pq, q)
            return tables, (None if tables is None else self.coarse.astype(np.float64) @ q.astype(np.float64).T)

        def similarity(made, q, batch):
            at, codes, norm, offsets = self._read(batch.column("tokens"))
            _checked(q, self.pq.dim)
            if not len(at) or not len(q):
                return np.zeros((len(at), len(q))), offsets
            return made[1][at] + norm[:, None] * adc(made[0], codes, len(q)), offsets

        return _search(encoded, ["tokens"], queries, k, prepare, similarity)


def remainder(x: np.ndarray, coarse: np.ndarray, norms: bool, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coarse centroid, remainder, norm): with norms the remainder has length 1. at: the centroids, by default the nearest."""
    if at is None:
        at, _ = nearest_rows(x, coarse)
    rest = x - coarse[at].astype(np.float32)
    if not norms:
        return at, rest, np.ones(len(x), dtype=np.float32)
    norm = np.maximum(np.sqrt((rest.astype(np.float64) ** 2).sum(axis=1)), 1e-12).astype(np.float32)
    return at, rest / norm[:, None], norm
