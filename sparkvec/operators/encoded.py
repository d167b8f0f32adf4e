"""Collections whose rows a trained encoder has made: they are searched as they are, decoded, saved and measured."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvec.operators.dataset import VectorDataset
from sparkvec.operators.multivec import TokenQuantizer, TwoLevelQuantizer
from sparkvec.operators.packed import PackedEncoder
from sparkvec.operators.pq import ProductQuantizer
from sparkvec.schema import Layout, Meta, Metric

ENCODERS: dict[str, Any] = {"pq": ProductQuantizer, "packed": PackedEncoder, "token_pq": TokenQuantizer, "two_level": TwoLevelQuantizer}


def fit(data: VectorDataset, encoder: str, **options):
    """Trains an encoder on a plain collection: pq (m, n_iter, seed), packed (order), token_pq (m, n_iter, seed), two_level (coarse, m, n_iter, seed)."""
    want = {"pq": Layout.DENSE, "packed": Layout.SPARSE, "token_pq": Layout.MULTIVEC, "two_level": Layout.MULTIVEC}
    if encoder not in want or data.meta.layout is not want[encoder]:
        raise ValueError(f"no encoder {encoder} for {data.meta.layout.value} collections")
    if encoder == "pq":
        return ProductQuantizer.fit(data.df, metric=data.meta.metric, **options)
    if data.meta.metric is not Metric.DOT:
        raise ValueError(f"{encoder} is for dot products")
    if encoder == "packed":
        return PackedEncoder.fit(data.df, data.meta.dim, **options)
    if encoder == "token_pq":
        from sparkvec.operators.multivec import flat_tokens

        return TokenQuantizer(ProductQuantizer.fit(flat_tokens(data.df), **options))
    return TwoLevelQuantizer.fit(data.df, **options)


@dataclass(frozen=True)
class EncodedDataset:
    """Encoded rows, their encoder, and what the plain collection was."""

    df: DataFrame
    encoder: Any
    meta: Meta

    @staticmethod
    def of(data: VectorDataset, encoder) -> EncodedDataset:
        """A plain collection (or a name in ENCODERS with fit()), encoded."""
        if isinstance(encoder, ProductQuantizer) and encoder.metric is not data.meta.metric:
            encoder = ProductQuantizer(encoder.codebook, data.meta.metric)
        return EncodedDataset(encoder.encode(data.df), encoder, data.meta)

    @property
    def key(self) -> str:
        return "doc_id" if self.meta.layout is Layout.MULTIVEC else "vec_id"

    @property
    def kind(self) -> str:
        return next(k for k, v in ENCODERS.items() if type(self.encoder) is v)

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.limit(1).count() == 0

    def get(self, vec_id: int) -> DataFrame:
        found = self.df.where(F.col(self.key) == vec_id)
        if not found.limit(1).count():
            raise IndexError(f"no vector {vec_id}")
        return found

    def append(self, rows: DataFrame) -> EncodedDataset:
        """More plain rows, encoded; their ids 0, 1, ... go on behind the largest one."""
        last = self.df.agg(F.max(self.key)).first()[0]
        more = self.encoder.encode(rows).withColumn(self.key, F.col(self.key) + F.lit(0 if last is None else last + 1))
        return EncodedDataset(self.df.unionByName(more), self.encoder, self.meta)

    def decoded(self) -> VectorDataset:
        return VectorDataset(self.encoder.decode(self.df), self.meta)

    def as_queries(self, ids: Column | None = None) -> DataFrame:
        """Stored vectors (those whose ids meet the condition), decoded, as queries."""
        chosen = self.df if ids is None else self.df.where(ids)
        return VectorDataset(self.encoder.decode(chosen), self.meta).as_queries()

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, rank, score: plain queries against the encoded rows."""
        return self.encoder.top_k(self.df, queries, k)

    def nearest(self, queries: DataFrame) -> DataFrame:
        return self.search(queries, 1).drop("rank")

    def nnz(self) -> int:
        if self.kind == "packed":
            return self.df.agg(F.sum("n_components")).first()[0] or 0
        codes = "codes" if self.kind == "pq" else "tokens"
        width = self.encoder.m if self.kind == "pq" else self._token_bytes()
        return (len(self) if codes == "codes" else self.df.agg(F.sum(F.size("tokens"))).first()[0] or 0) * width

    def _token_bytes(self) -> int:
        """Bytes of a stored token: its codes, and with two levels its coarse number and norm."""
        return self.encoder.pq.m + (4 + 2 * self.encoder.norms if self.kind == "two_level" else 0)

    def space_bytes(self) -> int:
        """Bytes of the frozen form: buffers, offsets and the encoder."""
        own = self.encoder.space_bytes()
        if self.kind == "pq":
            return own + 16 + self.nnz()
        offsets = 16 + 8 * (len(self) + 1)
        if self.kind == "packed":
            return own + offsets + 16 + (self.df.agg(F.sum(F.length("packed"))).first()[0] or 0) + 8
        return own + offsets + 16 + self.nnz()
