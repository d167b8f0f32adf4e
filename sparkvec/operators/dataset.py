"""A collection: rows with explicit ids, and what they are."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvec.functions import codec as C
from sparkvec.functions import distance as D
from sparkvec.operators import search
from sparkvec.schema import Codec, Layout, Meta, Metric, require, valid_dense, valid_sparse


#: Ids whose sizes one task adds up.
RANGE = 1 << 16


class Index(Protocol):
    """What a first stage offers."""

    def n_elements(self) -> int: ...

    def dim(self) -> int: ...

    def space_bytes(self) -> int: ...

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


@dataclass(frozen=True)
class VectorDataset:
    """Dense, sparse, packed or multivector rows. Every change gives another collection."""

    df: DataFrame
    meta: Meta

    @property
    def key(self) -> str:
        return "doc_id" if self.meta.layout is Layout.MULTIVEC else "vec_id"

    # access
    def get(self, vec_id: int) -> DataFrame:
        """The row of an id; reading it fails where there is none."""
        found = self.df.where(F.col(self.key) == vec_id)
        if not found.limit(1).count():
            raise IndexError(f"no vector {vec_id}")
        return found

    def scan(self, descending: bool = False) -> DataFrame:
        return self.df.orderBy(F.col(self.key).desc() if descending else F.col(self.key))

    def sizes(self) -> DataFrame:
        """id and the number of stored elements of each row."""
        size = {
            Layout.DENSE: lambda: F.lit(self.meta.dim),
            Layout.SPARSE: lambda: F.size("components"),
            Layout.PACKED: lambda: F.length("packed") / 8,
            Layout.MULTIVEC: lambda: F.size("tokens") * self.meta.dim,
        }[self.meta.layout]()
        return self.df.select(self.key, size.cast("long").alias("size"))

    def ranges(self) -> DataFrame:
        """id, start, end of each row in the collection's flat buffers."""
        if self.meta.layout is Layout.DENSE:  # fixed stride: no running sum
            at = F.col(self.key) * self.meta.dim
            return self.df.select(self.key, at.alias("start"), (at + self.meta.dim).alias("end"))
        # A running sum over ranges of ids: the ranges' totals first, then within them.
        sizes = self.sizes().withColumn("p", F.floor(F.col(self.key) / RANGE).cast("long"))
        own = Window.partitionBy("p").orderBy(self.key).rowsBetween(Window.unboundedPreceding, 0)
        totals = sizes.groupBy("p").agg(F.sum("size").alias("total"))
        before = totals.select("p", (F.sum("total").over(Window.orderBy("p")) - F.col("total")).alias("before"))  # a row for RANGE ids
        end = F.col("before") + F.sum("size").over(own)
        return sizes.join(before, "p").select(self.key, (end - F.col("size")).alias("start"), end.alias("end"))

    def id_of_range(self, start: int, end: int) -> int:
        """The id whose range this is."""
        found = self.ranges().where((F.col("start") == start) & (F.col("end") == end)).agg(F.min(self.key)).first()[0]
        if found is None:
            raise IndexError(f"no vector has the range {start}..{end}")
        return found

    def get_by_range(self, start: int, end: int) -> DataFrame:
        return self.get(self.id_of_range(start, end))

    # size
    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.limit(1).count() == 0

    def nnz(self) -> int:
        if self.meta.layout is Layout.PACKED:
            return self.df.agg(F.sum("n_components")).first()[0] or 0
        return self.sizes().agg(F.sum("size")).first()[0] or 0

    def space_bytes(self) -> int:
        """Bytes of the frozen form: flat buffers and offsets, without the encoder."""
        r = self.sizes().agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
        width = self.meta.codec.width
        if self.meta.layout is Layout.DENSE:
            return 16 + r.s * width
        offsets = 16 + 8 * (r.n + 1)
        if self.meta.layout is Layout.SPARSE:
            return offsets + 16 + r.s * (2 if self.meta.dim <= 1 << 16 else 4) + 16 + r.s * width
        return offsets + 16 + r.s * (8 if self.meta.layout is Layout.PACKED else width)

    # change
    def checked(self) -> VectorDataset:
        """The same rows, failing on read where one isn't valid."""
        if self.meta.layout is Layout.DENSE:
            return replace(self, df=require(self.df, valid_dense(F.col("vector"), self.meta.dim), "not a valid dense vector"))
        if self.meta.layout is Layout.SPARSE:
            return replace(self, df=require(self.df, valid_sparse(F.col("components"), F.col("values"), self.meta.dim), "not a valid sparse vector"))
        if self.meta.layout is Layout.MULTIVEC:
            return replace(self, df=require(self.df, F.col("tokens").isNotNull() & F.forall("tokens", lambda t: valid_dense(t, self.meta.dim)), "not valid token vectors"))
        return replace(self, df=require(self.df, (F.length("packed") > 0) & (F.length("packed") % 8 == 0), "not a packed vector"))

    def append(self, rows: DataFrame) -> VectorDataset:
        """More rows; their ids 0, 1, ... go on behind the largest one."""
        last = self.df.agg(F.max(self.key)).first()[0]
        moved = rows.withColumn(self.key, F.col(self.key) + F.lit(0 if last is None else last + 1))
        return replace(self, df=self.df.unionByName(moved))

    def convert(self, codec: Codec | str, **options):
        """The values as another codec keeps them, or as an encoder (pq, packed, token_pq, two_level) trained on them with these options."""
        if codec not in [c.value for c in Codec] and not isinstance(codec, Codec):
            from sparkvec.operators import encoded

            return encoded.EncodedDataset.of(self, encoded.fit(self, codec, **options))
        codec = Codec(codec)
        column, how = {Layout.DENSE: ("vector", C.store_all), Layout.SPARSE: ("values", C.store_all), Layout.MULTIVEC: ("tokens", C.store_tokens)}[self.meta.layout]
        return VectorDataset(self.df.withColumn(column, how(F.col(column), codec)), replace(self.meta, codec=codec))

    def relabel(self, metric: Metric | str | None = None, codec: Codec | str | None = None) -> VectorDataset:
        """The same rows under another name."""
        return VectorDataset(self.df, replace(self.meta, metric=Metric(metric or self.meta.metric), codec=Codec(codec or self.meta.codec)))

    def freeze(self) -> VectorDataset:
        return self

    # search
    def search(self, queries: DataFrame, k: int, strategy: str = "block") -> DataFrame:
        if self.meta.layout is Layout.DENSE:
            return search.top_k(self.df, queries, k, self.meta.metric, strategy)
        if self.meta.layout is Layout.SPARSE:
            checked = require(queries, valid_sparse(F.col("components"), F.col("values"), self.meta.dim), "a query is not a valid sparse vector of this dimension")
            return search.sparse_top_k(self.df, checked, k, self.meta.metric)
        if self.meta.layout is Layout.MULTIVEC:
            from sparkvec.operators.multivec import maxsim_top_k

            return maxsim_top_k(self.df, queries, k)
        raise ValueError("packed rows are searched as an EncodedDataset, which knows their mapping")

    def nearest(self, queries: DataFrame) -> DataFrame:
        return self.search(queries, 1).drop("rank")

    def decoded(self) -> VectorDataset:
        return self

    def as_queries(self, ids: Column | None = None) -> DataFrame:
        """Stored vectors (those whose ids meet the condition) as queries."""
        chosen = self.df if ids is None else self.df.where(ids)
        return chosen.withColumnRenamed(self.key, "query_id")

    def pairwise(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
        """(queries, documents, the score over the columns of both), for search.top_k_by() and rerank."""
        layout, c = self.meta.layout, F.col
        if layout is Layout.DENSE:
            score = D.checked_distance(c("qv"), c("dv"), self.meta.metric)
            return queries.select("query_id", c("vector").alias("qv")), self.df.select(c("vec_id").alias("doc_id"), c("vector").alias("dv")), score
        if layout is Layout.SPARSE:
            q, d = queries.select("query_id", c("components").alias("qc"), c("values").alias("qv")), self.df.select(c("vec_id").alias("doc_id"), c("components").alias("dc"), c("values").alias("dv"))
            dot = D.sparse_dot(c("qc"), c("qv"), c("dc"), c("dv"))
            return q, d, dot if self.meta.metric is Metric.DOT else D.sparse_l2(dot, D.norm(c("qv")), D.norm(c("dv")))
        if layout is Layout.MULTIVEC:
            return queries.select("query_id", c("tokens").alias("qt")), self.df.select("doc_id", c("tokens").alias("dt")), D.maxsim(c("qt"), c("dt"))
        raise ValueError("packed rows have no score of their own")


def sparse_dim(docs: DataFrame) -> int:
    """The largest component plus 1."""
    top = docs.agg(F.max(F.array_max("components"))).first()[0]
    return 0 if top is None else top + 1


@dataclass(frozen=True)
class ExhaustiveIndex:
    """An Index that scores everything."""

    data: VectorDataset  # or an EncodedDataset

    def n_elements(self) -> int:
        return len(self.data)

    def dim(self) -> int:
        return self.data.meta.dim

    def space_bytes(self) -> int:
        return self.data.space_bytes()

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.data.search(queries, k)

    @staticmethod
    def build(data, encoder: str | None = None, **options) -> ExhaustiveIndex:
        """An index over a collection, encoded first if an encoder is named."""
        return ExhaustiveIndex(data if encoder is None else data.convert(encoder, **options))
