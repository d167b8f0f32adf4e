"""Layouts, metrics and value codecs, and the checks that vectors must pass."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Metric(str, Enum):
    DOT = "dotproduct"
    L2 = "euclidean"

    @property
    def larger_is_better(self) -> bool:
        return self is Metric.DOT


class Layout(str, Enum):
    DENSE = "dense"
    SPARSE = "sparse"
    PACKED = "packed"
    MULTIVEC = "multivec"


class Codec(str, Enum):
    F32 = "f32"
    F64 = "f64"
    F16 = "f16"
    BF16 = "bf16"
    FIXEDU8 = "fixedu8"
    FIXEDU16 = "fixedu16"

    @property
    def width(self) -> int:
        """Bytes of a stored value."""
        return {"f32": 4, "f64": 8, "f16": 2, "bf16": 2, "fixedu8": 1, "fixedu16": 2}[self.value]


VECTOR = T.ArrayType(T.FloatType(), False)
DENSE = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("vector", VECTOR)])
SPARSE = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("components", T.ArrayType(T.LongType(), False)), T.StructField("values", VECTOR)])
PACKED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("packed", T.BinaryType()), T.StructField("n_components", T.IntegerType())])
MULTIVEC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.ArrayType(VECTOR, False))])
RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())])


@dataclass(frozen=True)
class Meta:
    """What a collection is, beside its rows."""

    layout: Layout
    dim: int
    codec: Codec = Codec.F32
    metric: Metric = Metric.DOT
    encoder: dict = field(default_factory=dict)


def finite(vector: Column) -> Column:
    """No null, NaN or infinite element."""
    return F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def valid_dense(vector: Column, dim: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == dim) & finite(vector)


def strictly_sorted(items: Column) -> Column:
    """Each element is larger than the one before it."""
    return (F.size(items) < 2) | F.forall(F.zip_with(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"] < p["b"])


def valid_sparse(components: Column, values: Column, dim: int | None = None, wide: bool = True) -> Column:
    """Equally long, strictly ascending, within the dimension, finite; empty vectors are fine."""
    top = F.lit((1 << 32) - 1 if wide else (1 << 16) - 1) if dim is None else F.lit(dim - 1)
    inside = (F.size(components) == 0) | ((F.element_at(components, 1) >= 0) & (F.element_at(components, -1) <= top))
    return components.isNotNull() & values.isNotNull() & (F.size(components) == F.size(values)) & strictly_sorted(components) & inside & finite(values)


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, which fails when a row that doesn't meet the condition is read."""
    first = df.columns[0]
    checked = F.when(F.coalesce(condition, F.lit(False)), F.col(first)).otherwise(F.raise_error(F.lit(message)))
    return df.select(checked.alias(first), *df.columns[1:])
