"""Ground truth from the command line: python -m sparkvec.cli -i docs -q queries -o out [-k 10] ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.operators import packed
from sparkvec.operators.dataset import VectorDataset, sparse_dim
from sparkvec.operators.pq import ProductQuantizer
from sparkvec.schema import Codec, Layout, Meta, Metric
from sparkvec.sources.binary import read_npy, read_sparse
from sparkvec.sources.store import write_ground_truth


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkvec", description="Exact top-k of queries over a collection.")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-q", "--queries", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-k", type=int, default=10)
    p.add_argument("-d", "--distance", type=str.lower, default="euclidean")
    p.add_argument("-v", "--value-type", type=str.lower, default="f32")
    p.add_argument("--dataset-type", type=str.lower, default="dense")
    p.add_argument("--component-type", type=str.lower, default="u32")
    p.add_argument("--encoder", type=str.lower, default="plain")
    p.add_argument("--pq-subspaces", type=int, default=0)
    return p


def check(a: argparse.Namespace) -> None:
    """Raises for what can't be combined."""
    if a.distance not in ("euclidean", "dotproduct"):
        raise ValueError(f"no distance {a.distance}")
    if a.value_type not in ("f32", "f16", "bf16", "fixedu8", "fixedu16"):
        raise ValueError(f"no value type {a.value_type}")
    if a.dataset_type == "dense":
        if a.encoder not in ("plain", "pq"):
            raise ValueError(f"no encoder {a.encoder} for dense vectors")
        if a.encoder == "pq" and a.value_type != "f32":
            raise ValueError("product quantization takes f32 values")
    elif a.dataset_type == "sparse":
        if a.encoder not in ("plain", "dotvbyte"):
            raise ValueError(f"no encoder {a.encoder} for sparse vectors")
        if a.distance != "dotproduct":
            raise ValueError("sparse vectors are compared by dot product")
        if a.component_type not in ("u16", "u32") or (a.encoder == "dotvbyte" and a.component_type != "u16"):
            raise ValueError(f"components of type {a.component_type} don't go with {a.encoder}")
    else:
        raise ValueError(f"no dataset type {a.dataset_type}")


def ground_truth(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    check(a)
    metric, codec = Metric(a.distance), Codec(a.value_type)
    if a.dataset_type == "dense":
        docs, queries = read_npy(spark, a.input), read_npy(spark, a.queries).withColumnRenamed("vec_id", "query_id")
        if a.encoder == "pq":
            pq = ProductQuantizer.fit(docs, a.pq_subspaces, metric)
            return pq.top_k(pq.encode(docs), queries, a.k)
        first = docs.first()
        dim = len(first.vector) if first else 0
        return VectorDataset(docs, Meta(Layout.DENSE, dim, metric=metric)).convert(codec).search(queries, a.k)
    docs, queries = read_sparse(spark, a.input, component=a.component_type), read_sparse(spark, a.queries, component=a.component_type).withColumnRenamed("vec_id", "query_id")
    data = VectorDataset(docs, Meta(Layout.SPARSE, sparse_dim(docs), metric=metric)).convert(codec)
    if a.encoder == "dotvbyte":
        mapping = packed.train_mapping(data.df, data.meta.dim)
        return packed.top_k(packed.pack(data.df, mapping), queries, mapping, a.k)
    return data.search(queries, a.k)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        check(a)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("sparkvec").getOrCreate()
    write_ground_truth(ground_truth(spark, a).select("query_id", "doc_id", F.col("rank"), "score"), a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
