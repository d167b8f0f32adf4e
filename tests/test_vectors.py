"""Literal cases of distances, codecs, search and collections."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.functions import codec as C
from sparkvec.functions import distance as D
from sparkvec.operators import common, search
from sparkvec.operators.dataset import ExhaustiveIndex, VectorDataset, sparse_dim
from sparkvec.schema import Codec, Layout, Meta, Metric, finite, strictly_sorted, valid_sparse


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def vec(*values):
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def ints(*values):
    return F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<long>")


def floats(*values):
    return vec(*values) if values else F.array().cast("array<float>")


@pytest.mark.parametrize("a,b,want", [((1, 2, 3), (2, 1.5, 0.5), 6.5), ((2, 1), (1, 3), 5.0)])
def test_dense_dot(spark, a, b, want):
    assert value(spark, D.dot(vec(*a), vec(*b))) == want


@pytest.mark.parametrize("a,b,want", [((0, 2), (3, 1), 10.0), ((1, 2), (2, 3), 2.0)])
def test_dense_l2(spark, a, b, want):
    assert value(spark, D.l2(vec(*a), vec(*b))) == want


@pytest.mark.parametrize("q,c,v,want", [((1, 2, 3), (0, 2), (1, 1), 4.0), ((1, 2, 3), (0, 2), (2, 4), 14.0)])
def test_dense_sparse(spark, q, c, v, want):
    assert value(spark, D.dense_sparse_dot(vec(*q), ints(*c), vec(*v))) == want


@pytest.mark.parametrize(
    "a,b,want",
    [(((0, 2), (1, 2)), ((0, 2), (3, 4)), 11.0), (((0, 1, 3), (1, 2, 4)), ((0, 3), (3, 1)), 7.0), (((0, 2), (1, 2)), ((), ()), 0.0), (((0, 1), (1, 2)), ((2,), (3,)), 0.0)],
)
def test_sparse_dot(spark, a, b, want):
    assert value(spark, D.sparse_dot(ints(*a[0]), floats(*a[1]), ints(*b[0]), floats(*b[1]))) == want


def test_sparse_l2_is_dense_l2(spark):
    dot = D.sparse_dot(ints(0, 2), vec(3, 1), ints(0, 1, 2), vec(2, 4, -1))
    assert value(spark, D.sparse_l2(dot, D.norm(vec(3, 1)), D.norm(vec(2, 4, -1)))) == 18.0 + 3.0
    dot = D.dense_sparse_dot(vec(1, 2.5, 0), ints(0, 2), vec(2, -1))
    assert value(spark, D.sparse_l2(dot, D.norm(vec(1, 2.5, 0)), D.norm(vec(2, -1)))) == 8.25
    assert value(spark, D.euclidean(F.lit(16.0))) == 4.0


def test_orders(spark):
    assert value(spark, D.better(F.lit(1), F.lit(2), "euclidean")) and value(spark, D.better(F.lit(2), F.lit(1), "dotproduct"))


L2_CASES = [(100, 100, 0, True), (101, 100, 0, False), (110, 100, 0.1, True), (111, 100, 0.1, False), (120, 100, 0.2, True), (120.001, 100, 0.2, False), (150, 100, 1, True), (200, 100, 1, True)]
DOT_CASES = [(0.9, 0.9, 0, True), (0.89, 0.9, 0, False), (0.85, 0.9, 0.1, True), (0.81, 0.9, 0.1, True), (0.80, 0.9, 0.1, False), (0.8, 1, 0.2, True), (0.799, 1, 0.2, False), (-0.55, -0.5, 0.2, True), (-0.65, -0.5, 0.2, False)]


@pytest.mark.parametrize("metric,cases", [("euclidean", L2_CASES), ("dotproduct", DOT_CASES)])
def test_relaxation(spark, metric, cases):
    row = spark.range(1).select(*[D.within_relaxation(F.lit(float(s)), F.lit(float(t)), x, metric).alias(f"c{i}") for i, (s, t, x, _) in enumerate(cases)]).first()
    assert list(row) == [c[3] for c in cases]
    for bad in (-0.1, math.inf, math.nan):
        with pytest.raises(ValueError):
            D.within_relaxation(F.lit(1.0), F.lit(1.0), bad, metric)


@pytest.mark.parametrize("bad", [0, 1, 2])
def test_errors(spark, bad):
    column = [lambda: D.checked_distance(vec(1), vec(1, 2), "dotproduct"), lambda: D.dense_sparse_dot(vec(1, 2), ints(4), vec(1)), lambda: D.not_nan(F.lit(float("nan")))][bad]()
    with pytest.raises(Exception):
        value(spark, column)


def test_checks(spark):
    assert value(spark, strictly_sorted(ints(1, 2, 3))) and not value(spark, strictly_sorted(ints(1, 1, 2))) and value(spark, strictly_sorted(ints()))
    assert value(spark, valid_sparse(ints(), floats())) and not value(spark, valid_sparse(ints(1, 9), vec(1, 2), 9)) and not value(spark, valid_sparse(ints(1), vec(1, 2)))
    assert not value(spark, finite(vec(1, math.nan))) and not value(spark, finite(vec(math.inf)))


@pytest.mark.parametrize("query,tokens,want", [([(1, 2, 3)], [(4, 5, 6)], 32.0), ([(1, 0), (0, 1)], [(3, 4)], 7.0), ([(1, 0), (0, 1)], [(3, 0), (0, 5)], 8.0), ([(1, 0)], [(2, 3)], 2.0), ([(1, 0)], [], -math.inf), ([], [(1, 0)], 0.0)])
def test_maxsim(spark, query, tokens, want):
    many = lambda t: F.array(*[vec(*v) for v in t]).cast("array<array<float>>")
    assert value(spark, D.maxsim(many(query), many(tokens))) == want


def bf16(x):
    raw = x.astype(np.float32).view(np.uint32).astype(np.uint64)
    return ((raw + 0x7FFF + ((raw >> 16) & 1)) >> 16 << 16).astype(np.uint32).view(np.float32)


def test_codecs_match_numpy(spark):
    random = np.random.default_rng(0)
    x = np.concatenate([random.normal(size=500), random.normal(size=300) * 1e4, random.normal(size=300) * 1e-6, [0, -0.0, 1, 1.5, 2, 2.5, 65504, 65519, 65520, -70000, 6e-8, 2**-25, 1 / 128, 3 / 128, 3.99, 5]]).astype(np.float32)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x float").repartition(2)
    got = df.select("i", *[C.store(F.col("x"), c).alias(c.value) for c in Codec]).orderBy("i").toPandas()
    want = {"f32": x, "f64": x.astype(float), "bf16": bf16(x), "fixedu8": np.clip(np.rint(x.astype(float) * 64), 0, 255) / 64, "fixedu16": np.clip(np.rint(x.astype(float) * 8192), 0, 65535) / 8192}
    with np.errstate(over="ignore"):
        want["f16"] = x.astype(np.float16).astype(np.float32)
    for name, expected in want.items():
        np.testing.assert_array_equal(got[name].to_numpy(), expected.astype(got[name].dtype), err_msg=name)


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, vector array<float>")
    queries = spark.createDataFrame([(0, [1.5, 1.0])], "query_id long, vector array<float>")
    return VectorDataset(docs, Meta(Layout.DENSE, 2)), queries


@pytest.mark.parametrize("strategy", ["expr", "block"])
def test_top_k(small, spark, strategy):
    data, queries = small
    assert [(r.doc_id, r.rank, r.score) for r in data.search(queries, 2, strategy).orderBy("rank").collect()] == [(2, 1, 4.0), (0, 2, 2.0)]
    more = data.append(spark.createDataFrame([(0, [5.0, 5.0]), (1, [6.0, 6.0])], "vec_id long, vector array<float>"))
    assert [r.doc_id for r in more.search(queries, 2, strategy).orderBy("rank").collect()] == [4, 3]
    assert data.search(queries, 0, strategy).count() == 0 and data.search(queries, 9, strategy).count() == 3
    assert VectorDataset(data.df.limit(0), data.meta).search(queries, 3, strategy).count() == 0


@pytest.mark.parametrize("metric", list(Metric))
def test_strategies_agree_bit_for_bit(spark, metric, monkeypatch):
    random = np.random.default_rng(1)
    rows = [(i, random.integers(-2, 3, 6).astype(float).tolist() if i % 2 else random.normal(size=6).tolist()) for i in range(120)]
    docs = spark.createDataFrame(rows, "vec_id long, vector array<float>").repartition(3)
    queries = docs.where("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    want = sorted(map(tuple, search.top_k(docs, queries, 7, metric, "expr").collect()))
    assert sorted(map(tuple, search.top_k(docs, queries, 7, metric, "block").collect())) == want
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)  # many queries: blocks meet pair by pair
    assert sorted(map(tuple, search.top_k(docs, queries, 7, metric, "block").collect())) == want


def test_bad_vectors_are_refused(spark, small):
    data, queries = small
    with pytest.raises(Exception):
        data.search(spark.createDataFrame([(0, [1.0])], "query_id long, vector array<float>"), 1).collect()
    with pytest.raises(Exception):
        VectorDataset(spark.createDataFrame([(0, [float("nan"), 1.0])], "vec_id long, vector array<float>"), data.meta).checked().df.collect()
    with pytest.raises(ValueError):
        search.top_k(data.df, queries, 1, "dotproduct", "other")


def test_ranges_and_access(spark, small):
    data, _ = small
    assert sorted(map(tuple, data.ranges().collect())) == [(0, 0, 2), (1, 2, 4), (2, 4, 6)]
    assert data.id_of_range(2, 4) == 1 and data.get_by_range(2, 4).first().vec_id == 1 and len(data) == 3 and data.nnz() == 6
    assert [r.vec_id for r in data.scan(descending=True).collect()] == [2, 1, 0]
    for bad in (lambda: data.get(7), lambda: data.id_of_range(1, 3)):
        with pytest.raises(IndexError):
            bad()
    sparse = VectorDataset(spark.createDataFrame([(0, [0, 2], [1.0, 2.0]), (1, [1, 3], [1.0, 2.0])], "vec_id long, components array<long>, values array<float>"), Meta(Layout.SPARSE, 4))
    assert sorted(map(tuple, sparse.ranges().collect())) == [(0, 0, 2), (1, 2, 4)] and sparse_dim(sparse.df) == 4 and sparse.nnz() == 4
    many = VectorDataset(spark.createDataFrame([(0, [[1.0, 2.0], [3.0, 4.0]]), (1, [[1.0, 2.0], [3.0, 4.0]])], "doc_id long, tokens array<array<float>>"), Meta(Layout.MULTIVEC, 2))
    assert sorted(map(tuple, many.ranges().collect())) == [(0, 0, 4), (1, 4, 8)]
    assert data.space_bytes() == 16 + 24 and data.freeze() is data and data.relabel("euclidean").meta.metric is Metric.L2
    index = ExhaustiveIndex(data)
    assert index.n_elements() == 3 and index.dim() == 2


def test_conversion(spark):
    sparse = VectorDataset(spark.createDataFrame([(0, [0, 2], [1.25, 2.5]), (1, [1, 3], [3.5, 4.25])], "vec_id long, components array<long>, values array<float>"), Meta(Layout.SPARSE, 4))
    back = sparse.convert("f16").convert("f32")
    assert sorted(map(str, back.df.collect())) == sorted(map(str, sparse.df.collect())) and back.meta.codec is Codec.F32


def test_sparse_search_counts_every_document(spark):
    docs = spark.createDataFrame([(0, [0], [-1.0]), (1, [5], [1.0]), (2, [0, 1], [1.0, 1.0]), (3, [], [])], "vec_id long, components array<long>, values array<float>")
    queries = spark.createDataFrame([(0, [0, 1], [1.0, 2.0]), (1, [9], [1.0]), (2, [], [])], "query_id long, components array<long>, values array<float>")
    rows = sorted(map(tuple, search.sparse_top_k(docs, queries, 3).collect()))
    assert rows == [(0, 1, 2, 0.0), (0, 2, 1, 3.0), (0, 3, 3, 0.0), (1, 0, 1, 0.0), (1, 1, 2, 0.0), (1, 2, 3, 0.0), (2, 0, 1, 0.0), (2, 1, 2, 0.0), (2, 2, 3, 0.0)]
    l2 = sorted(map(tuple, search.sparse_top_k(docs, queries.where("query_id = 0"), 4, "euclidean").collect()))
    assert l2 == [(0, 0, 4, 8.0), (0, 1, 3, 6.0), (0, 2, 1, 1.0), (0, 3, 2, 5.0)]


def test_sparse_dot_of_long_vectors(spark):
    """By a sort and not by a look-up a component, which took 20 ms a pair of 600 components; sums run by component."""
    random = np.random.default_rng(4)
    rows, want = [], []
    for i in range(40):
        c = [np.sort(random.choice(6_000, 4_000, replace=False)) for _ in "ab"]
        v = [random.normal(size=4_000).astype(np.float32) for _ in "ab"]
        common, x, y = np.intersect1d(*c, return_indices=True)
        rows.append((i, c[0].tolist(), v[0].tolist(), c[1].tolist(), v[1].tolist()))
        want.append(float(np.cumsum(v[0][x].astype(float) * v[1][y].astype(float))[-1]))
    df = spark.createDataFrame(rows, "i int, ac array<long>, av array<float>, bc array<long>, bv array<float>")
    product = D.sparse_dot(*map(F.col, ("ac", "av", "bc", "bv")))
    assert [r.p for r in df.select("i", product.alias("p")).orderBy("i").collect()] == want
    assert "map_from_arrays" not in df.select(product)._jdf.queryExecution().optimizedPlan().toString()
    assert value(spark, D.sparse_dot(ints(3, 1), vec(2, 5), ints(1, 2), vec(4, 7))) == 20.0 and value(spark, D.sparse_dot(ints(), vec(), ints(), vec())) == 0.0
    for bad in ((ints(1, 1), vec(1, 2)), (ints(1, 2), vec(1))):
        with pytest.raises(Exception):
            value(spark, D.sparse_dot(ints(1), vec(1), *bad))
