"""One query for every operator, over the driver's tables, and the SQL that each must agree with.

Dense vectors are the embeddings, queries the first 20 of them. Sparse vectors
are suppliers: components are parts, values the ordered quantities. Multivector
documents are four embeddings in a row.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkvec import cli
from sparkvec.functions import codec as C
from sparkvec.functions import distance as D
from sparkvec.operators import evaluate, kmeans, multivec, packed, rerank, search
from sparkvec.operators.common import matrix
from sparkvec.operators.dataset import ExhaustiveIndex, VectorDataset, sparse_dim
from sparkvec.operators.encoded import EncodedDataset
from sparkvec.operators.pq import ProductQuantizer
from sparkvec.schema import Codec, Layout, Meta, Metric, strictly_sorted
from sparkvec.sources import binary, store

K = 10
CODECS = ("f16", "bf16", "fixedu8", "fixedu16")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A file of one split, given to all cores; files of many splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def dense(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


def dense_queries(spark, sf_dir, n: int = 20):
    return dense(spark, sf_dir).where(F.col("vec_id") < n).select(F.col("vec_id").alias("query_id"), "vector")


def sparse(spark, sf_dir, scale: float = 1.0, ordered: bool = False):
    """One exchange, by supplier, serves both sums; ordered: by ranges of them, and rows by vec_id."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    lines = lines.repartitionByRange("l_suppkey") if ordered else lines.repartition("l_suppkey")
    sums = lines.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("v"))
    item = F.struct(F.col("l_partkey").alias("c"), (F.col("v") * F.lit(scale)).cast("float").alias("v"))
    rows = sums.groupBy(F.col("l_suppkey").alias("vec_id")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    rows = rows.select("vec_id", F.col("items.c").alias("components"), F.col("items.v").alias("values"))
    return rows.sortWithinPartitions("vec_id") if ordered else rows


def _stored_sparse(spark, sf_dir, scale: float = 1 / 64):
    """The same, written once: training and packing look at it several times."""
    path = f"{store.shared_folder(spark)}/sparse"
    sparse(spark, sf_dir, scale).write.parquet(path)
    return spark.read.parquet(path)


def sparse_queries(spark, sf_dir, n: int = 5, scale: float = 1.0):
    return sparse(spark, sf_dir, scale).where(F.col("vec_id") < n).withColumnRenamed("vec_id", "query_id")


def tokens(spark, sf_dir):
    rows = dense(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 4).cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector"))).alias("items"))
    return rows.select("doc_id", F.col("items.vector").alias("tokens"))


def token_queries(spark, sf_dir, n: int = 5):
    return tokens(spark, sf_dir).where(F.col("doc_id") < n).withColumnRenamed("doc_id", "query_id")


def first_rows(spark, sf_dir, n: int) -> np.ndarray:
    return matrix(dense(spark, sf_dir).where(F.col("vec_id") < n).orderBy("vec_id").toArrow().column("vector"))


def fixed_pq(spark, sf_dir, metric="dotproduct", m: int = 8) -> ProductQuantizer:
    """Centroid c of part j is part j of embedding c."""
    x = first_rows(spark, sf_dir, 256)
    return ProductQuantizer(x.reshape(256, m, -1).transpose(1, 0, 2).copy(), Metric(metric))


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# SQL pieces
def sum_of(a: str, b: str, term: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {term}))"


def dot_sql(a: str, b: str) -> str:
    return sum_of(a, b, "z[1]::DOUBLE * z[2]::DOUBLE")


def l2_sql(a: str, b: str) -> str:
    return sum_of(a, b, "(z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)")


def stored_sql(x: str, codec: str) -> str:
    d = f"({x})::FLOAT::DOUBLE"
    if codec in ("f16", "bf16"):
        digits, least, top = (10, -14, 65504) if codec == "f16" else (7, -126, "3.3895313892515355e38")
        unit = f"pow(2.0, greatest(floor(log2(abs({d}))), {least}) - {digits})"
        r = f"round_even({d} / {unit}, 0) * {unit}"
        return f"(CASE WHEN {d} = 0 THEN 0.0 WHEN abs({r}) > {top} THEN sign({d}) * 'infinity'::DOUBLE ELSE {r} END)::FLOAT"
    top, unit = (255, 64) if codec == "fixedu8" else (65535, 8192)
    return f"(greatest(0.0, least({top}.0, round_even({d} * {unit}, 0))) / {unit})::FLOAT"


def direction(metric: str) -> str:
    return "DESC" if metric == "dotproduct" else "ASC"


def top_sql(scored: str, metric: str, k: int = K) -> str:
    return f"""SELECT query_id, doc_id, rank, score FROM (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score {direction(metric)}, doc_id)::INTEGER AS rank FROM ({scored}) s
) r WHERE rank <= {k}"""


DENSE_SQL = "d AS (SELECT vec_id AS doc_id, embedding AS v FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id < 20)"


def dense_sql(metric: str, codec: str | None = None, k: int = K) -> str:
    v = "d.v" if codec is None else f"list_transform(d.v, lambda x: {stored_sql('x', codec)})"
    fn = dot_sql if metric == "dotproduct" else l2_sql
    docs = f"e AS (SELECT doc_id, {v} AS v FROM d)"
    return f"WITH {DENSE_SQL}, {docs} " + top_sql(f"SELECT query_id, doc_id, {fn('q.v', 'e.v')} AS score FROM q, e", metric, k)


def _dense_query(name: str, metric: str, codec: str | None):
    def run(spark, sf_dir):
        data = VectorDataset(spread(dense(spark, sf_dir)), Meta(Layout.DENSE, 64, metric=Metric(metric)))
        data = data if codec is None else data.convert(codec)
        return data.search(dense_queries(spark, sf_dir), K)

    run.__name__ = name
    run.__doc__ = f"The {K} best by {metric}" + (f", documents stored as {codec}." if codec else ".")
    query(dense_sql(metric, codec))(run)


for _metric, _short in (("dotproduct", "dot"), ("euclidean", "l2")):
    _dense_query(f"dense_topk_{_short}", _metric, None)
    for _codec in CODECS:
        _dense_query(f"dense_topk_{_codec}_{_short}", _metric, _codec)


@query(dense_sql("dotproduct"))
def dense_topk_expr(spark, sf_dir):
    """The same by expressions alone."""
    return search.top_k(spread(dense(spark, sf_dir)), dense_queries(spark, sf_dir), K, "dotproduct", "expr")


@query(dense_sql("euclidean", k=1).replace("SELECT query_id, doc_id, rank, score", "SELECT query_id, doc_id, score", 1))
def dense_nearest(spark, sf_dir):
    return search.nearest(spread(dense(spark, sf_dir)), dense_queries(spark, sf_dir), "euclidean")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {dot_sql('a.embedding', 'b.embedding')} AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dense_pair_distance(spark, sf_dir):
    d = dense(spark, sf_dir)
    pairs = d.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return search.pair_distance(d, pairs, "dotproduct")


def _relaxed(name: str, metric: str):
    fn = dot_sql if metric == "dotproduct" else l2_sql
    test = "score::FLOAT >= (t::FLOAT - (abs(t::FLOAT) * 0.1::FLOAT)::FLOAT)::FLOAT" if metric == "dotproduct" else "score::FLOAT <= (t::FLOAT * (1::FLOAT + 0.1::FLOAT)::FLOAT)::FLOAT"

    def run(spark, sf_dir):
        d = spread(dense(spark, sf_dir))
        top = search.top_k(d, dense_queries(spark, sf_dir), 5, metric).where("rank = 5").select("query_id", F.col("score").alias("t"))
        scored = search.cross(dense_queries(spark, sf_dir).withColumnRenamed("vector", "qv"), d.select(F.col("vec_id").alias("doc_id"), "vector"))
        scored = scored.select("query_id", "doc_id", D.distance(F.col("qv"), F.col("vector"), metric).alias("score")).join(top, "query_id")
        return search.relaxed(scored, F.col("t"), 0.1, metric).select("query_id", "doc_id", "score")

    run.__name__ = name
    query(f"""WITH {DENSE_SQL}, s AS (SELECT query_id, doc_id, {fn('q.v', 'd.v')} AS score FROM q, d),
t AS (SELECT query_id, score AS t FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score {direction(metric)}, doc_id) = 5)
SELECT query_id, doc_id, score FROM s JOIN t USING (query_id) WHERE {test}""")(run)


_relaxed("relaxation_filter_dot", "dotproduct")
_relaxed("relaxation_filter_l2", "euclidean")


# sparse
def sparse_sql(scale: float = 1.0, codec: str | None = None) -> str:
    v = f"(sum(l_quantity) * {scale})::FLOAT"
    return f"p AS (SELECT l_suppkey AS vec_id, l_partkey AS c, {v if codec is None else stored_sql(v, codec)} AS v, {v} AS raw FROM lineitem GROUP BY 1, 2)"


def sparse_dot_sql(scale: float = 1.0, codec: str | None = None) -> str:
    return f"""WITH {sparse_sql(scale, codec)}, q AS (SELECT vec_id AS query_id, c, raw AS v FROM p WHERE vec_id < 5),
ids AS (SELECT DISTINCT vec_id FROM p), m AS (SELECT query_id, vec_id, sum(q.v::DOUBLE * p.v::DOUBLE) AS s FROM q JOIN p USING (c) GROUP BY 1, 2),
a AS (SELECT query_id, ids.vec_id AS doc_id, coalesce(s, 0.0) AS score FROM (SELECT DISTINCT query_id FROM q) x CROSS JOIN ids LEFT JOIN m USING (query_id, vec_id)) """ + top_sql("SELECT * FROM a", "dotproduct")


@query(sparse_dot_sql())
def sparse_topk_dot(spark, sf_dir):
    return search.sparse_top_k(sparse(spark, sf_dir), sparse_queries(spark, sf_dir), K, "dotproduct")


@query(f"""WITH {sparse_sql()}, q AS (SELECT vec_id AS query_id, c, v FROM p WHERE vec_id < 5),
n AS (SELECT vec_id, sum(v::DOUBLE * v::DOUBLE) AS n FROM p GROUP BY 1), m AS (SELECT query_id, vec_id, sum(q.v::DOUBLE * p.v::DOUBLE) AS s FROM q JOIN p USING (c) GROUP BY 1, 2),
a AS (SELECT x.vec_id AS query_id, n.vec_id AS doc_id, x.n + n.n - 2.0 * coalesce(s, 0.0) AS score FROM n x CROSS JOIN n LEFT JOIN m ON m.query_id = x.vec_id AND m.vec_id = n.vec_id WHERE x.vec_id < 5) """ + top_sql("SELECT * FROM a", "euclidean"))
def sparse_topk_l2(spark, sf_dir):
    return search.sparse_top_k(sparse(spark, sf_dir), sparse_queries(spark, sf_dir), K, "euclidean")


@query(sparse_dot_sql(1 / 64, "fixedu8"))
def sparse_topk_fixedu8(spark, sf_dir):
    docs = sparse(spark, sf_dir, 1 / 64).withColumn("values", C.store_all(F.col("values"), "fixedu8"))
    return search.sparse_top_k(docs, sparse_queries(spark, sf_dir, scale=1 / 64), K, "dotproduct")


@query(sparse_dot_sql(1 / 64, "fixedu8"))
def packed_topk(spark, sf_dir):
    """The same from packed vectors."""
    docs = _stored_sparse(spark, sf_dir)
    mapping = packed.train(docs, sparse_dim(docs))
    return packed.top_k(packed.pack(docs, mapping), sparse_queries(spark, sf_dir, scale=1 / 64), mapping, K)


@query(f"WITH {sparse_sql(1 / 64, 'fixedu8')} SELECT vec_id, c AS component, v::DOUBLE AS value FROM p")
def packed_roundtrip(spark, sf_dir):
    docs = _stored_sparse(spark, sf_dir)
    mapping = packed.train(docs, sparse_dim(docs))
    back = packed.unpack(packed.pack(docs, mapping), mapping)
    return back.select("vec_id", F.explode(F.arrays_zip("components", "values")).alias("e")).select("vec_id", F.col("e.components").alias("component"), F.col("e.values").cast("double").alias("value"))


@query(f"WITH {sparse_sql()} SELECT count(DISTINCT vec_id) AS vectors, count(*) AS nnz, max(c) + 1 AS dim FROM p")
def sparse_nnz_dim(spark, sf_dir):
    return sparse(spark, sf_dir).agg(F.count("*").alias("vectors"), F.sum(F.size("components")).alias("nnz"), (F.max(F.array_max("components")) + 1).alias("dim"))


@query(f"WITH {sparse_sql()} SELECT vec_id, true AS sorted, false AS reversed FROM p GROUP BY vec_id HAVING count(*) > 1")
def sparse_validate_sorted(spark, sf_dir):
    s = sparse(spark, sf_dir).where(F.size("components") > 1)
    return s.select("vec_id", strictly_sorted(F.col("components")).alias("sorted"), strictly_sorted(F.reverse("components")).alias("reversed"))


@query(f"""WITH {sparse_sql()}, n AS (SELECT vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, (sum(n) OVER w - n)::BIGINT AS start, (sum(n) OVER w)::BIGINT AS "end" FROM n WINDOW w AS (ORDER BY vec_id)""")
def ranges_from_ids(spark, sf_dir):
    return VectorDataset(sparse(spark, sf_dir), Meta(Layout.SPARSE, 1 << 20)).ranges()


@query(f"""WITH {sparse_sql(1 / 64)}, q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id < 5),
s AS (SELECT query_id, vec_id AS doc_id, list_sum(list(q.v[c + 1]::DOUBLE * p.v::DOUBLE ORDER BY c)) AS score FROM q, p WHERE c < 64 GROUP BY 1, 2) SELECT * FROM s""")
def dense_sparse_dot(spark, sf_dir):
    """Dense queries with the components of sparse documents that are below their dimension."""
    q = dense_queries(spark, sf_dir, 5).withColumnRenamed("vector", "qv")
    d = sparse(spark, sf_dir, 1 / 64).withColumn("items", F.filter(F.arrays_zip("components", "values"), lambda x: x["components"] < 64)).where(F.size("items") > 0)
    d = d.select(F.col("vec_id").alias("doc_id"), F.col("items.components").alias("c"), F.col("items.values").alias("v"))
    return search.cross(q, d).select("query_id", "doc_id", D.dense_sparse_dot(F.col("qv"), F.col("c"), F.col("v")).alias("score"))


@query(f"""WITH {sparse_sql()}, n AS (SELECT vec_id, sum(v::DOUBLE * v::DOUBLE) AS n FROM p GROUP BY 1), pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.n AS na, b.n AS nb FROM n a JOIN n b ON b.vec_id = a.vec_id + 1),
m AS (SELECT x.vec_id AS a, y.vec_id AS b, sum(x.v::DOUBLE * y.v::DOUBLE) AS s FROM p x JOIN p y ON x.c = y.c AND y.vec_id = x.vec_id + 1 GROUP BY 1, 2)
SELECT a, b, coalesce(s, 0.0) AS product, na + nb - 2.0 * coalesce(s, 0.0) AS squared FROM pairs LEFT JOIN m USING (a, b)""")
def sparse_pair_distance(spark, sf_dir):
    s = sparse(spark, sf_dir)
    a, b = s.select(F.col("vec_id").alias("a"), F.col("components").alias("ac"), F.col("values").alias("av")), s.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("components").alias("bc"), F.col("values").alias("bv"))
    dot = D.sparse_dot(F.col("ac"), F.col("av"), F.col("bc"), F.col("bv"))
    both = a.join(b, "a").select("a", "b", dot.alias("product"), D.norm(F.col("av")).alias("an"), D.norm(F.col("bv")).alias("bn"))
    return both.select("a", "b", "product", D.sparse_l2(F.col("product"), F.col("an"), F.col("bn")).alias("squared"))


@query(f"WITH d AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: {stored_sql('x', 'bf16')}) AS v FROM embeddings), q AS (SELECT doc_id AS query_id, v FROM d WHERE doc_id BETWEEN 30 AND 39) " + top_sql(f"SELECT query_id, doc_id, {dot_sql('q.v', 'd.v')} AS score FROM q, d", "dotproduct"))
def stored_vectors_as_queries(spark, sf_dir):
    """Stored (bf16) vectors search their own collection."""
    data = VectorDataset(spread(dense(spark, sf_dir)), Meta(Layout.DENSE, 64)).convert("bf16")
    return data.search(search.vectors_as_queries(data.df, F.col("vec_id").between(30, 39)), K)


@query(f"WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), d AS (SELECT vec_id AS doc_id, embedding AS v FROM embeddings UNION ALL SELECT vec_id + n, embedding FROM embeddings, n WHERE vec_id < 50), q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id < 20) " + top_sql(f"SELECT query_id, doc_id, {l2_sql('q.v', 'd.v')} AS score FROM q, d", "euclidean"))
def append_then_search(spark, sf_dir):
    """A collection with copies of its first 50 vectors behind it: ties go to the lower id."""
    d = dense(spark, sf_dir)
    data = VectorDataset(spread(d), Meta(Layout.DENSE, 64, metric=Metric.L2)).append(d.where("vec_id < 50"))
    return data.search(dense_queries(spark, sf_dir), K)


@query("SELECT vec_id, start, \"end\" FROM (SELECT vec_id, vec_id * 64 AS start, vec_id * 64 + 64 AS \"end\" FROM embeddings) WHERE start = 64 * 17")
def vector_by_range(spark, sf_dir):
    data = VectorDataset(dense(spark, sf_dir), Meta(Layout.DENSE, 64))
    return data.ranges().where(F.col("vec_id") == data.id_of_range(64 * 17, 64 * 18))


@query("SELECT (vec_id // 4) AS doc_id, (4 * 64 * (vec_id // 4)) AS start, 4 * 64 * (vec_id // 4) + 64 * count(*) AS \"end\" FROM embeddings GROUP BY vec_id // 4")
def multivec_ranges(spark, sf_dir):
    return VectorDataset(tokens(spark, sf_dir), Meta(Layout.MULTIVEC, 64)).ranges()


# k-means
CLUSTER_SQL = f"""a AS (SELECT e.vec_id, c.vec_id AS cluster, {l2_sql('e.embedding', 'c.embedding')} AS distance FROM embeddings e, embeddings c WHERE c.vec_id < 8
QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY distance, c.vec_id) = 1)"""


def _clusters(spark, sf_dir):
    d = spread(dense(spark, sf_dir))
    centroids = d.where(F.col("vec_id") < 8).select(F.col("vec_id").alias("cluster"), F.col("vector").alias("centroid"))
    return d, kmeans.assign(d, centroids)


@query(f"WITH {CLUSTER_SQL} SELECT vec_id, cluster, distance FROM a")
def kmeans_assign(spark, sf_dir):
    return _clusters(spark, sf_dir)[1]


def update_sql(w: str) -> str:
    return f"""WITH {CLUSTER_SQL}, x AS (SELECT cluster, {w} AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM a JOIN embeddings USING (vec_id))
SELECT cluster, dim::INTEGER AS dim, round(sum(w * x) / sum(w), 9) AS mean, sum(w)::DOUBLE AS weight FROM x GROUP BY 1, 2"""


@query(update_sql("1.0::DOUBLE"))
def kmeans_update(spark, sf_dir):
    d, a = _clusters(spark, sf_dir)
    return kmeans.update(d, a).withColumn("mean", F.round("mean", 9))


@query(update_sql("(1 + vec_id % 3)::DOUBLE"))
def kmeans_weighted_update(spark, sf_dir):
    d, a = _clusters(spark, sf_dir)
    return kmeans.update(d.withColumn("w", (1 + F.col("vec_id") % 3).cast("double")), a, "w").withColumn("mean", F.round("mean", 9))


@query(f"""WITH {CLUSTER_SQL}, h AS (SELECT cluster, count(*)::DOUBLE AS h, sum(distance) AS d FROM a GROUP BY 1)
SELECT round(sum(d), 6) AS objective, round(count(*) * sum(h * h) / (sum(h) * sum(h)), 9) AS imbalance FROM h""")
def kmeans_objective_imbalance(spark, sf_dir):
    return kmeans.objective(_clusters(spark, sf_dir)[1]).select(F.round("objective", 6).alias("objective"), F.round("imbalance", 9).alias("imbalance"))


def lloyd_sql(k: int, rounds: int, vector: str = "embedding", source: str = "embeddings") -> str:
    """CTEs c0 (the points of the least md5), then a1, c1, a2, c2, ...: assignments to the last centroids and their means."""
    out = [f"c0 AS (SELECT row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS cluster, list_transform({vector}, lambda x: x::DOUBLE) AS c FROM {source} QUALIFY cluster < {k})"]
    for i in range(1, rounds + 1):
        out.append(f"a{i} AS (SELECT e.vec_id, b.cluster FROM {source} e, c{i - 1} b QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY {l2_sql('e.' + vector, 'b.c')}, b.cluster) = 1)")
        out.append(f"m{i} AS (SELECT cluster, dim, avg(x) AS x FROM (SELECT cluster, unnest({vector})::DOUBLE AS x, generate_subscripts({vector}, 1) AS dim FROM a{i} JOIN {source} USING (vec_id)) GROUP BY 1, 2)")
        out.append(f"c{i} AS (SELECT cluster, list(x ORDER BY dim) AS c FROM m{i} GROUP BY 1)")
    return ", ".join(out)


@query(f"""WITH {lloyd_sql(10, 4)}, f AS (SELECT cluster, list_transform(c, lambda x: x::FLOAT) AS c FROM c4),
a AS (SELECT e.vec_id, f.cluster, {l2_sql('e.embedding', 'f.c')} AS d FROM embeddings e, f QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY d, f.cluster) = 1)
SELECT cluster::INTEGER AS cluster, count(*) AS size, round(sum(d), 6) AS loss FROM a GROUP BY 1""")
def kmeans_train(spark, sf_dir):
    """cluster, size, loss after four iterations from md5-chosen points."""
    d = spread(dense(spark, sf_dir))
    c = kmeans.KMeans(n_iter=4).train(d, 10)
    return kmeans.assign(d, kmeans.as_frame(spark, c)).groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.sum("distance"), 6).alias("loss"))


# product quantization
def _part(v: str, j: str) -> str:
    return f"{v}[{j} * 8 + 1 : {j} * 8 + 8]"


BOOK_SQL = f"""book AS (SELECT j, vec_id AS code, {_part('embedding', 'j')} AS c FROM embeddings, range(8) r(j) WHERE vec_id < 256),
codes AS (SELECT e.vec_id, b.j, b.code, b.c FROM embeddings e JOIN book b ON true
QUALIFY row_number() OVER (PARTITION BY e.vec_id, b.j ORDER BY {l2_sql(_part('e.embedding', 'b.j'), 'b.c')}, b.code) = 1)"""


@query(f"WITH {BOOK_SQL} SELECT vec_id, j::INTEGER AS part, code::INTEGER AS code FROM codes")
def pq_encode(spark, sf_dir):
    e = fixed_pq(spark, sf_dir).encode(spread(dense(spark, sf_dir)))
    return e.select("vec_id", F.posexplode("codes").alias("part", "code")).withColumn("code", F.col("code").cast("int"))


@query(f"WITH {BOOK_SQL}, x AS (SELECT vec_id, j, unnest(c)::DOUBLE AS value, generate_subscripts(c, 1) AS i FROM codes) SELECT vec_id, (j * 8 + i - 1)::INTEGER AS dim, value FROM x")
def pq_decode(spark, sf_dir):
    pq = fixed_pq(spark, sf_dir)
    back = pq.decode(pq.encode(spread(dense(spark, sf_dir))))
    return back.select("vec_id", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


def _pq_query(name: str, metric: str):
    fn = dot_sql if metric == "dotproduct" else l2_sql

    def run(spark, sf_dir):
        pq = fixed_pq(spark, sf_dir, metric)
        return pq.top_k(pq.encode(spread(dense(spark, sf_dir))), dense_queries(spark, sf_dir), K)

    run.__name__ = name
    query(f"WITH {BOOK_SQL}, q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id < 20) " + top_sql(f"SELECT query_id, vec_id AS doc_id, list_sum(list({fn(_part('q.v', 'j'), 'c')} ORDER BY j)) AS score FROM q, codes GROUP BY 1, 2", metric))(run)


_pq_query("pq_topk_dot", "dotproduct")
_pq_query("pq_topk_l2", "euclidean")


FIT_SQL = f"""parts AS (SELECT vec_id, j, {_part('embedding', 'j')} AS p FROM embeddings, range(8) r(j)),
i AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS code FROM embeddings QUALIFY code < 256),
start AS (SELECT j, code, p AS c FROM i JOIN parts USING (vec_id)),
near AS (SELECT x.vec_id, x.j, s.code FROM parts x JOIN start s USING (j) QUALIFY row_number() OVER (PARTITION BY x.vec_id, x.j ORDER BY {l2_sql('x.p', 's.c')}, s.code) = 1),
sums AS (SELECT j, code, dim, avg(x) AS x FROM (SELECT j, code, unnest(p)::DOUBLE AS x, generate_subscripts(p, 1) AS dim FROM near JOIN parts USING (vec_id, j)) GROUP BY 1, 2, 3),
book AS (SELECT j, code, list(x::FLOAT ORDER BY dim) AS c FROM sums GROUP BY 1, 2),
codes AS (SELECT x.vec_id, x.j, b.code, b.c FROM parts x JOIN book b USING (j) QUALIFY row_number() OVER (PARTITION BY x.vec_id, x.j ORDER BY {l2_sql('x.p', 'b.c')}, b.code) = 1)"""


@query(f"WITH {FIT_SQL}, q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id < 20) " + top_sql(f"SELECT query_id, vec_id AS doc_id, round(list_sum(list({dot_sql(_part('q.v', 'j'), 'c')} ORDER BY j)), 6) AS score FROM q, codes GROUP BY 1, 2", "dotproduct").replace("SELECT query_id, doc_id, rank, score", "SELECT query_id, doc_id, score", 1))
def pq_fit_topk(spark, sf_dir):
    """A collection converted to a codebook of its own (one iteration, in which no cluster is empty)."""
    data = VectorDataset(spread(dense(spark, sf_dir)), Meta(Layout.DENSE, 64)).convert("pq", m=8, n_iter=1)
    return data.search(dense_queries(spark, sf_dir), K).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _pq_data(spark, sf_dir) -> EncodedDataset:
    return EncodedDataset.of(VectorDataset(spread(dense(spark, sf_dir)), Meta(Layout.DENSE, 64)), fixed_pq(spark, sf_dir))


PQ_DECODED = f"{BOOK_SQL}, d AS (SELECT vec_id AS doc_id, flatten(list(c ORDER BY j)) AS v FROM codes GROUP BY 1)"


@query(f"WITH {PQ_DECODED}, q AS (SELECT doc_id AS query_id, v FROM d WHERE doc_id BETWEEN 300 AND 309) " + top_sql(f"SELECT query_id, doc_id, round({dot_sql('q.v', 'd.v')}, 9) AS score FROM q, d", "dotproduct"))
def pq_vectors_as_queries(spark, sf_dir):
    """Coded vectors search their own collection."""
    data = _pq_data(spark, sf_dir)
    return _rounded(data.search(data.as_queries(F.col("vec_id").between(300, 309)), K))


@query(f"WITH {BOOK_SQL} SELECT vec_id, j::INTEGER AS part, code::INTEGER AS code FROM codes")
def pq_from_codebook_rows(spark, sf_dir):
    """The codebook as rows and back, then the collection saved and loaded."""
    pq = ProductQuantizer.from_frame(fixed_pq(spark, sf_dir).to_frame(spark))
    path = f"{store.shared_folder(spark)}/pq"
    store.save(EncodedDataset.of(VectorDataset(dense(spark, sf_dir), Meta(Layout.DENSE, 64)), pq), path)
    return store.load(spark, path).df.select("vec_id", F.posexplode("codes").alias("part", "code")).withColumn("code", F.col("code").cast("int"))


# several vectors a document
TOKEN_SQL = "t AS (SELECT vec_id // 4 AS doc_id, vec_id AS token, embedding AS v FROM embeddings), q AS (SELECT doc_id AS query_id, token AS q_token, v FROM t WHERE doc_id < 5)"


def maxsim_sql(pairs: str, more: str = "") -> str:
    return f"WITH {more}{TOKEN_SQL}, s AS ({pairs}), b AS (SELECT query_id, doc_id, q_token, max(s) AS s FROM s GROUP BY 1, 2, 3) " + top_sql("SELECT query_id, doc_id, round(list_sum(list(s ORDER BY q_token)), 9) AS score FROM b GROUP BY 1, 2", "dotproduct")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 9))


@query(maxsim_sql(f"SELECT query_id, doc_id, q_token, {dot_sql('q.v', 't.v')} AS s FROM q, t"))
def maxsim_topk(spark, sf_dir):
    return _rounded(multivec.maxsim_top_k(spread(tokens(spark, sf_dir)), token_queries(spark, sf_dir), K))


@query(maxsim_sql(f"SELECT query_id, doc_id, q_token, {dot_sql('q.v', 't.v')} AS s FROM q, t"))
def maxsim_topk_expr(spark, sf_dir):
    """The same by expressions alone."""
    q, d = token_queries(spark, sf_dir).withColumnRenamed("tokens", "qt"), spread(tokens(spark, sf_dir))
    return _rounded(search.top_k_by(d, q, D.maxsim(F.col("qt"), F.col("tokens")), K, "dotproduct"))


@query(maxsim_sql(f"SELECT query_id, doc_id, q_token, list_sum(list({dot_sql(_part('q.v', 'j'), 'c')} ORDER BY j)) AS s FROM q, t JOIN codes ON codes.vec_id = t.token GROUP BY query_id, doc_id, q_token, token", BOOK_SQL + ", "))
def maxsim_pq_topk(spark, sf_dir):
    tq = multivec.TokenQuantizer(fixed_pq(spark, sf_dir))
    return _rounded(tq.top_k(tq.encode(spread(tokens(spark, sf_dir))), token_queries(spark, sf_dir), K))


TWO_SQL = f"""near AS (SELECT e.vec_id, c.embedding AS coarse, list_transform(list_zip(e.embedding, c.embedding), lambda z: (z[1] - z[2])::FLOAT) AS rest FROM embeddings e, embeddings c WHERE c.vec_id < 16
QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY {l2_sql('e.embedding', 'c.embedding')}, c.vec_id) = 1),
book AS (SELECT j, vec_id AS code, {_part('embedding', 'j')} AS c FROM embeddings, range(8) r(j) WHERE vec_id < 256),
codes AS (SELECT n.vec_id, n.coarse, b.j, b.c FROM near n, book b QUALIFY row_number() OVER (PARTITION BY n.vec_id, b.j ORDER BY {l2_sql(_part('n.rest', 'b.j'), 'b.c')}, b.code) = 1), """


@query(maxsim_sql(f"SELECT query_id, doc_id, q_token, any_value({dot_sql('q.v', 'coarse')}) + list_sum(list({dot_sql(_part('q.v', 'j'), 'c')} ORDER BY j)) AS s FROM q, t JOIN codes ON codes.vec_id = t.token GROUP BY query_id, doc_id, q_token, token", TWO_SQL))
def maxsim_two_level_topk(spark, sf_dir):
    tl = multivec.TwoLevelQuantizer(first_rows(spark, sf_dir, 16), fixed_pq(spark, sf_dir))
    return _rounded(tl.top_k(tl.encode(spread(tokens(spark, sf_dir))), token_queries(spark, sf_dir), K))


NORMS_SQL = f"""rests AS (SELECT e.vec_id, c.vec_id AS coarse_id, c.embedding AS coarse, list_transform(list_zip(e.embedding, c.embedding), lambda z: (z[1] - z[2])::FLOAT) AS raw FROM embeddings e, embeddings c WHERE c.vec_id < 16
QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY {l2_sql('e.embedding', 'c.embedding')}, c.vec_id) = 1),
lengths AS (SELECT *, greatest(sqrt({dot_sql('raw', 'raw')}), 1e-12)::FLOAT AS length FROM rests),
near AS (SELECT vec_id, coarse_id, coarse, {stored_sql('length', 'f16')}::DOUBLE AS norm, list_transform(list_zip(raw, list_transform(raw, lambda x: length)), lambda z: (z[1]::DOUBLE / z[2]::DOUBLE)::FLOAT) AS rest FROM lengths),
book AS (SELECT j, vec_id AS code, {_part('embedding', 'j')} AS c FROM embeddings, range(8) r(j) WHERE vec_id < 256),
codes AS (SELECT n.vec_id, n.coarse_id, n.coarse, n.norm, b.j, b.code, b.c FROM near n, book b QUALIFY row_number() OVER (PARTITION BY n.vec_id, b.j ORDER BY {l2_sql(_part('n.rest', 'b.j'), 'b.c')}, b.code) = 1), """


def _two_level(spark, sf_dir, norms: bool) -> multivec.TwoLevelQuantizer:
    return multivec.TwoLevelQuantizer(first_rows(spark, sf_dir, 16), fixed_pq(spark, sf_dir), norms)


@query(maxsim_sql(f"SELECT query_id, doc_id, q_token, any_value({dot_sql('q.v', 'coarse')}) + any_value(norm) * list_sum(list({dot_sql(_part('q.v', 'j'), 'c')} ORDER BY j)) AS s FROM q, t JOIN codes ON codes.vec_id = t.token GROUP BY query_id, doc_id, q_token, token", NORMS_SQL))
def maxsim_two_level_norms_topk(spark, sf_dir):
    tl = _two_level(spark, sf_dir, True)
    return _rounded(tl.top_k(tl.encode(spread(tokens(spark, sf_dir))), token_queries(spark, sf_dir), K))


@query(f"WITH {NORMS_SQL.rstrip(', ')} SELECT vec_id // 4 AS doc_id, (vec_id % 4)::INTEGER AS token, coarse_id::INTEGER AS coarse, j::INTEGER AS part, code::INTEGER AS code, norm FROM codes")
def two_level_encode(spark, sf_dir):
    """The codes of all tokens, with the nearest centroids handed in as ids."""
    tl = _two_level(spark, sf_dir, True)
    docs = spread(tokens(spark, sf_dir))
    ids = tl.encode(docs).select("doc_id", F.col("tokens.coarse").alias("coarse"))
    e = tl.encode_with_ids(docs.join(ids, "doc_id")).select("doc_id", F.posexplode("tokens").alias("token", "t"))
    return e.select("doc_id", "token", F.col("t.coarse").alias("coarse"), F.col("t.norm").cast("double").alias("norm"), F.posexplode("t.codes").alias("part", "code")).withColumn("code", F.col("code").cast("int"))


@query(f"WITH {NORMS_SQL.rstrip(', ')}, d AS (SELECT vec_id, any_value(coarse) AS coarse, any_value(norm) AS norm, flatten(list(c ORDER BY j)) AS v FROM codes GROUP BY 1), x AS (SELECT vec_id, norm, unnest(coarse)::FLOAT AS a, unnest(v)::DOUBLE AS b, generate_subscripts(v, 1) - 1 AS dim FROM d) SELECT vec_id // 4 AS doc_id, (vec_id % 4)::INTEGER AS token, dim::INTEGER AS dim, (a + (norm * b)::FLOAT)::FLOAT::DOUBLE AS value FROM x")
def two_level_decode(spark, sf_dir):
    tl = _two_level(spark, sf_dir, True)
    path = f"{store.shared_folder(spark)}/two"
    store.save(EncodedDataset.of(VectorDataset(spread(tokens(spark, sf_dir)), Meta(Layout.MULTIVEC, 64)), tl), path)
    back = store.load(spark, path).decoded().df.select("doc_id", F.posexplode("tokens").alias("token", "v"))
    return back.select("doc_id", "token", F.posexplode("v").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {BOOK_SQL}, x AS (SELECT vec_id, j, unnest(c)::DOUBLE AS value, generate_subscripts(c, 1) AS i FROM codes) SELECT vec_id // 4 AS doc_id, (vec_id % 4)::INTEGER AS token, (j * 8 + i - 1)::INTEGER AS dim, value FROM x")
def multivec_pq_decode(spark, sf_dir):
    data = EncodedDataset.of(VectorDataset(spread(tokens(spark, sf_dir)), Meta(Layout.MULTIVEC, 64)), multivec.TokenQuantizer(fixed_pq(spark, sf_dir)))
    back = data.decoded().df.select("doc_id", F.posexplode("tokens").alias("token", "v"))
    return back.select("doc_id", "token", F.posexplode("v").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


@query(maxsim_sql(f"SELECT query_id, doc_id, q_token, {dot_sql('q.v', 't.v')} AS s FROM q, t").replace("WHERE doc_id < 5", "WHERE doc_id BETWEEN 50 AND 54"))
def maxsim_stored_as_queries(spark, sf_dir):
    data = VectorDataset(spread(tokens(spark, sf_dir)), Meta(Layout.MULTIVEC, 64)).checked()
    return _rounded(data.search(data.as_queries(F.col("doc_id").between(50, 54)), K))


@query(f"SELECT vec_id // 4 AS doc_id, (vec_id % 4)::INTEGER AS token, dim::INTEGER AS dim, {stored_sql('x', 'f16')}::DOUBLE AS value FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::FLOAT AS x FROM embeddings)")
def multivec_convert_f16(spark, sf_dir):
    """All tokens in order, stored as half-precision numbers."""
    data = VectorDataset(tokens(spark, sf_dir), Meta(Layout.MULTIVEC, 64)).convert("f16").freeze()
    return data.df.select("doc_id", F.posexplode("tokens").alias("token", "v")).select("doc_id", "token", F.posexplode("v").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


# sources, sinks and access
VALUES_SQL = "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings"


def _values(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


def _put(path: str, raw: bytes) -> str:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    with system.open_output_stream(place) as f:
        f.write(raw)
    return path


def _npy(spark, sf_dir, name: str, most: int = 1 << 62) -> str:
    x = matrix(dense(spark, sf_dir).where(F.col("vec_id") < most).orderBy("vec_id").toArrow().column("vector"))
    out = io.BytesIO()
    np.save(out, x)
    return _put(f"{store.shared_folder(spark)}/{name}.npy", out.getvalue())


def _sparse_file(spark, sf_dir) -> str:
    """The sparse vectors as a folder of files that tasks write; their ids there are their places in the order of vec_id."""
    path = f"{store.shared_folder(spark)}/rows"
    binary.write_sparse(sparse(spark, sf_dir, ordered=True), path)
    return path


def placed_sql(where: str = "true") -> str:
    return f"WITH {sparse_sql()}, n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM (SELECT DISTINCT vec_id FROM p)) SELECT n AS vec_id, c AS component, v::DOUBLE AS value FROM p JOIN n USING (vec_id) WHERE {where}"


def _components(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.explode(F.arrays_zip("components", "values")).alias("e")).select("vec_id", F.col("e.components").alias("component"), F.col("e.values").cast("double").alias("value"))


@query(VALUES_SQL)
def npy_read(spark, sf_dir):
    binary.register(spark)
    return _values(spark.read.format("npy").option("rows", 100).load(_npy(spark, sf_dir, "all")))


@query(placed_sql())
def sparse_file_read(spark, sf_dir):
    return _components(binary.read_sparse(spark, _sparse_file(spark, sf_dir)))


@query(placed_sql("n < 7"))
def sparse_file_read_limit(spark, sf_dir):
    return _components(binary.read_sparse(spark, _sparse_file(spark, sf_dir), limit=7))


@query(f"SELECT * FROM ({VALUES_SQL}) WHERE vec_id < 50")
def dense_from_buffer(spark, sf_dir):
    return _values(binary.from_dense_buffer(spark, first_rows(spark, sf_dir, 50).ravel(), 50))


@query(f"SELECT vec_id // 5 AS doc_id, (vec_id % 5)::INTEGER AS token, dim, value FROM ({VALUES_SQL}) WHERE vec_id < 50")
def tokens_from_buffer(spark, sf_dir):
    df = binary.from_token_buffer(spark, first_rows(spark, sf_dir, 50).ravel(), np.arange(11) * 5 * 64, 64)
    return df.select("doc_id", F.posexplode("tokens").alias("token", "v")).select("doc_id", "token", F.posexplode("v").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


@query(f"SELECT vec_id, dim, {stored_sql('value', 'bf16')}::DOUBLE AS value FROM ({VALUES_SQL})")
def saved_and_loaded(spark, sf_dir):
    path = f"{store.shared_folder(spark)}/dense"
    store.save(VectorDataset(dense(spark, sf_dir), Meta(Layout.DENSE, 64)).convert("bf16"), path)
    data = store.load(spark, path)
    assert data.meta.codec is Codec.BF16
    return _values(data.checked().df)


@query(f"SELECT query_id, doc_id, rank, score::FLOAT::DOUBLE AS score FROM ({dense_sql('dotproduct', 'f16')})")
def ground_truth_file(spark, sf_dir):
    """The command line over npy files, its file of results read again."""
    folder = store.shared_folder(spark)
    a = cli.parser().parse_args(["-i", _npy(spark, sf_dir, "docs"), "-q", _npy(spark, sf_dir, "queries", 20), "-o", f"{folder}/out", "-d", "dotproduct", "-v", "f16"])
    store.write_ground_truth(cli.ground_truth(spark, a), a.output)
    return store.read_ground_truth(spark, a.output).withColumn("score", F.col("score").cast("double"))


@query(f"SELECT query_id, doc_id, rank, score::FLOAT::DOUBLE AS score FROM (WITH {sparse_sql()}, n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM (SELECT DISTINCT vec_id FROM p)), m AS (SELECT a.n AS query_id, b.n AS doc_id, sum(x.v::DOUBLE * y.v::DOUBLE) AS s FROM p x JOIN p y USING (c) JOIN n a ON a.vec_id = x.vec_id JOIN n b ON b.vec_id = y.vec_id GROUP BY 1, 2), a AS (SELECT a.n AS query_id, b.n AS doc_id, coalesce(s, 0.0) AS score FROM n a CROSS JOIN n b LEFT JOIN m ON m.query_id = a.n AND m.doc_id = b.n) " + top_sql("SELECT * FROM a", "dotproduct") + ")")
def ground_truth_file_sparse(spark, sf_dir):
    """The same for a sparse file that searches itself."""
    path, folder = _sparse_file(spark, sf_dir), store.shared_folder(spark)
    a = cli.parser().parse_args(["-i", path, "-q", path, "-o", f"{folder}/out", "-d", "dotproduct", "--dataset-type", "sparse"])
    store.write_ground_truth(cli.ground_truth(spark, a), a.output)
    return store.read_ground_truth(spark, a.output).withColumn("score", F.col("score").cast("double"))


@query(f"SELECT query_id, doc_id, sqrt(score) AS distance FROM ({dense_sql('euclidean', k=1)})")
def dense_nearest_euclidean(spark, sf_dir):
    """Metrics are names: the same rows relabelled, then their nearest by true distance."""
    data = VectorDataset(spread(dense(spark, sf_dir)), Meta(Layout.DENSE, 64)).relabel(metric="euclidean", codec="f32")
    return data.nearest(dense_queries(spark, sf_dir)).select("query_id", "doc_id", D.euclidean(F.col("score")).alias("distance"))


@query(f"""WITH {sparse_sql(1 / 64)}, q AS (SELECT vec_id AS query_id, embedding AS v, {dot_sql('embedding', 'embedding')} AS qn FROM embeddings WHERE vec_id < 5)
SELECT query_id, vec_id AS doc_id, round(any_value(qn) + list_sum(list(p.v::DOUBLE * p.v::DOUBLE ORDER BY c)) - 2.0 * list_sum(list(q.v[c + 1]::DOUBLE * p.v::DOUBLE ORDER BY c)), 9) AS score FROM q, p WHERE c < 64 GROUP BY 1, 2""")
def dense_sparse_l2(spark, sf_dir):
    q = dense_queries(spark, sf_dir, 5).withColumnRenamed("vector", "qv")
    d = sparse(spark, sf_dir, 1 / 64).withColumn("items", F.filter(F.arrays_zip("components", "values"), lambda x: x["components"] < 64)).where(F.size("items") > 0)
    d = d.select(F.col("vec_id").alias("doc_id"), F.col("items.components").alias("c"), F.col("items.values").alias("v"))
    dot = D.dense_sparse_dot(F.col("qv"), F.col("c"), F.col("v"))
    return search.cross(q, d).select("query_id", "doc_id", F.round(D.not_nan(D.sparse_l2(dot, D.norm(F.col("qv")), D.norm(F.col("v")))), 9).alias("score"))


@query(f"SELECT * FROM ({VALUES_SQL}) WHERE vec_id IN (17, 23)")
def vectors_by_id_and_range(spark, sf_dir):
    data = VectorDataset(dense(spark, sf_dir), Meta(Layout.DENSE, 64))
    return _values(data.get(17).unionByName(data.get_by_range(23 * 64, 24 * 64)))


@query("SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC)::INTEGER AS place FROM embeddings QUALIFY place <= 30")
def scan_backwards(spark, sf_dir):
    rows = VectorDataset(dense(spark, sf_dir), Meta(Layout.DENSE, 64)).scan(descending=True).select("vec_id").limit(30)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("vec_id"))))


@query(sparse_dot_sql())
def sparse_topk_dot_join(spark, sf_dir):
    """The same by a join on components."""
    return search.sparse_top_k(sparse(spark, sf_dir), sparse_queries(spark, sf_dir), K, "dotproduct", "join")


@query(sparse_dot_sql(1 / 64, "fixedu8").replace("c, raw AS v FROM p WHERE vec_id < 5", "c, v FROM p WHERE vec_id BETWEEN 10 AND 14"))
def packed_vectors_as_queries(spark, sf_dir):
    """A packed collection, saved and loaded, whose own vectors search it; components that occur together have close numbers."""
    docs = _stored_sparse(spark, sf_dir)
    path = f"{store.shared_folder(spark)}/packed"
    store.save(VectorDataset(docs, Meta(Layout.SPARSE, sparse_dim(docs))).convert("packed", order="cooccurrence"), path)
    data = store.load(spark, path)
    return data.search(data.as_queries(F.col("vec_id").between(10, 14)), K)


@query(f"SELECT count(*) AS vectors, (count(*) * 8)::BIGINT AS nnz, (16 + 4 * 256 * 64 + 16 + 8 * count(*))::BIGINT AS pq_bytes, (16 + 8 * (8 + 16 + 4 * 256 * 8) + 16 + 8 * (count(DISTINCT vec_id // 4) + 1) + 16 + 8 * count(*))::BIGINT AS token_pq_bytes, (16 + 8 + 16 + 4 * 16 * 64 + 8 * (8 + 16 + 4 * 256 * 8) + 16 + 8 * (count(DISTINCT vec_id // 4) + 1) + 16 + 14 * count(*))::BIGINT AS two_level_bytes FROM embeddings")
def space_usage_encoded(spark, sf_dir):
    """Bytes of coded collections with their encoders."""
    pq, many = _pq_data(spark, sf_dir), VectorDataset(tokens(spark, sf_dir), Meta(Layout.MULTIVEC, 64))
    token_pq, two = EncodedDataset.of(many, multivec.TokenQuantizer(pq.encoder)), EncodedDataset.of(many, _two_level(spark, sf_dir, True))
    row = (len(pq), pq.nnz(), pq.space_bytes(), token_pq.space_bytes(), two.space_bytes())
    return spark.createDataFrame([row], "vectors long, nnz long, pq_bytes long, token_pq_bytes long, two_level_bytes long")


# two stages
def _stages(spark, sf_dir, **options):
    d = spread(dense(spark, sf_dir))
    first = VectorDataset(d, Meta(Layout.DENSE, 64)).convert(Codec.BF16).search(dense_queries(spark, sf_dir), 50)
    docs, q = d.select(F.col("vec_id").alias("doc_id"), F.col("vector").alias("dv")), dense_queries(spark, sf_dir).withColumnRenamed("vector", "qv")
    return rerank.two_stage(first, q, docs, D.dot(F.col("qv"), F.col("dv")), 50, K, **options)


def rerank_sql(keep: str) -> str:
    v = f"list_transform(d.v, lambda x: {stored_sql('x', 'bf16')})"
    return f"""WITH {DENSE_SQL}, e AS (SELECT doc_id, {v} AS b, v FROM d), s AS (SELECT query_id, doc_id, {dot_sql('q.v', 'e.b')} AS first, {dot_sql('q.v', 'e.v')} AS score FROM q, e),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, doc_id) AS n FROM s QUALIFY n <= 50),
k AS (SELECT *, max(CASE WHEN n = {K} THEN first END) OVER (PARTITION BY query_id) AS t FROM c)
SELECT query_id, doc_id, rank, score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n)::INTEGER AS rank FROM k WHERE {keep}) r WHERE rank <= {K}"""


@query(rerank_sql("true"))
def rerank_plain(spark, sf_dir):
    return _stages(spark, sf_dir)


@query(rerank_sql("first >= t * (1.0 - 0.05::DOUBLE)"))
def rerank_alpha(spark, sf_dir):
    return _stages(spark, sf_dir, alpha=0.05)


@query(f"""WITH RECURSIVE {DENSE_SQL}, e AS (SELECT doc_id, list_transform(d.v, lambda x: {stored_sql('x', 'bf16')}) AS b, v FROM d),
c AS (SELECT query_id, doc_id, {dot_sql('q.v', 'e.v')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {dot_sql('q.v', 'e.b')} DESC, doc_id) AS n FROM q, e QUALIFY n <= 50),
i AS (SELECT query_id, list_sort(list({{'s': score, 'r': -n, 'd': doc_id}})) AS kept FROM c WHERE n <= {K} GROUP BY 1),
w AS (SELECT query_id, {K}::BIGINT AS pos, kept, 0 AS stalls FROM i
 UNION ALL SELECT w.query_id, w.pos + 1, CASE WHEN c.score > w.kept[1].s THEN list_sort(list_append(w.kept[2:], {{'s': c.score, 'r': -c.n, 'd': c.doc_id}})) ELSE w.kept END, CASE WHEN c.score > w.kept[1].s THEN 0 ELSE w.stalls + 1 END
 FROM w JOIN c ON c.query_id = w.query_id AND c.n = w.pos + 1 WHERE w.stalls < 3),
f AS (SELECT query_id, unnest(kept) AS x FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) = 1)
SELECT query_id, x.d AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY x.s DESC, x.r DESC)::INTEGER AS rank, x.s AS score FROM f""")
def rerank_early_exit(spark, sf_dir):
    return _stages(spark, sf_dir, beta=3)


@query(rerank_sql("true"))
def rerank_index(spark, sf_dir):
    """The same by an index of both stages."""
    data = VectorDataset(spread(dense(spark, sf_dir)), Meta(Layout.DENSE, 64))
    index = rerank.RerankIndex(ExhaustiveIndex.build(data, "bf16"), data)
    return index.search(dense_queries(spark, sf_dir), dense_queries(spark, sf_dir), 50, K)


# evaluation and space
@query(f"WITH x AS ({dense_sql('dotproduct')}), y AS ({dense_sql('dotproduct', 'fixedu8')}) SELECT count(y.doc_id)::DOUBLE / count(*) AS recall FROM x LEFT JOIN y USING (query_id, doc_id)")
def recall_at_k(spark, sf_dir):
    data = VectorDataset(spread(dense(spark, sf_dir)), Meta(Layout.DENSE, 64))
    q = dense_queries(spark, sf_dir)
    return evaluate.recall(data.search(q, K), data.convert("fixedu8").search(q, K))


@query(f"WITH {sparse_sql()}, l AS (SELECT vec_id, list(c) AS c FROM p WHERE vec_id < 20 GROUP BY 1) SELECT a.vec_id AS a, b.vec_id AS b, len(list_filter(b.c, lambda x: list_contains(a.c, x)))::INTEGER AS common FROM l a JOIN l b ON a.vec_id < b.vec_id")
def intersection_size(spark, sf_dir):
    s = sparse(spark, sf_dir).where(F.col("vec_id") < 20)
    a, b = s.select(F.col("vec_id").alias("a"), F.col("components").alias("ac")), s.select(F.col("vec_id").alias("b"), F.col("components").alias("bc"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", evaluate.intersection(F.col("ac"), F.col("bc")).alias("common"))


@query(f"""WITH {sparse_sql()} SELECT 'dense' AS kind, (16 + count(*) * 64 * 4)::BIGINT AS bytes FROM embeddings
UNION ALL SELECT 'sparse', (16 + 8 * (count(DISTINCT vec_id) + 1) + 16 + count(*) * CASE WHEN max(c) < 65536 THEN 2 ELSE 4 END + 16 + count(*) * 4)::BIGINT FROM p
UNION ALL SELECT 'multivec', (16 + 8 * (count(DISTINCT vec_id // 4) + 1) + 16 + count(*) * 64 * 4)::BIGINT FROM embeddings""")
def space_usage(spark, sf_dir):
    s = sparse(spark, sf_dir)
    sets = (VectorDataset(dense(spark, sf_dir), Meta(Layout.DENSE, 64)), VectorDataset(s, Meta(Layout.SPARSE, sparse_dim(s))), VectorDataset(tokens(spark, sf_dir), Meta(Layout.MULTIVEC, 64)))
    return spark.createDataFrame([(d.meta.layout.value, d.space_bytes()) for d in sets], "kind string, bytes long")


def _codec_query(codec: str):
    def run(spark, sf_dir):
        x = dense(spark, sf_dir).select("vec_id", F.posexplode("vector").alias("dim", "x"))
        return x.select("vec_id", "dim", C.store(F.col("x") * F.lit(3.7), codec).cast("double").alias("value"))

    run.__name__ = f"codec_{codec}"
    query(f"WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::FLOAT * 3.7::DOUBLE AS x FROM embeddings) SELECT vec_id, dim::INTEGER AS dim, {stored_sql('x', codec)}::DOUBLE AS value FROM x")(run)


for _codec in CODECS:
    _codec_query(_codec)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
