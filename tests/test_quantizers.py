"""k-means, product quantization, several vectors a document, packed vectors, reranking, files, the command line."""

import struct

import numpy as np

import pytest
from pyspark.sql import functions as F

from sparkvec import cli
from sparkvec.functions import codec as C

from sparkvec.operators import common, evaluate, kmeans, multivec, packed, pq, rerank, search
from sparkvec.operators.dataset import ExhaustiveIndex, VectorDataset
from sparkvec.operators.encoded import EncodedDataset
from sparkvec.plans import queries
from sparkvec.plans.queries import QUERIES
from sparkvec.schema import Layout, Meta, Metric
from sparkvec.sources import binary, store


def dense(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, vector array<float>")


def test_kmeans_steps(spark, monkeypatch):
    points, centroids = dense(spark, [(0, 0), (10, 10)]), kmeans.as_frame(spark, [(0, 0), (9, 9)])
    a = kmeans.assign(points, centroids)
    assert sorted(map(tuple, a.collect())) == [(0, 0, 0.0), (1, 1, 2.0)]
    assert tuple(kmeans.objective(a).first()) == (2.0, 1.0)
    tie = kmeans.assign(dense(spark, [(1, 1)]), kmeans.as_frame(spark, [(0, 1), (2, 1)]))
    assert tie.first().cluster == 0
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, kmeans.assign(points, centroids).collect())) == [(0, 0, 0.0), (1, 1, 2.0)]
    assert kmeans.imbalance([1, 3]) == 2 * 10 / 16


def test_kmeans_trains(spark):
    points = dense(spark, [(0, 0), (0, 1), (9, 9), (10, 10)])
    c = kmeans.KMeans(n_iter=5, n_redo=2).train(points, 2)
    assert sorted(map(tuple, c.tolist())) == [(0.0, 0.5), (9.5, 9.5)]
    assert kmeans.KMeans().train(points, 4).tolist() == [[0, 0], [0, 1], [9, 9], [10, 10]]
    for bad in (lambda: kmeans.KMeans().train(points, 5), lambda: kmeans.KMeans(n_iter=0).train(points, 2)):
        with pytest.raises(ValueError):
            bad()
    heavy = points.withColumn("w", F.when(F.col("vec_id") == 1, 3.0).otherwise(1.0))
    means, h, loss = kmeans.step(heavy, np.array([[0.0, 0.0], [9.0, 9.0]]), "w")
    assert means.tolist() == [[0, 0.75], [9.5, 9.5]] and h.tolist() == [4, 2] and loss == 1 + 2


def test_empty_clusters_split():
    c, h = kmeans.split_empty(np.array([[1.0, 1.0], [5.0, 5.0], [0.0, 0.0]]), np.array([2.0, 8.0, 0.0]), 10.0, np.random.default_rng(0))
    assert h.sum() == 10 and h[2] > 0 and not (c[2] == c[0]).all()
    c, h = kmeans.split_empty(np.ones((3, 2)), np.array([0.5, 0.25, 0.0]), 0.75, np.random.default_rng(0))
    assert h.tolist() == [0.25, 0.25, 0.25]


@pytest.fixture(scope="module")
def trained(spark):
    x = np.array([[((17 * i + 31 * j) % 100) / 100 for j in range(8)] for i in range(300)], dtype=np.float32)
    points = dense(spark, x)
    return x, points, pq.ProductQuantizer.fit(points, 4, "euclidean", n_iter=3)


def test_pq_codes_are_the_least_table_entries(spark, trained):
    x, points, q = trained
    codes = {r.vec_id: r.codes for r in q.encode(points).collect()}
    tables = q.tables(x)
    assert all(codes[i] == tables[i].argmin(axis=1).tolist() for i in range(300))
    back = {r.vec_id: r.vector for r in q.decode(q.encode(points)).collect()}
    assert len(back[0]) == 8 and np.isfinite(back[0]).all()
    again = pq.ProductQuantizer.from_frame(q.to_frame(spark), "euclidean")
    assert (again.codebook == q.codebook).all()


def test_adc_is_the_distance_to_decoded_vectors(spark, trained):
    _, points, q = trained
    encoded, queries = q.encode(points), points.where("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.doc_id): r.score for r in q.top_k(encoded, queries, 5).collect()}
    want = {(r.query_id, r.doc_id): r.score for r in search.top_k(q.decode(encoded), queries, 300, "euclidean").collect()}
    assert len(got) == 15 and all(abs(want[k] - v) < 1e-6 for k, v in got.items())


def test_subspaces():
    assert pq.choose_subspaces(64) == 64 and pq.choose_subspaces(200) == 8 and pq.choose_subspaces(64, 16) == 16
    for dim, asked in ((64, 6), (64, 128), (7, 0), (10, 4)):
        with pytest.raises(ValueError):
            pq.choose_subspaces(dim, asked)


def token_docs(spark, docs, key="doc_id"):
    return spark.createDataFrame([(i, [[float(v) for v in t] for t in d]) for i, d in enumerate(docs)], f"{key} long, tokens array<array<float>>")


def test_maxsim_search(spark):
    docs = token_docs(spark, [[(1, 0), (0, 1)], [(2, 0), (0, 2)], []])
    got = multivec.maxsim_top_k(docs, token_docs(spark, [[(1, 0)]], "query_id"), 3).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 2.0), (0, 1.0), (2, -np.inf)]
    with pytest.raises(Exception):
        multivec.maxsim_top_k(docs, token_docs(spark, [[(1, 0, 0)]], "query_id"), 3).collect()


@pytest.fixture(scope="module")
def two_level(spark):
    random = np.random.default_rng(42)
    docs = token_docs(spark, random.uniform(-1, 1, (128, 4, 8)))
    coarse = kmeans.KMeans(n_iter=3).train(multivec.flat_tokens(docs), 4).astype(np.float32)
    return docs, {norms: multivec.TwoLevelQuantizer.fit_from_coarse(docs, coarse, 4, norms, n_iter=3) for norms in (False, True)}


@pytest.mark.parametrize("norms", [False, True])
def test_two_levels(spark, two_level, norms):
    docs, quantizers = two_level
    q = quantizers[norms]
    assert len(q.to_bytes(np.ones((3, 8), dtype=np.float32))) == 3 * (4 + 4 + 2 * norms)
    encoded = q.encode(docs)
    back = {r.doc_id: r.tokens for r in q.decode(encoded).collect()}
    assert np.array(back[0]).shape == (4, 8)
    queries = docs.where("doc_id < 2").withColumnRenamed("doc_id", "query_id")
    got = q.top_k(encoded, queries, 3).collect()
    want = {(r.query_id, r.doc_id): r.score for r in multivec.maxsim_top_k(q.decode(encoded), queries, 200).collect()}
    assert all(abs(want[r.query_id, r.doc_id] - r.score) < 1e-3 for r in got)
    ones = token_docs(spark, [np.full((4, 8), 0.9), np.full((4, 8), 0.1)])
    ranked = q.top_k(q.encode(ones), token_docs(spark, [np.ones((32, 8))], "query_id"), 2).orderBy("rank").collect()
    assert [r.doc_id for r in ranked] == [0, 1]


def test_token_codes(spark):
    book = pq.ProductQuantizer(np.zeros((4, 256, 2), dtype=np.float32))
    codes = multivec.TokenQuantizer(book).encode(token_docs(spark, [np.zeros((3, 8))])).first().tokens
    assert [len(c) for c in codes] == [4, 4, 4] and not np.array(codes).any()


def sparse(spark, rows, key="vec_id"):
    return spark.createDataFrame([(i, list(r), [float(v) for v in r.values()]) for i, r in enumerate(rows)], f"{key} long, components array<long>, values array<float>")


def test_packed(spark):
    docs, queries = sparse(spark, [{1: 1.5, 10: 2, 100: 2.5}, {2: 0.5, 11: 1}, {}]), sparse(spark, [{1: 2, 10: 3, 11: 4}], "query_id")
    mapping = packed.train_mapping(docs, 505)
    assert sorted(mapping.tolist()) == list(range(505)) and (packed.inverse(mapping)[mapping] == np.arange(505)).all()
    rows = packed.pack(docs, mapping)
    assert all(len(r.packed) % 8 == 0 for r in rows.collect())
    assert [(r.doc_id, r.score) for r in packed.top_k(rows, queries, mapping, 3).orderBy("rank").collect()] == [(0, 9.0), (1, 4.0), (2, 0.0)]
    assert sorted((r.vec_id, r.components, r.values) for r in packed.unpack(rows, mapping).collect()) == [(0, [1, 10, 100], [1.5, 2.0, 2.5]), (1, [2, 11], [0.5, 1.0]), (2, [], [])]
    random = np.random.default_rng(0)
    c = np.sort(random.choice(65_536, 300, replace=False))
    v = random.integers(0, 256, 300) / 64
    new, values = packed.unpack_one(packed.pack_one(c, v, np.arange(65_536)))
    assert (new == c).all() and (values == v).all()
    for bad in (lambda: packed.train_mapping(docs, 70_000), lambda: packed.top_k(rows, sparse(spark, [{600: 1}], "query_id"), mapping, 1)):
        with pytest.raises(ValueError):
            bad()


def rescored(spark, scores):
    return spark.createDataFrame([(0, 100 + i, i + 1, float(s)) for i, s in enumerate(scores)], "query_id long, doc_id long, first_rank int, score double")


@pytest.mark.parametrize(
    "scores,k,beta,want",
    [([0.9, 0.1, 0.5, 0.2, 0.3, 0.99], 2, 2, [(100, 0.9), (102, 0.5)]), ([0.9, 0.1], 3, 2, []), ([0.1, 0.2, 0.3], 1, 0, [(102, 0.3)]), ([0.3, 0.2, 0.9], 1, 1, [(100, 0.3)]), ([0.5, 0.5, 0.5], 2, 9, [(100, 0.5), (101, 0.5)])],
)
def test_early_exit(spark, scores, k, beta, want):
    got = rerank.early_exit(rescored(spark, scores), k, beta, "dotproduct").orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == want
    flipped = rerank.early_exit(rescored(spark, [-s for s in scores]), k, beta, "euclidean").orderBy("rank").collect()
    assert [(r.doc_id, -r.score) for r in flipped] == want


def test_plain_rerank_and_pruning(spark):
    got = rerank.plain(rescored(spark, [1, 2, 2, 0]), 3, "dotproduct").orderBy("rank").collect()
    assert [r.doc_id for r in got] == [101, 102, 100]
    c = spark.createDataFrame([(0, i, i + 1, s) for i, s in enumerate([1.0, 0.9, 0.85, 0.5])], "query_id long, doc_id long, rank int, score double")
    assert sorted(r.doc_id for r in rerank.prune(c, 2, 0.1).collect()) == [0, 1, 2]
    assert rerank.prune(c, 9, 0.1).count() == 4
    with pytest.warns(UserWarning):
        assert sorted(r.doc_id for r in rerank.prune(c, 2, 0.0, "euclidean").collect()) == [0, 1]
    docs, queries = c.select("doc_id", F.lit(1.0).alias("x")), spark.createDataFrame([(0, 2.0)], "query_id long, y double")
    assert [(r.doc_id, r.score) for r in rerank.two_stage(c, queries, docs, F.col("x") * F.col("y"), 3, 2).orderBy("rank").collect()] == [(0, 2.0), (1, 2.0)]
    assert rerank.two_stage(c, queries, docs, F.col("x"), 3, 0, alpha=0.1).count() == 0


def test_evaluation(spark):
    truth = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 2)], "query_id long, doc_id long")
    assert evaluate.recall(truth, truth.where("query_id = 0")).first().recall == 0.5
    a, b = F.array(*map(F.lit, (1, 2, 3, 5))), F.array(*map(F.lit, (2, 3, 4)))
    assert spark.range(1).select(evaluate.intersection(a, b).alias("n")).first().n == 2


def test_npy(spark, tmp_path):
    x = np.array([[1, 2, 3], [4, 5, 6]], dtype=np.float32)
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    np.save(tmp_path / "d.npy", x.astype(float))
    for name in ("a.npy", "f.npy"):
        assert sorted(map(tuple, binary.read_npy(spark, str(tmp_path / name)).collect())) == [(0, [1, 2, 3]), (1, [4, 5, 6])]
    assert spark.read.format("npy").option("rows", 1).load(str(tmp_path / "a.npy")).rdd.getNumPartitions() == 2
    for bad in ("d.npy", "none.npy"):
        with pytest.raises(Exception):
            binary.read_npy(spark, str(tmp_path / bad)).collect()


def sparse_file(path, rows):
    with open(path, "wb") as f:
        f.write(struct.pack("<I", len(rows)))
        for r in rows:
            f.write(struct.pack(f"<I{len(r)}I{len(r)}f", len(r), *r, *r.values()))


def test_sparse_files(spark, tmp_path):
    sparse_file(tmp_path / "s.bin", [{0: 1.0, 2: 3.0}, {1: 2.0}])
    df = binary.read_sparse(spark, str(tmp_path / "s.bin"))
    assert sorted(map(tuple, df.collect())) == [(0, [0, 2], [1, 3]), (1, [1], [2])]
    assert binary.read_sparse(spark, str(tmp_path / "s.bin"), limit=1).count() == 1
    sparse_file(tmp_path / "w.bin", [{70_000: 1.0}])
    sparse_file(tmp_path / "u.bin", [{5: 1.0, 3: 1.0}])
    (tmp_path / "t.bin").write_bytes((tmp_path / "s.bin").read_bytes()[:-3])
    for name, kind in (("w.bin", "u16"), ("u.bin", "u32"), ("t.bin", "u32")):
        with pytest.raises(Exception):
            binary.read_sparse(spark, str(tmp_path / name), component=kind).collect()


def test_buffers(spark):
    assert sorted(map(tuple, binary.from_dense_buffer(spark, np.arange(6), 3).collect())) == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]
    assert sorted(map(tuple, binary.from_token_buffer(spark, np.arange(6), [0, 4, 6], 2).collect())) == [(0, [[0, 1], [2, 3]]), (1, [[4, 5]])]
    for bad in (lambda: binary.from_dense_buffer(spark, np.arange(5), 3), lambda: binary.from_token_buffer(spark, np.arange(6), [0, 4], 2), lambda: binary.from_token_buffer(spark, np.arange(6), [0, 3, 6], 2), lambda: binary.from_token_buffer(spark, np.arange(0), [], 2)):
        with pytest.raises(ValueError):
            bad()


def test_collections_come_back(spark, tmp_path):
    data = VectorDataset(dense(spark, [(1, 2), (3, 4)]), Meta(Layout.DENSE, 2))
    store.save(data, str(tmp_path / "c"))
    back = store.load(spark, str(tmp_path / "c"))
    assert back.meta == data.meta and sorted(map(tuple, back.df.collect())) == sorted(map(tuple, data.df.collect()))
    with pytest.raises(Exception):
        store.load(spark, str(tmp_path / "nothing"))
    for f in (tmp_path / "c" / "meta").glob("part*"):
        f.write_text("junk")
    with pytest.raises(Exception):
        store.load(spark, str(tmp_path / "c"))


def arguments(*more):
    return cli.parser().parse_args(["-i", "a", "-q", "b", "-o", "c", *more])


@pytest.mark.parametrize("more", [["-d", "cosine"], ["-v", "f64"], ["--dataset-type", "sparse"], ["--encoder", "pq", "-v", "f16"], ["--dataset-type", "sparse", "-d", "dotproduct", "--encoder", "dotvbyte"], ["--encoder", "dotvbyte"], ["--dataset-type", "other"]])
def test_what_the_command_line_refuses(more, capsys):
    with pytest.raises(ValueError):
        cli.check(arguments(*more))
    assert cli.main(["-i", "a", "-q", "b", "-o", "c", *more]) == 2 and capsys.readouterr().err


def test_command_line(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(300, 8)).astype(np.float32)
    np.save(tmp_path / "d.npy", x)
    np.save(tmp_path / "q.npy", x[:2])
    paths = ["-i", str(tmp_path / "d.npy"), "-q", str(tmp_path / "q.npy")]
    for i, more in enumerate((["-d", "DotProduct"], ["-v", "f16"], ["--encoder", "pq", "--pq-subspaces", "4"])):
        a = cli.parser().parse_args([*paths, "-o", "x", "-k", "3", *more])
        store.write_ground_truth(cli.ground_truth(spark, a), str(tmp_path / f"out{i}"))
        rows = store.read_ground_truth(spark, str(tmp_path / f"out{i}")).collect()
        assert len(rows) == 6 and sorted({r["rank"] for r in rows}) == [1, 2, 3]
    sparse_file(tmp_path / "s.bin", [{0: 1.0, 2: 3.0}, {1: 2.0}])
    for more in ([], ["--encoder", "dotvbyte", "--component-type", "u16"]):
        a = cli.parser().parse_args(["-i", str(tmp_path / "s.bin"), "-q", str(tmp_path / "s.bin"), "-o", "x", "-d", "dotproduct", "--dataset-type", "sparse", *more])
        assert sorted(map(tuple, cli.ground_truth(spark, a).collect())) == [(0, 0, 1, 10.0), (0, 1, 2, 0.0), (1, 0, 2, 0.0), (1, 1, 1, 4.0)] or more



def test_encoded_collections_come_back(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(300, 8)).astype(np.float32)
    plain = VectorDataset(dense(spark, x), Meta(Layout.DENSE, 8, metric=Metric.L2))
    rows = VectorDataset(sparse(spark, [{1: 1.5, 10: 2}, {2: 0.5, 11: 1}, {}]), Meta(Layout.SPARSE, 12))
    many = VectorDataset(token_docs(spark, np.random.default_rng(2).normal(size=(80, 4, 8))), Meta(Layout.MULTIVEC, 8))
    made = [plain.convert("pq", m=4, n_iter=1), rows.convert("packed"), many.convert("token_pq", m=4, n_iter=1), many.convert("two_level", coarse=3, m=4, n_iter=1)]
    for i, (data, source) in enumerate(zip(made, (plain, rows, many, many))):
        store.save(data, str(tmp_path / str(i)))
        back = store.load(spark, str(tmp_path / str(i)))
        assert isinstance(back, EncodedDataset) and back.kind == data.kind and back.meta == data.meta and back.space_bytes() == data.space_bytes() > 0
        q = source.as_queries(F.col(source.key) < 2)
        got, want = (sorted(map(tuple, d.search(q, 3).collect())) for d in (back, data))
        assert got == want and len(got) == 6 and len(back) == len(source) and back.nearest(q).count() == 2
        own = back.search(back.as_queries(F.col(back.key) == 0), 3)
        assert own.count() == 3 and back.get(0).count() == 1
        grown = back.append(source.df.where(F.col(source.key) < 2))
        assert len(grown) == len(source) + 2 and sorted(r[0] for r in grown.df.select(back.key).collect()) == list(range(len(source) + 2))
        with pytest.raises(IndexError):
            back.get(10**6)
    for bad in (lambda: plain.convert("packed"), lambda: plain.convert("two_level"), lambda: many.convert("other")):
        with pytest.raises(ValueError):
            bad()


def test_both_stages_as_an_index(spark):
    docs, q = sparse(spark, [{0: 1, 1: 2}, {1: 3}, {2: 1}, {0: 2}]), sparse(spark, [{0: 1.0, 1: 1.0}], "query_id")
    plain = VectorDataset(docs, Meta(Layout.SPARSE, 3))
    first = ExhaustiveIndex.build(plain, "packed")
    assert first.n_elements() == 4 and first.dim() == 3 and first.space_bytes() > 0
    for second in (plain, plain.convert("packed")):
        index = rerank.RerankIndex(first, second)
        assert len(index) == 4 and not index.is_empty()
        assert [(r.doc_id, r.score) for r in index.search(q, q, 3, 2).orderBy("rank").collect()] == [(0, 3.0), (1, 3.0)]
        assert index.search(q, q, 3, 2, alpha=0.0, beta=1).count() == 2
    many = VectorDataset(token_docs(spark, [[(1, 0), (0, 1)], [(2, 0)], [(0, 3)]]), Meta(Layout.MULTIVEC, 2))
    tq = token_docs(spark, [[(1, 0)]], "query_id")
    assert [r.doc_id for r in rerank.RerankIndex(many, many).search(tq, tq, 3, 2).orderBy("rank").collect()] == [1, 0]


def test_coarse_training_with_given_centroids(spark, two_level):
    docs, quantizers = two_level
    q = quantizers[True]
    nearest = q.encode(docs).select("doc_id", F.col("tokens.coarse").alias("coarse"))
    again = multivec.TwoLevelQuantizer.fit_from_coarse(docs, q.coarse, 4, True, n_iter=3, assignments=nearest)
    assert (again.pq.codebook == q.pq.codebook).all()
    other = docs.select("doc_id", F.transform("tokens", lambda t: F.lit(1)).alias("coarse"))
    assert (multivec.TwoLevelQuantizer.fit_from_coarse(docs, q.coarse, 4, True, n_iter=1, assignments=other).pq.codebook != q.pq.codebook).any()
    few = multivec.TwoLevelQuantizer.fit_from_coarse(docs, q.coarse, 4, True, n_iter=1, sample=400)
    assert few.pq.codebook.shape == q.pq.codebook.shape
    forced = q.encode_with_ids(docs.join(other, "doc_id"))
    assert {c for r in forced.limit(9).collect() for c in [t.coarse for t in r.tokens]} == {1}
    for bad in (docs.select("doc_id", F.array(F.lit(9)).alias("coarse")), docs.select("doc_id", F.array().cast("array<int>").alias("coarse"))):
        with pytest.raises(Exception):
            q.encode_with_ids(docs.join(bad, "doc_id")).collect()
    for norms, z in quantizers.items():
        t = np.random.default_rng(3).normal(size=(5, 8)).astype(np.float32)
        assert all((a == b).all() for a, b in zip(z.from_bytes(z.to_bytes(t)), z.parts(t)))
        with pytest.raises(ValueError):
            z.from_bytes(z.to_bytes(t)[:-1])


def test_components_that_occur_together_are_close(spark):
    random = np.random.default_rng(5)
    places = random.permutation(400).reshape(8, 50)
    docs = sparse(spark, [{int(c): 1.0 for c in sorted(random.choice(places[i % 8], 12, replace=False))} for i in range(200)])
    sizes = []
    for order in ("cooccurrence", "frequency"):
        mapping = packed.train_mapping(docs, 400, order)
        assert sorted(mapping.tolist()) == list(range(400))
        sizes.append(sum(max(mapping[list(r.components)]) - min(mapping[list(r.components)]) for r in docs.collect()))
    assert sizes[0] < 0.85 * sizes[1]


def test_many_queries_meet_documents_in_boxes(spark, monkeypatch):
    """Beyond what may be sent to all tasks, every layout gives the same rows."""
    x = np.random.default_rng(1).normal(size=(300, 8)).astype(np.float32)
    plain = VectorDataset(dense(spark, x).repartition(3), Meta(Layout.DENSE, 8))
    rows = VectorDataset(sparse(spark, [{i % 7: 1.5, 10 + i % 3: 2} for i in range(40)]), Meta(Layout.SPARSE, 14))
    many = VectorDataset(token_docs(spark, [np.random.default_rng(i).normal(size=(i % 4, 8)) for i in range(60)]), Meta(Layout.MULTIVEC, 8))
    sets = [(plain.convert("pq", m=4, n_iter=1), plain), (rows.convert("packed"), rows), (rows, rows), (many, many)]
    want = [sorted(map(tuple, d.search(s.as_queries(F.col(s.key) < 5), 4).collect())) for d, s in sets]
    monkeypatch.setattr(multivec, "SIMILARITIES", 20)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(search, "SPARSE_BLOCK", 2)
    got = [sorted(map(tuple, d.search(s.as_queries(F.col(s.key) < 5), 4).collect())) for d, s in sets]
    assert got == want and all(len(w) == 20 for w in want)


def test_small_sides_are_measured(spark, tmp_path):
    """A filter over a large table counts by its rows, so documents aren't shuffled to meet it."""
    spark.range(200_000).withColumn("x", F.col("id") * 0.5).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    few = table.where("id < 8")
    limit = 50_000
    assert common.bytes_of(few) > limit and common.small(few, limit) and not common.small(table, limit)
    assert common.small(table, limit, most=100) and not common.small(table, limit, most=10**6)
    plan = table.join(common.sized(few, limit), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sums_in_a_tree(spark):
    rows = [(i, bytearray(np.array([i, 0.1 * i]).tobytes())) for i in range(200)]
    df = spark.createDataFrame(rows, "task long, x binary").repartition(7)
    for tasks in (1, 5000):
        assert np.frombuffer(common.tree_sum(df, ("x",), tasks).x) == pytest.approx([19900, 1990])


def test_imbalance_counts_empty_clusters(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (1, 2, 1.0)], "vec_id long, cluster int, distance double")
    assert kmeans.objective(a).first().imbalance == 1 and kmeans.objective(a, 4).first().imbalance == 2 == kmeans.imbalance([1, 0, 1, 0])


def test_slices_of_queries_are_sent_alone():
    """47 slices of one table, pickled as such, held the table 47 times and filled the driver."""
    import pickle

    import pyarrow as pa

    table = pa.table({"query_id": np.arange(6_000), "values": pa.array([[1.0] * 50] * 6_000)})
    pieces = [common.in_box(table.slice(lo, 128)) for lo in range(0, 6_000, 128)]
    assert len(pickle.dumps(pieces)) < 1.2 * table.nbytes and pa.concat_tables(map(common.unboxed, pieces)) == table


@pytest.mark.parametrize("metric", list(Metric))
def test_sparse_self_search_by_boxes(spark, metric, monkeypatch, tmp_path):
    """Boxes of a few vectors that share components with few others, none, or all; ties go to the lower id."""
    random = np.random.default_rng(2)
    rows = [{}, {5: 1.0}, {5: -2.0}, {7_000_000: 1.0}] + [{int(c): float(random.integers(-3, 4)) for c in np.sort(random.choice(300, 9, replace=False)) + i // 20 * 100_000} for i in range(80)]
    docs = sparse(spark, rows)
    folder = str(tmp_path / "rows")
    binary.write_sparse(docs.coalesce(1), folder)
    docs = binary.read_sparse(spark, folder)
    queries = docs.withColumnRenamed("vec_id", "query_id")
    x = np.zeros((len(rows), 400_300 + 1))
    for i, r in enumerate(rows):
        for c, v in r.items():
            x[i, min(c, 400_300)] = v
    product = x @ x.T
    norm = np.diag(product)
    score = product if metric is Metric.DOT else norm[:, None] + norm[None, :] - 2 * product
    want = [(q, int(d), n + 1, float(score[q, d])) for q in range(len(rows)) for n, d in enumerate(np.argsort(-score[q] if metric is Metric.DOT else score[q], kind="stable")[:6])]
    from sparkvec.operators import sparse_boxes

    monkeypatch.setattr(search, "SPARSE_BYTES", 0)
    monkeypatch.setattr(sparse_boxes, "BOX_BYTES", 1_000)
    monkeypatch.setattr(sparse_boxes, "HELD", 60)
    assert sorted(map(tuple, search.sparse_top_k(docs, queries, 6, metric).collect())) == sorted(want)
    assert search.sparse_top_k(docs, queries, 0, metric).count() == 0 and search.sparse_top_k(docs.limit(0), queries, 2, metric).count() == 0


@pytest.mark.parametrize("order", ["frequency", "cooccurrence"])
def test_packed_components_of_more_than_16_bits(spark, order, monkeypatch, tmp_path):
    """As in the tables from 0.1 GB on; with gaps of one to four bytes, and in steps of a few components."""
    monkeypatch.setattr(packed, "HEAD", 3)
    monkeypatch.setattr(packed, "ENTRIES", 4)
    rows = [{1: 1.5, 300: 2, 70_000: 2.5, 20_000_000: 1}, {2: 0.5, 70_000: 1, 4_000_000_000: 3}, {}, {300: 1.0, 70_000: 0.25}]
    docs, top = sparse(spark, rows), 4_000_000_001
    encoder = packed.PackedEncoder.fit(docs, top, order)
    assert sorted(encoder.mapping.head.tolist()) == [1, 300, 70_000] and encoder.space_bytes() == 16 + 12 + 8
    c = np.array([0, 1, 2, 3, 299, 300, 301, 69_999, 70_000, 70_001, 4_000_000_000])
    new = encoder.mapping[c]
    assert (packed.inverse(encoder.mapping)[new] == c).all() and len(set(new.tolist())) == len(c) and new[c > 70_000].tolist() == c[c > 70_000].tolist()
    path = str(tmp_path / "packed")
    store.save(VectorDataset(docs, Meta(Layout.SPARSE, top)).convert("packed", order=order), path)
    data = store.load(spark, path)
    assert sorted((r.vec_id, r.components, r.values) for r in data.decoded().df.collect()) == [(i, list(r), list(r.values())) for i, r in enumerate(rows)]
    queries = sparse(spark, [{300: 2, 70_000: 4, 4_000_000_000: 1}], "query_id")
    assert [(r.doc_id, r.score) for r in data.search(queries, 4).orderBy("rank").collect()] == [(0, 14.0), (1, 7.0), (3, 3.0), (2, 0.0)]


def test_packed_vectors_of_many_components():
    """Beyond 65,534 components, and beside vectors in the short form, which stays as it was."""
    random = np.random.default_rng(3)
    c = [np.arange(5), np.sort(random.choice(1 << 22, 70_000, replace=False)), np.array([], dtype=np.int64), np.array([255, 511, 70_000])]
    count, v = np.array([len(x) for x in c]), [random.integers(0, 256, len(x)) / 64 for x in c]
    raw, offsets = packed.pack_rows(np.concatenate(c), np.concatenate(v), count, packed.HeadMapping([], 1 << 22))
    new, values, n = packed.unpack_rows(raw, offsets[:-1])
    assert (n == count).all() and (new == np.concatenate(c)).all() and (values == np.concatenate(v)).all() and not (offsets % 8).any()
    assert raw[: offsets[1]].tobytes() == bytes([5, 0, 0, 0, 1, 1, 1, 1]) + (v[0] * 64).astype(np.uint8).tobytes() + bytes(offsets[1] - 13)


@pytest.fixture(scope="module")
def wide_lines(spark, tmp_path_factory):
    """Lines of 20 suppliers whose parts have numbers beyond 16 bits, as in copies of the tables with shifted keys."""
    folder = tmp_path_factory.mktemp("wide")
    rows = spark.range(600).select((F.col("id") % 20).alias("l_suppkey"), (F.pmod(F.xxhash64("id"), F.lit(40)) * 20_011).alias("l_partkey"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"))
    rows.write.parquet(str(folder / "lineitem.parquet"))
    return str(folder)


def test_query_packed_roundtrip_of_many_parts(spark, wide_lines):
    want = queries.sparse(spark, wide_lines, 1 / 64).withColumn("values", C.store_all(F.col("values"), "fixedu8"))
    got = QUERIES["packed_roundtrip"](spark, wide_lines)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, queries._components(want).collect())) and got.agg(F.max("component")).first()[0] > 65_536


def test_query_packed_topk_of_many_parts(spark, wide_lines):
    got, want = (sorted(map(tuple, QUERIES[name](spark, wide_lines).collect())) for name in ("packed_topk", "sparse_topk_fixedu8"))
    assert got == want and len(want) == 50


def test_query_packed_vectors_as_queries_of_many_parts(spark, wide_lines):
    stored = queries.sparse(spark, wide_lines, 1 / 64).withColumn("values", C.store_all(F.col("values"), "fixedu8"))
    want = search.sparse_top_k(stored, stored.where(F.col("vec_id").between(10, 14)).withColumnRenamed("vec_id", "query_id"), 10)
    got = QUERIES["packed_vectors_as_queries"](spark, wide_lines)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 50


def test_sparse_files_are_written_by_tasks(spark, wide_lines, monkeypatch, tmp_path):
    """No vector comes to the driver; ids go on from file to file, and files and splits are cut by bytes."""
    want = sorted((i, r.components, r.values) for i, r in enumerate(queries.sparse(spark, wide_lines).orderBy("vec_id").collect()))
    monkeypatch.setattr(binary, "SPLIT_BYTES", 400)
    monkeypatch.setattr(binary, "BATCH_BYTES", 150)
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "toArrow", None)
        path = queries._sparse_file(spark, wide_lines)
    df = binary.read_sparse(spark, path)
    assert df.rdd.getNumPartitions() > 4 and sorted(map(tuple, df.collect())) == want
    rows = [dict(zip(c, v)) for _, c, v in want] + [{}, {}]
    sparse_file(tmp_path / "one.bin", rows)
    for more in ({}, {"rows": 3}):
        reader = binary.SparseReader(str(tmp_path / "one.bin"), more.get("rows", 65_536), None, True)
        splits = reader.partitions()
        assert len(splits) > 4 and sum(s.count for s in splits) == len(rows) and all(s.count <= 3 for s in splits if more)
        got = [r for s in splits for b in reader.read(s) for r in b.to_pylist()]
        assert [(r["vec_id"], r["components"], r["values"]) for r in got] == want + [(len(want) + i, [], []) for i in (0, 1)]
    binary.write_sparse(df.limit(0), str(tmp_path / "none"))
    assert binary.read_sparse(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        binary.write_sparse(sparse(spark, [{-1: 1.0}]), str(tmp_path / "bad"))


def test_sparse_file_limit_opens_the_first_files_only(spark, tmp_path):
    """In a folder, over several files, even if those behind the limit are damaged."""
    (tmp_path / "f").mkdir()
    for i in range(4):
        sparse_file(tmp_path / "f" / f"part-{i}.bin", [{i: 1.0}, {i + 9: 2.0}, {}])
    (tmp_path / "f" / "part-3.bin").write_bytes(b"")
    (tmp_path / "f" / "_SUCCESS").write_bytes(b"")
    for limit, files in ((0, 0), (2, 1), (3, 1), (5, 2), (7, 3)):
        rows = sorted(map(tuple, binary.read_sparse(spark, str(tmp_path / "f"), limit=limit).collect()))
        assert rows == [(3 * i + j, *x) for i in range(3) for j, x in enumerate((([i], [1.0]), ([i + 9], [2.0]), ([], [])))][:limit]
        assert len(binary.SparseReader(str(tmp_path / "f"), 9, limit, True).partitions()) == files
    with pytest.raises(Exception):
        binary.read_sparse(spark, str(tmp_path / "f")).collect()
