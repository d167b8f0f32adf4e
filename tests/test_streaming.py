"""Micro-batches."""

from sparkvec.streaming import append


def test_batches_are_searched_and_appended(spark, tmp_path):
    schema = "vec_id long, vector array<float>"
    source = str(tmp_path / "in")
    for i in range(2):
        spark.createDataFrame([(2 * i + j, [float(2 * i + j), 1.0]) for j in range(2)], schema).coalesce(1).write.mode("append").parquet(source)
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<float>")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = []
    q = append.search_new(stream(), queries, 1, "dotproduct", lambda number, rows: found.extend((number, r.doc_id, r.score) for r in rows.collect()))
    run = q.option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert len({n for n, _, _ in found}) == 2 and {(d, s) for _, d, s in found} == {(1, 1.0), (3, 3.0)}
    run = append.append_to(stream(), str(tmp_path / "out"), str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 4
