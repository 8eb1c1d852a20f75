"""Search by index and in blocks, and the learned encoder, against dense linear algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import drift, embeddings, latent, search

DOCS = "/root/testdata/sf0.001/documents.parquet"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(v) for v in row]) for k, row in enumerate(x)], "record_id long, embedding array<float>")


def brute(x, queries, k):
    x, queries = (a.astype(np.float32).astype(float) for a in (x, queries))
    lengths = np.linalg.norm(x, axis=1)[None, :] * np.linalg.norm(queries, axis=1)[:, None]
    scores = np.divide(queries @ x.T, lengths, out=np.zeros_like(lengths), where=lengths > 0)
    return [[int(i) for i in np.lexsort((np.arange(len(x)), -np.round(row, 9)))[:k]] for row in scores]


@pytest.mark.parametrize("blocks", [(16_384, 2_048), (37, 5)])
def test_exact_search(spark, blocks):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 6))
    x[7] = 0
    asked = x[::23]
    table = frame(spark, x).unionByName(spark.createDataFrame([(None, [1.0] * 6), (900, None)], "record_id long, embedding array<float>"))
    queries = frame(spark, asked, 1000).withColumn("rank", F.lit("x"))
    found = search.exact_search(table, queries, 5, row_block=blocks[0], query_block=blocks[1]).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.record_id)
    assert got == {1000 + k: ids for k, ids in enumerate(brute(x, asked, 5))}
    assert search.exact_search(table.limit(0), queries, 5).count() == 0


def test_index_finds_and_keeps_every_row(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(0, 20, 1500)] + 0.4 * rng.standard_normal((1500, 16))
    x[500:1000] = x[3]  # a third of the rows are copies: one list in many blocks
    table, queries = frame(spark, x), frame(spark, x[::30])
    index = search.build_index(table, str(tmp_path / "index"), lists=24, row_block=100)
    again = search.load_index(spark, str(tmp_path / "index"))
    rows = again.rows(spark)
    assert rows.count() == 1500 and rows.select("_id").distinct().count() == 1500
    assert rows.groupBy("_list", "_block").count().agg(F.max("count")).first()[0] <= 100
    exact = search.exact_search(table, queries, 10)
    found = search.search_index(again, queries, 10, probes=8, query_block=7)
    assert search.recall(found, exact).first().recall >= 0.9
    assert found.groupBy("query_id").count().filter("count != 10").count() == 0
    near = {(r.query_id, r.record_id): r.similarity for r in exact.collect()}
    assert all(abs(near[r.query_id, r.record_id] - r.similarity) < 1e-6 for r in found.collect() if (r.query_id, r.record_id) in near)
    assert np.allclose(index.centres, again.centres)


def test_latent_values_against_dense_svd(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text").repartition(5)
    encoder = latent.fit_latent_encoder(docs, "text", k=12, terms=512, rounds=6)
    rows = latent._weighted(docs.select("doc_id", F.col("text").alias("_text")), encoder.idf, 512).collect()
    dense = np.zeros((len(rows), 512))
    for k, r in enumerate(rows):
        dense[k, r._indices] = r._values
    wanted = np.linalg.svd(dense, compute_uv=False)[:12]
    assert np.allclose(encoder.singular_values, wanted, rtol=0.01)
    assert np.allclose(encoder.vectors.T @ encoder.vectors, np.eye(12), atol=1e-9)
    coordinates = dense @ encoder.vectors
    lengths = np.linalg.norm(coordinates, axis=1, keepdims=True)
    unit = np.divide(coordinates, lengths, out=np.zeros_like(coordinates), where=lengths > 0)
    found = {r.doc_id: r.embedding for r in encoder.transform(docs, "text").collect()}
    assert all(np.allclose(found[r.doc_id], unit[k], atol=1e-5) for k, r in enumerate(rows))


def test_partial_factors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((90, 8))
    rows = spark.createDataFrame([(list(range(8)), [float(v) for v in row]) for row in x], "_indices array<int>, _values array<double>").repartition(30)
    triangle = latent._tall_triangle(rows, np.eye(8), fan=3)
    assert np.allclose(np.linalg.svd(triangle, compute_uv=False), np.linalg.svd(x, compute_uv=False))


def test_two_encoders_are_compared(spark):
    docs = spark.read.parquet(DOCS).select(F.col("doc_id").alias("record_id"), F.col("text").alias("prompt_text"))
    encoders = {"built-in": None, "latent": latent.fit_latent_encoder(docs, k=8, rounds=1)}
    rows = embeddings.compare_encoders(docs, encoders).collect()
    assert [(r.model_name, r.num_records, r.embedding_dimensions) for r in rows] == [("built-in", 200, 256), ("latent", 200, 8)]
    assert all(r.seconds > 0 for r in rows)


def test_empty_and_missing_texts(spark):
    docs = spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", None), ("d", "two three")], "record_id string, prompt_text string")
    found = {r.record_id: r.embedding for r in latent.fit_latent_encoder(docs, k=4, terms=64).transform(docs, "prompt_text").collect()}
    assert set(found) == {"a", "b", "c", "d"} and not any(found["b"]) and not any(found["c"])


def test_vectors_and_metadata_belong_together_by_id(spark):
    vectors = spark.createDataFrame([(2, [2.0]), (1, [1.0]), (4, [4.0])], "record_id long, embedding array<double>")
    metadata = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "record_id long, m string")
    assert sorted((r.record_id, r.embedding[0], r.m) for r in drift.attach_metadata(vectors, metadata).collect()) == [(1, 1.0, "a"), (2, 2.0, "b")]


def test_scores_are_held_in_slices(monkeypatch):
    """A block of queries meets a block of rows a slice at a time, with the same result."""
    rng = np.random.default_rng(5)
    queries, rows = rng.standard_normal((70, 4)), rng.standard_normal((90, 4))
    names, ids = np.arange(70), np.arange(90)
    monkeypatch.setattr(search, "SCORES", 500)
    sizes, plain = [], search._best
    monkeypatch.setattr(search, "_best", lambda i, q, s, k: sizes.append(s.size) or plain(i, q, s, k))
    found = search._compare(names, queries, ids, rows, 3)
    whole = search._matches(*plain(ids, names, queries @ rows.T, 3))
    assert max(sizes) <= 500 and found.column("_query").to_pylist() == whole.column("_query").to_pylist()
    assert found.column("_id").to_pylist() == whole.column("_id").to_pylist()
    assert (search._nearest(queries, rows)[0] == (queries @ rows.T).argmax(axis=1)).all()
