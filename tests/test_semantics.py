"""Vectors, drift, sampling, clusters, topics, exploratory reports."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import clusters, drift, embeddings, exploratory, sampling, topics, trendtests
from colloquy.plans.semantics import run_clustering, run_embeddings, run_topics, search
from colloquy.settings import ClusterSettings

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_cosine_top_k(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.8, 0.2]), (3, [0.0, 0.0])], "record_id int, embedding array<double>")
    rows = embeddings.cosine_top_k(df, [1.0, 0.0], 2).collect()
    assert [r.record_id for r in rows] == [0, 2] and rows[0].similarity == 1.0
    assert [r.record_id for r in embeddings.cosine_top_k(df, [0.0, 0.0], 4).collect()] == [0, 1, 2, 3]
    from_frame = embeddings.cosine_top_k(df, df.filter("record_id = 1").select("embedding"), 1).first()
    assert from_frame.record_id == 1


def test_centroids_and_drift(spark):
    df = spark.createDataFrame([([1.0, 1.0], "2024-01"), ([3.0, 3.0], "2024-01"), ([10.0, 0.0], "2024-02"), ([5.0, 5.0], None)],
                               "embedding array<double>, year_month string")
    rows = {r.year_month: r for r in drift.group_centroids(df, "year_month").collect()}
    assert rows["2024-01"].centroid == [2.0, 2.0] and rows["2024-01"].num_records == 2 and len(rows) == 2
    centroids = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 2, [0.0, 1.0]), ("c", 1, [0.0, 0.0])], "p string, num_records long, centroid array<double>")
    moved = drift.centroid_drift(centroids, "p").orderBy("from_period").collect()
    assert [(r.from_period, r.to_period, r.from_records, r.to_records, r.cosine_distance) for r in moved] == [("a", "b", 1, 2, 1.0), ("b", "c", 2, 1, 0.0)]


def test_rolling_centroids_weigh_records(spark):
    df = spark.createDataFrame([("a", [1.0]), ("a", [2.0]), ("b", [9.0]), ("c", [3.0])], "p string, embedding array<double>")
    rows = drift.rolling_centroids(df, "p", 2).orderBy("window_start").collect()
    assert [(r.window_start, r.window_end, r.num_records, r.centroid) for r in rows] == [("a", "b", 3, [4.0]), ("b", "c", 2, [6.0])]


def test_exact_sample(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    first = {r.k for r in sampling.exact_sample(df, "k", 500).collect()}
    again = {r.k for r in sampling.exact_sample(df.repartition(7), "k", 500).collect()}
    hashes = {r.k: r.h for r in df.select("k", F.xxhash64(F.lit(42), "k").alias("h")).collect()}
    assert first == again == set(sorted(hashes, key=lambda k: (hashes[k], k))[:500])
    assert sampling.exact_sample(df, "k", 5000).count() == 3000 and sampling.exact_sample(df, "k", None).count() == 3000


def test_plugged_encoder_and_reproducibility(spark):
    df = spark.createDataFrame([("a", "abc"), ("b", ""), ("c", None)], "record_id string, prompt_text string")

    def factory():
        return lambda texts: np.array([[len(t), 1.0 if t else 0.0] for t in texts], dtype=float)

    rows = {r.record_id: r.embedding for r in embeddings.embed_prompts(df, factory=factory).collect()}
    assert rows["a"] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)]) and rows["b"] == [0.0, 0.0] and "c" not in rows
    check = embeddings.embedding_reproducibility(df, factory=factory).first()
    assert check.is_reproducible and check.sample_size == 2
    compared = embeddings.compare_encoders(df, {"len": factory, "built-in": None}).collect()
    assert [(r.model_name, r.num_records) for r in compared] == [("len", 2), ("built-in", 2)]
    with pytest.raises(ValueError):
        embeddings.embed_prompts(df, "missing")


def test_cluster_quality_of_noise(spark):
    df = spark.createDataFrame([([0.0, 0.0], 0), ([0.1, 0.0], 0), ([5.0, 5.0], -1)], "embedding array<double>, cluster int")
    row = clusters.cluster_quality(df).first()
    assert (row.num_records, row.num_clusters) == (3, 1) and row.noise_fraction == pytest.approx(1 / 3)
    assert row.davies_bouldin is None and row.calinski_harabasz is None and row.silhouette_squared_euclidean is None


def test_cluster_labels(spark):
    rows = [("1", "write python function code", 0), ("2", "debug python function", 0), ("3", "noise here", -1)]
    df = spark.createDataFrame(rows, "record_id string, prompt_text string, cluster int")
    row = clusters.label_clusters(df).first()
    assert (row.cluster, row.num_records) == (0, 2) and row.label.split(", ")[:2] == ["function", "python"]


def test_topic_terms_and_statistics(spark):
    rows = [("write python code", 0), ("debug python function", 0), ("lonely emotional support", 1), ("zz", -1)]
    df = spark.createDataFrame(rows, "prompt_text string, topic int")
    terms = topics.top_terms_by_topic(df, top_n=3).orderBy("topic").collect()
    assert [(r.topic, r.top_terms) for r in terms] == [(0, "python"), (1, "emotional, lonely, support")]
    stats = topics.topic_statistics(df, topics.top_terms_by_topic(df)).first()
    assert (stats.num_documents, stats.num_topics, stats.noise_fraction, stats.topic_diversity) == (4, 2, 0.25, 1.0)
    empty = topics.top_terms_by_topic(spark.createDataFrame([("the", 5)], "prompt_text string, topic int")).first()
    assert (empty.topic, empty.num_records, empty.top_terms) == (5, 1, "")


def test_lda_and_categories(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    features, vocabulary = topics.tfidf_features(docs, "text", vocabulary=200, min_df=2)
    table, model = topics.lda_sweep(features, ks=(2, 3), max_iter=3)
    rows = table.collect()
    assert [r.k for r in rows] == [2, 3] and sum(r.is_best for r in rows) == 1
    assert min(rows, key=lambda r: r.log_perplexity).is_best
    words = topics.lda_topic_words(model, vocabulary, 5).collect()
    assert {r.term for r in words} <= set(vocabulary)
    named = topics.dominant_topic(model, features, {0: "Task-Based"})
    assert named.count() == docs.count() and named.filter("topic_probability <= 0 or topic_probability > 1").count() == 0
    assert set(r[0] for r in named.select("prompt_category").distinct().collect()) <= {"Task-Based", "Ambiguous"}


def test_semantic_runs(spark, tmp_path):
    source = str(tmp_path / "prompts.parquet")
    spark.read.parquet(DOCS).select(
        F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("prompt_text"),
        F.concat(F.lit("2024-0"), (F.col("doc_id") % 3 + 1).cast("string")).alias("year_month"),
    ).write.parquet(source)
    vectors_path = str(tmp_path / "vectors.parquet")
    record = run_embeddings(spark, source, vectors_path).first()
    assert record.num_records == 200
    vectors = spark.read.parquet(vectors_path)
    target = vectors.filter("record_id = '7'").first()
    found = search(vectors, "q", lambda texts: np.array([target.embedding]), 3)
    assert found.first().similarity == pytest.approx(1.0, abs=1e-6)
    quality = run_clustering(spark, vectors_path, str(tmp_path / "c"), ClusterSettings(150, 5, 3, (3,))).collect()
    assert {r.method for r in quality} == {"density", "kmeans_3"} and all(r.num_records == 150 for r in quality)
    assert all(r.silhouette_squared_euclidean is None or -1 <= r.silhouette_squared_euclidean <= 1 for r in quality)
    stats = run_topics(spark, vectors_path, str(tmp_path / "t"), min_topic_size=5, min_samples=3).first()
    assert stats.num_documents == 200 and 0 <= stats.topic_diversity <= 1


def test_clean_prompts_and_ranges(spark):
    rows = [("c", "two words", "d", "m", 2, 1), ("c", "two words", "d", "m", 2, 0), ("c", "x", "d", "m", 1, 0), ("c", None, "d", "m", 3, 0)]
    df = spark.createDataFrame(rows, "conversation_id string, prompt string, datetime string, year_month string, prompt_word_count int, turn_index int")
    assert [r.turn_index for r in exploratory.clean_prompts(df, q=1.0).collect()] == [0]
    times = spark.sql("SELECT explode(array(TIMESTAMP '2023-04-01', TIMESTAMP '2024-05-31', TIMESTAMP '2024-05-31 00:00:01')) AS t")
    assert exploratory.date_range(times, "t", "2023-04-01", "2024-05-31").count() == 2


def test_sentiment_of_empty_text(spark):
    df = spark.createDataFrame([(1, "good good bad"), (2, "")], "id int, t string")
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.0)], "term string, valence double")
    rows = {r.id: r for r in exploratory.lexicon_sentiment(df, lexicon, "t", "id").collect()}
    assert rows[1].sentiment_positive == pytest.approx(2 / 3) and rows[1].sentiment_compound == pytest.approx(3 / math.sqrt(24))
    assert rows[2].sentiment_neutral == 1.0 and rows[2].sentiment_compound == 0.0


def test_sentiment_counts_repeated_terms_and_missing_texts(spark):
    df = spark.createDataFrame([(1, "bad good x bad good good"), (2, None), (3, "x x")], "id int, t string")
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.0), ("", 9.0)], "term string, valence double")
    rows = {r.id: r for r in exploratory.lexicon_sentiment(df, lexicon, "t", "id").collect()}
    assert rows[1].sentiment_positive == pytest.approx(3 / 6) and rows[1].sentiment_negative == pytest.approx(2 / 6)
    assert rows[1].sentiment_compound == pytest.approx(4 / math.sqrt(31))
    assert rows[2].sentiment_neutral == rows[3].sentiment_neutral == 1.0


def test_shares_of_all_categories(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "z"), ("b", None)], "p string, c string")
    rows = {(r.p, r.c): (r.num_records, r.share_pct) for r in exploratory.category_share_table(df, "p", "c").collect()}
    assert rows[("b", "z")] == (1, 100.0) and rows[("a", "x")] == (2, pytest.approx(200 / 3)) and len(rows) == 3


@pytest.mark.parametrize("cells", [{("a", "x"): 8, ("a", "y"): 2, ("b", "y"): 7}, {("a", "x"): 3, ("b", "y"): 4, ("c", "x"): 5, ("c", "z"): 6}])
def test_chi_square_with_empty_cells(spark, cells):
    df = spark.createDataFrame([pair for pair, n in cells.items() for _ in range(n)], "r string, c string")
    names = [sorted({pair[k] for pair in cells}) for k in (0, 1)]
    table = np.array([[cells.get((r, c), 0) for c in names[1]] for r in names[0]], dtype=float)
    expected = table.sum(1)[:, None] * table.sum(0)[None, :] / table.sum()
    gap = np.abs(table - expected)
    if table.shape == (2, 2):
        gap = gap - np.minimum(0.5, gap)
    row = trendtests.chi_square_independence(df, "r", "c").first()
    assert row.chi_square == pytest.approx((gap**2 / expected).sum()) and row.num_records == table.sum()
    assert row.dof == (table.shape[0] - 1) * (table.shape[1] - 1)


def test_every_query_is_registered_with_its_columns(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 80
    assert entry(spark).columns == ["from_state", "to_state", "count", "probability"]


def test_topic_models_reach_the_fixed_point():
    """Every row's topics are a fixed point of the plain variational round, also where rounds move slowly."""
    from colloquy.operators import lda

    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 40, 60)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    columns = np.concatenate([rng.choice(50, n, replace=False) for n in lengths])
    values = rng.uniform(0.1, 9, len(columns))
    topics, alpha = np.exp(lda._expected_log(rng.gamma(100, 0.01, (6, 50)))).T, np.full(6, 1 / 6)
    seen = []
    for rows, own, counts in lda._blocks(starts, columns, values):
        gamma = lda._infer(own, counts, topics, alpha, np.ones((len(rows), 6)))
        share = np.exp(lda._expected_log(gamma))
        ratio = counts / (topics[own] @ share[:, :, None])[:, :, 0]
        again = share * (ratio[:, None, :] @ topics[own])[:, 0, :] + alpha
        assert np.abs(again - gamma).mean(axis=1).max() < 1e-3
        assert gamma.sum(axis=1) == pytest.approx(counts.sum(axis=1) + 1)
        seen.extend(rows.tolist())
    assert sorted(seen) == np.flatnonzero(lengths).tolist()
    assert lda.log_gamma(np.array([0.1, 5.0])) == pytest.approx([2.252712651734206, 3.1780538303479458])


def test_tfidf_features_count_words_and_pairs(spark):
    """Features equal a plain count, and pairs of words that are too rare to be taken are not counted at all."""
    from collections import Counter
    from math import log

    rng = np.random.default_rng(4)
    common, rare = [f"w{a}{b}x" for a in "abc" for b in "de"], [f"r{a}{b}x" for a in "abcdefgh" for b in "abcdefgh"]
    texts = [" ".join([*rng.choice(common, 9), "the", "an", *rng.choice(rare, 2), *rng.choice(common, 3)]) for _ in range(60)]
    texts += [None, "", "the", "Www.x.org wadx-WADX http://y.z/wbdx wbex\u00e9wcdx"]
    words = [[w for w in t.split() if w not in ("the", "an")] if t else [] for t in texts]
    words[-2:] = [[], ["wadx", "wadx", "wbex", "wcdx"]]
    terms = [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in words]
    n, d = Counter(t for row in terms for t in row), Counter(t for row in terms for t in set(row))
    fit = sorted((t for t in n if 3 <= d[t] <= 0.9 * len(texts)), key=lambda t: (-n[t], t))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    plans, written = [], topics.written_table
    topics.written_table = lambda df, *a: plans.append(written(df, *a)) or plans[-1]
    try:
        for size in (20, None):
            features, vocabulary = topics.tfidf_features(frame, "text", size, 0.9, 3, ("the", "an"))
            assert vocabulary == fit[:size] and features.columns == ["doc_id", "text", "features"]
            for row in features.collect():
                held = Counter(t for t in terms[row.doc_id] if t in vocabulary)
                wanted = sorted((vocabulary.index(t), c * log((len(texts) + 1) / (d[t] + 1))) for t, c in held.items())
                assert row.features.size == len(vocabulary) and row.features.indices.tolist() == [k for k, _ in wanted]
                assert row.features.values.tolist() == pytest.approx([v for _, v in wanted])
    finally:
        topics.written_table = written
    # What is grouped by term are words alone.
    assert {t for p in plans if "term" in p.columns for t, in p.select("term").collect()} == {w for row in words for w in row}


def test_topic_models_store_blocks(spark):
    """Passes hand on blocks of many rows as bytes, and one pass equals the plain update."""
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T

    from colloquy.operators import lda

    rng = np.random.default_rng(5)
    counts = rng.poisson(0.7, (90, 12)) * 1.5
    counts[7] = 0
    frame = spark.createDataFrame([([int(i) for i in np.flatnonzero(r)], r[r > 0].tolist()) for r in counts], "_indices array<int>, _values array<double>")
    blocks = lda._packed(frame.coalesce(1).filter("size(_indices) > 0"), 5).collect()
    assert len(blocks) == 1 and sum(b["_size"] for b in blocks) == (counts.sum(axis=1) > 0).sum()
    vectors = [(Vectors.sparse(12, np.flatnonzero(r), r[r > 0]),) for r in counts]
    found = lda.fit_topic_models(spark.createDataFrame(vectors, T.StructType().add("features", VectorUDT())), 12, (2, 3), 1)
    counts = counts[counts.sum(axis=1) > 0]
    for (model, _, perplexity), k in zip(found, (2, 3)):
        start = np.random.default_rng([42, k]).gamma(100, 0.01, (k, 12))
        topic, gamma = np.exp(lda._expected_log(start)), np.ones((len(counts), k))
        for _ in range(3000):
            share = np.exp(lda._expected_log(gamma))
            gamma = share * ((counts / (share @ topic)) @ topic.T) + 1 / k
        share = np.exp(lda._expected_log(gamma))
        step = 1025 ** -0.51
        weights = (1 - step) * start + step * (share.T @ (counts / (share @ topic)) * topic + 1 / k)
        assert model.weights == pytest.approx(weights, rel=1e-3) and 0 < perplexity < 10


def test_words_reads_its_text_once(spark):
    from colloquy.functions.text import clean_text, words

    rows = spark.createDataFrame([("",), ("One two",), (" ",), (None,)], "t string")
    plan = rows.select(words(F.regexp_replace("t", "x+", "y")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(t#") == 1
    assert [r[0] for r in rows.select(words(clean_text(F.col("t")))).collect()] == [[], ["one", "two"], [], []]
    assert [r[0] for r in rows.select(words(F.col("t"))).collect()] == [[], ["One", "two"], ["", ""], None]


def test_silhouette_holds_few_distances(spark, monkeypatch):
    from colloquy.operators import clusters

    monkeypatch.setattr(clusters, "DISTANCES", 100)
    rng = np.random.default_rng(3)
    rows = [(rng.normal(c, 1, 2).tolist(), c) for c in (0, 4, 9) for _ in range(40)]
    shapes, plain = [], clusters.squared_distances
    monkeypatch.setattr(clusters, "squared_distances", lambda x, y: shapes.append((len(x), len(y))) or plain(x, y))
    found = clusters.euclidean_silhouette(spark.createDataFrame(rows, "embedding array<double>, cluster int")).first()
    x, c = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    a = np.array([d[i, c == c[i]].sum() / 39 for i in range(len(x))])
    b = np.array([min(d[i, c == o].mean() for o in set(c) if o != c[i]) for i in range(len(x))])
    assert found.silhouette == pytest.approx(((b - a) / np.maximum(a, b)).mean()) and found.silhouette_error == 0
