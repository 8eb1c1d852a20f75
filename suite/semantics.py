"""Queries over vectors, drift, clusters and topics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colloquy.functions.arrays import doubles
from colloquy.operators import clusters, drift, embeddings, latent, sampling, search, topics
from colloquy.operators.density import NOISE, density_clusters
from colloquy.session import shared_folder, written_table
from suite.exploration import CLEAN
from suite.inputs import table, text_table
from suite.registry import register

PERIOD = "lpad(CAST(vec_id % 12 + 1 AS VARCHAR), 2, '0')"
LONG = f"""long AS (SELECT vec_id, label, '2023-' || {PERIOD} AS period,
    CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"""


def _vectors(spark, folder):
    rows = table(spark, folder, "embeddings")
    month = F.lpad((F.col("vec_id") % 12 + 1).cast("string"), 2, "0")
    return rows.withColumn("period", F.concat(F.lit("2023-"), month))


def _by_position(df, column: str):
    """Arrays as one row per position, so that values can be compared."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.posexplode(column).alias("i", "v"))


@register(
    "centroids",
    f"""WITH {LONG} SELECT label, count(*) AS num_records, CAST(i AS INTEGER) AS i, avg(v) AS v FROM long GROUP BY label, i""",
    ("v",),
)
def _(spark, folder):
    return _by_position(drift.group_centroids(_vectors(spark, folder), "label"), "centroid")


@register(
    "centroid_drift",
    f"""WITH {LONG}, means AS (SELECT period, i, avg(v) AS m, count(*) AS n FROM long GROUP BY period, i),
    moved AS (SELECT *, lag(period) OVER w AS p0, lag(m) OVER w AS m0, lag(n) OVER w AS n0 FROM means
              WINDOW w AS (PARTITION BY i ORDER BY period))
    SELECT p0 AS from_period, period AS to_period, max(n0) AS from_records, max(n) AS to_records,
           1 - sum(m * m0) / (sqrt(sum(m * m)) * sqrt(sum(m0 * m0))) AS cosine_distance
    FROM moved WHERE p0 IS NOT NULL GROUP BY p0, period""",
    ("cosine_distance",),
)
def _(spark, folder):
    return drift.centroid_drift(drift.group_centroids(_vectors(spark, folder), "period"), "period")


@register(
    "rolling_centroids",
    f"""WITH {LONG}, periods AS (SELECT period, row_number() OVER (ORDER BY period) AS pos FROM (SELECT DISTINCT period FROM long) AS p),
    windows AS (SELECT a.period AS window_start, b.period AS window_end, a.pos AS lo, b.pos AS hi
                FROM periods a JOIN periods b ON b.pos = a.pos + 2)
    SELECT window_start, window_end, count(*) AS num_records, CAST(i AS INTEGER) AS i, avg(v) AS v
    FROM windows JOIN periods p ON p.pos BETWEEN lo AND hi JOIN long USING (period) GROUP BY window_start, window_end, i""",
    ("v",),
)
def _(spark, folder):
    return _by_position(drift.rolling_centroids(_vectors(spark, folder), "period"), "centroid")


@register(
    "cosine_topk",
    """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1)
       SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)) AS similarity
       FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10""",
    ("similarity",),
)
def _(spark, folder):
    vectors = _vectors(spark, folder)
    query = vectors.agg(F.min_by("embedding", "vec_id"))
    return embeddings.cosine_top_k(vectors, query, 10, "vec_id").select("vec_id", "label", "similarity")


@register(
    "embed_documents",
    f"""SELECT doc_id, 256 AS dimensions, CASE WHEN {CLEAN} = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS squared_length FROM documents""",
    ("squared_length",), digits=5,
)
def _(spark, folder):
    """The built-in encoder over all documents: unit vectors, zero where a text has no word."""
    docs = text_table(spark, folder, "documents").select("doc_id", "text")
    return embeddings.embed_prompts(docs, "text", "doc_id").select(
        "doc_id", F.size("embedding").alias("dimensions"),
        F.aggregate(doubles(F.col("embedding")), F.lit(0.0), lambda a, x: a + x * x).alias("squared_length"),
    )


@register(
    "embed_reproducibility",
    """SELECT count(*) AS sample_size, CAST(0 AS DOUBLE) AS max_absolute_difference, TRUE AS is_reproducible FROM documents""",
)
def _(spark, folder):
    docs = text_table(spark, folder, "documents").select("doc_id", "text")
    return embeddings.embedding_reproducibility(docs, "text", "doc_id", sample_size=None)


@register(
    "encoder_comparison",
    """SELECT unnest(['hashed_tfidf', 'latent']) AS model_name, count(*) AS num_records, 64 AS batch_size,
       unnest([256, 64]) AS embedding_dimensions FROM documents""",
)
def _(spark, folder):
    """Two encoders over all documents; their timings differ from run to run and are left out here."""
    docs = text_table(spark, folder, "documents").select("doc_id", "text")
    encoders = {"hashed_tfidf": None, "latent": latent.fit_latent_encoder(docs, "text")}
    return embeddings.compare_encoders(docs, encoders, "text", "doc_id").drop("seconds", "records_per_second")


@register("latent_embeddings")
def _(spark, folder):
    """Latent coordinates of all documents."""
    docs = text_table(spark, folder, "documents").select("doc_id", "text")
    encoded = latent.fit_latent_encoder(docs, "text").transform(docs, "text")
    return encoded.select("doc_id", "embedding")


@register(
    "embed_term_counts",
    f"""SELECT doc_id, CAST(len(list_filter(string_split({CLEAN}, ' '), lambda t: t <> '')) AS DOUBLE) AS term_count FROM documents""",
    ("term_count",),
)
def _(spark, folder):
    """Without weights and unit length, the built-in vector of a text adds up to its number of terms."""
    docs = text_table(spark, folder, "documents").select("doc_id", "text")
    vectors = embeddings.hashed_tfidf(docs, "text", use_idf=False, normalize=False)
    return vectors.select("doc_id", F.aggregate(doubles(F.col("embedding")), F.lit(0.0), lambda a, x: a + x).alias("term_count"))


@register(
    "exact_sample",
    "SELECT event_id, event_type FROM events ORDER BY substr(md5('42:' || event_id), 1, 15), event_id LIMIT 5000",
)
def _(spark, folder):
    """A deterministic sample has the exact size asked for, and the same members in both engines."""
    digest = F.md5(F.concat(F.lit("42:"), F.col("event_id").cast("string")).cast("binary"))
    order = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    sample = sampling.exact_sample(table(spark, folder, "events"), "event_id", 5000, order=order)
    return sample.select("event_id", "event_type")


QUALITY = f"""{LONG}, members AS (SELECT * FROM long WHERE label <> 3),
  means AS (SELECT label, i, avg(v) AS m FROM members GROUP BY label, i),
  overall AS (SELECT i, avg(v) AS m FROM members GROUP BY i),
  sizes AS (SELECT label, count(DISTINCT vec_id) AS n FROM members GROUP BY label),
  dist AS (SELECT vec_id, members.label, sqrt(sum((v - m) * (v - m))) AS d FROM members JOIN means USING (label, i) GROUP BY ALL),
  spread AS (SELECT label, avg(d) AS s, sum(d * d) AS w FROM dist GROUP BY label),
  gaps AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS g
           FROM means a JOIN means b ON a.i = b.i AND a.label <> b.label GROUP BY ALL),
  worst AS (SELECT la, max((x.s + y.s) / g) AS r FROM gaps JOIN spread x ON x.label = la JOIN spread y ON y.label = lb GROUP BY la),
  between_ss AS (SELECT sum(n * (means.m - overall.m) * (means.m - overall.m)) AS b
              FROM means JOIN overall USING (i) JOIN sizes USING (label)),
  vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label <> 3),
  sqpairs AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.e, b.e) ** 2) AS s2, sum(list_distance(a.e, b.e)) AS s1, count(*) AS n
              FROM vec a JOIN vec b ON a.vec_id <> b.vec_id GROUP BY ALL),
  sil AS (SELECT vec_id, max(CASE WHEN label = other THEN s2 / n END) AS a2, min(CASE WHEN label <> other THEN s2 / n END) AS b2,
                 max(CASE WHEN label = other THEN s1 / n END) AS a1, min(CASE WHEN label <> other THEN s1 / n END) AS b1
          FROM sqpairs GROUP BY vec_id)"""


def _labelled(spark, folder):
    """The given labels as clusters, with label 3 as noise."""
    vectors = _vectors(spark, folder)
    return vectors.withColumn("cluster", F.when(F.col("label") == 3, F.lit(-1)).otherwise(F.col("label")))


@register(
    "cluster_quality",
    f"""WITH {QUALITY}
    SELECT (SELECT count(*) FROM embeddings) AS num_records, (SELECT count(*) FROM sizes) AS num_clusters,
           (SELECT avg(CAST(label = 3 AS INTEGER)) FROM embeddings) AS noise_fraction,
           (SELECT avg((b1 - a1) / greatest(a1, b1)) FROM sil) AS silhouette, CAST(0 AS DOUBLE) AS silhouette_error,
           (SELECT avg((b2 - a2) / greatest(a2, b2)) FROM sil) AS silhouette_squared_euclidean,
           (SELECT avg(r) FROM worst) AS davies_bouldin,
           (SELECT b FROM between_ss) / ((SELECT count(*) FROM sizes) - 1)
             / ((SELECT sum(w) FROM spread) / ((SELECT sum(n) FROM sizes) - (SELECT count(*) FROM sizes))) AS calinski_harabasz""",
    ("noise_fraction", "silhouette", "silhouette_error", "silhouette_squared_euclidean", "davies_bouldin", "calinski_harabasz"),
    digits=7,
)
def _(spark, folder):
    return clusters.cluster_quality(_labelled(spark, folder))


SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+"


def _cluster_labels_sql() -> str:
    return rf"""WITH docs AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY doc_id) AS pos
      FROM (SELECT doc_id, text, CASE WHEN lang = 'es' THEN -1 WHEN lang = 'en' THEN 0 WHEN lang = 'fr' THEN 1 ELSE 2 END AS cluster FROM documents) AS c
      WHERE cluster <> -1),
    tokens AS (SELECT cluster, unnest(regexp_split_to_array(lower(text), '{SPACES}')) AS token FROM docs),
    counts AS (SELECT cluster, token, count(*) AS n FROM tokens WHERE length(token) > 3 GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, token) AS rk FROM counts)
    SELECT cluster, (SELECT count(*) FROM docs d WHERE d.cluster = best.cluster) AS num_records,
           string_agg(token, ', ' ORDER BY rk) AS label
    FROM best WHERE rk <= 5 GROUP BY cluster"""


def _language_clusters(spark, folder):
    code = (
        F.when(F.col("lang") == "es", -1).when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    )
    return text_table(spark, folder, "documents").select("doc_id", "text", code.alias("cluster"))


@register("cluster_labels", _cluster_labels_sql())
def _(spark, folder):
    return clusters.label_clusters(_language_clusters(spark, folder), "text")


STOPWORDS = ("the", "and", "of", "to", "der", "die", "und", "les", "des")
TERMS = rf"""docs AS (SELECT doc_id, text, CASE WHEN lang = 'de' THEN -1 WHEN lang = 'en' THEN 0 WHEN lang = 'fr' THEN 1 ELSE 2 END AS topic,
             '2023-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') AS year_month FROM documents),
  words AS (SELECT doc_id, topic, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM docs),
  kept AS (SELECT * FROM words WHERE term NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)})),
  term_counts AS (SELECT topic, term, count(*) AS n, count(DISTINCT doc_id) AS d FROM kept GROUP BY ALL),
  topic_docs AS (SELECT topic, count(*) AS num_records FROM docs GROUP BY topic),
  top AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS rk
          FROM term_counts JOIN topic_docs USING (topic) WHERE topic <> -1 AND d >= CASE WHEN num_records >= 2 THEN 2 ELSE 1 END)"""


def _language_topics(spark, folder):
    code = F.when(F.col("lang") == "de", -1).when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    month = F.concat(F.lit("2023-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"))
    return text_table(spark, folder, "documents").select("doc_id", "text", code.alias("topic"), month.alias("year_month"))


@register(
    "topic_terms",
    f"""WITH {TERMS} SELECT topic, num_records, string_agg(term, ', ' ORDER BY rk) AS top_terms FROM top WHERE rk <= 10 GROUP BY ALL""",
)
def _(spark, folder):
    return topics.top_terms_by_topic(_language_topics(spark, folder), "text", stopwords=STOPWORDS)


@register(
    "topic_statistics",
    f"""WITH {TERMS} SELECT (SELECT count(*) FROM docs) AS num_documents, (SELECT count(DISTINCT topic) FROM docs WHERE topic <> -1) AS num_topics,
        (SELECT avg(CAST(topic = -1 AS INTEGER)) FROM docs) AS noise_fraction,
        (SELECT count(DISTINCT term) / count(*) FROM top WHERE rk <= 10) AS topic_diversity""",
    ("noise_fraction", "topic_diversity"),
)
def _(spark, folder):
    docs = _language_topics(spark, folder)
    return topics.topic_statistics(docs, topics.top_terms_by_topic(docs, "text", stopwords=STOPWORDS))


@register(
    "topic_evolution",
    f"WITH {TERMS} SELECT year_month, topic, count(*) AS \"count\" FROM docs GROUP BY ALL",
)
def _(spark, folder):
    return topics.topic_evolution(_language_topics(spark, folder))


@register(
    "topic_info",
    f"WITH {TERMS} SELECT topic, count(*) AS num_records FROM docs GROUP BY ALL",
)
def _(spark, folder):
    return topics.topic_sizes(_language_topics(spark, folder))


@register(
    "topic_class_tfidf",
    f"""WITH {TERMS}, totals AS (SELECT topic, sum(n) AS total FROM term_counts GROUP BY topic),
    freq AS (SELECT term, sum(n) AS f FROM term_counts GROUP BY term),
    weighted AS (SELECT topic, term, CAST(n AS BIGINT) AS n, n / total * ln(1 + (SELECT avg(total) FROM totals) / f) AS weight
                 FROM term_counts JOIN totals USING (topic) JOIN freq USING (term)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rk FROM weighted)
    SELECT topic, term, n, weight, CAST(rk AS INTEGER) AS rank FROM placed WHERE rk <= 10""",
    ("weight",),
)
def _(spark, folder):
    return topics.class_tfidf(_language_topics(spark, folder), "text", stopwords=STOPWORDS)


@register("pca_reduce")
def _(spark, folder):
    """Two components for every row, the first with the larger variance."""
    reduced = clusters.reduce_dimensions(_vectors(spark, folder))
    return _by_position(reduced.select("vec_id", "reduced"), "reduced")


@register("kmeans_clusters")
def _(spark, folder):
    """The cluster of every row, for both numbers of clusters."""
    vectors = _vectors(spark, folder)
    few, many = (
        clusters.kmeans_clusters(vectors, k).select(F.lit(k).alias("k"), "vec_id", "cluster") for k in (20, 50)
    )
    return few.unionByName(many)


def _with_sizes(assigned, cluster: str):
    """Each row's cluster with its size, and the share of noise among all rows."""
    noise = assigned.agg(F.avg((F.col(cluster) == NOISE).cast("double"))).scalar()
    sizes = assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("cluster_size"))
    return assigned.join(sizes, cluster).withColumn("noise_fraction", noise)


@register("density_clusters")
def _(spark, folder):
    """Clusters of varying density over two principal components."""
    reduced = clusters.reduce_dimensions(_vectors(spark, folder)).select("vec_id", "reduced")
    return _with_sizes(written_table(density_clusters(reduced, "reduced").select("vec_id", "cluster"), "density"), "cluster")


@register("topic_assignment")
def _(spark, folder):
    """Built-in encoder, then clusters of varying density as topics."""
    docs = text_table(spark, folder, "documents").select("doc_id", "text")
    vectors = embeddings.embed_prompts(docs, "text", "doc_id").select("doc_id", "embedding")
    return _with_sizes(written_table(topics.assign_topics(vectors).select("doc_id", "topic"), "topics"), "topic")


@register(
    "metadata_join",
    f"""SELECT vec_id, label, '2023-' || {PERIOD} AS period, len(embedding) AS dimensions,
        list_aggregate(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v), 'sum') AS squared_length FROM embeddings""",
    ("squared_length",),
)
def _(spark, folder):
    """Vectors and metadata stored apart and put together by id."""
    rows = _vectors(spark, folder)
    vectors = written_table(rows.select("vec_id", "embedding"), "vectors")
    metadata = written_table(rows.select("vec_id", "label", "period"), "metadata")
    together = drift.attach_metadata(vectors, metadata, "vec_id")
    squares = F.aggregate(doubles(F.col("embedding")), F.lit(0.0), lambda a, x: a + x * x)
    return together.select("vec_id", "label", "period", F.size("embedding").cast("long").alias("dimensions"), squares.alias("squared_length"))


@register(
    "exact_search",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    pairs AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.e, q.e) AS similarity FROM v JOIN v q ON q.vec_id % 50 = 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM pairs)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, similarity FROM placed WHERE rank <= 10""",
    ("similarity",),
)
def _(spark, folder):
    vectors = _vectors(spark, folder)
    return search.exact_search(vectors, vectors.filter("vec_id % 50 = 0"), 10, "vec_id")


@register("index_search")
def _(spark, folder):
    """The same queries by an inverted-file index over all rows, and its recall against the exact way."""
    vectors = _vectors(spark, folder)
    asked = vectors.filter("vec_id % 50 = 0")
    index = search.build_index(vectors, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", "vec_id")
    found = written_table(search.search_index(index, asked, 10, id_column="vec_id"), "index-found")
    exact = search.exact_search(vectors, asked, 10, "vec_id")
    return found.withColumn("recall", search.recall(found, exact, "vec_id").select("recall").scalar())


def _lda_input(spark, folder):
    docs = text_table(spark, folder, "documents").select("doc_id", "text")
    return topics.tfidf_features(docs, "text", stopwords=STOPWORDS)


@register("lda_sweep")
def _(spark, folder):
    """Likelihood and perplexity of every number of topics; the lowest perplexity is the best."""
    features, _ = _lda_input(spark, folder)
    return topics.lda_sweep(features)[0]


@register("lda_topics")
def _(spark, folder):
    """Fifteen terms for every topic of the best model, the heaviest first."""
    features, vocabulary = _lda_input(spark, folder)
    return topics.lda_topic_words(topics.lda_sweep(features)[1], vocabulary)


@register("lda_categories")
def _(spark, folder):
    """Every document's dominant topic in the best model, and the category that goes with it."""
    features, _ = _lda_input(spark, folder)
    model = topics.lda_sweep(features)[1]
    kinds = ("Task-Based", "Interpersonal", "Intrapersonal")
    named = topics.dominant_topic(model, features, {k: kinds[k % 3] for k in range(model.k)})
    return named.select("doc_id", "dominant_topic", "topic_probability", "prompt_category")
