"""Canonical prompts to vectors, drift, clusters and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import clusters, drift, embeddings, topics
from colloquy.operators.density import density_clusters
from colloquy.operators.sampling import exact_sample
from colloquy.session import use_utc
from colloquy.settings import ClusterSettings
from colloquy.sources.files import read_dataset, write_dataset
from colloquy.sources.runlog import RunClock, append_record, run_record


def run_embeddings(
    spark: SparkSession, input_path: str, output_path: str, text_column: str = "prompt_text",
    id_column: str = "record_id", factory: embeddings.EncoderFactory | None = None,
    model_name: str = "hashed_tfidf", normalize: bool = True, record_path: str | None = None,
) -> DataFrame:
    """Encode all prompts and write vectors with their metadata in one table."""
    use_utc(spark)
    clock = RunClock()
    prompts = read_dataset(spark, input_path)
    encoded = embeddings.embed_prompts(prompts, text_column, id_column, factory, normalize=normalize)
    write_dataset(encoded, output_path)
    written = read_dataset(spark, output_path)
    rows, size = written.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    record = run_record(
        written, "embeddings", rows, clock.seconds(), model_name=model_name, input_path=input_path,
        output_path=output_path, embedding_dimensions=size, normalized=normalize,
        text_column=text_column, id_column=id_column,
    )
    if record_path:
        append_record(record, record_path)
    return record


def search(
    vectors: DataFrame, query_text: str, encoder: embeddings.Encoder, k: int = 10,
    id_column: str = "record_id",
) -> DataFrame:
    """Encode one query on the driver and return the nearest prompts with their metadata."""
    return embeddings.cosine_top_k(vectors, list(map(float, encoder([query_text])[0])), k, id_column)


def drift_tables(vectors: DataFrame, period: str = "year_month", window: int = 3) -> dict[str, DataFrame]:
    centroids = drift.group_centroids(vectors, period)
    return {
        "drift_centroids": centroids,
        "drift_metrics": drift.centroid_drift(centroids, period),
        "rolling_centroids": drift.rolling_centroids(vectors, period, window),
    }


def run_clustering(
    spark: SparkSession, vectors_path: str, folder: str, settings: ClusterSettings = ClusterSettings(),
    text_column: str = "prompt_text", id_column: str = "record_id",
) -> DataFrame:
    """Sample, reduce, cluster, label and measure; returns the quality table."""
    sample_path = f"{folder}/reduced_sample.parquet"
    sample = exact_sample(read_dataset(spark, vectors_path), id_column, settings.sample_size, settings.seed)
    write_dataset(clusters.reduce_dimensions(sample), sample_path)
    reduced = read_dataset(spark, sample_path)
    methods = {
        "density": density_clusters(
            reduced, "reduced", "cluster", settings.min_cluster_size, settings.min_samples, seed=settings.seed,
        ),
        **{f"kmeans_{k}": clusters.kmeans_clusters(reduced, k, "reduced", seed=settings.seed)
           for k in settings.kmeans_k},
    }
    quality = None
    for name, assigned in methods.items():
        path = f"{folder}/assignments_{name}.parquet"
        write_dataset(assigned, path)
        written = read_dataset(spark, path)
        row = clusters.cluster_quality(written, "reduced").withColumn("method", F.lit(name))
        quality = row if quality is None else quality.unionByName(row)
        if name == "density":
            write_dataset(
                clusters.label_clusters(written, text_column),
                f"{folder}/cluster_labels.parquet",
            )
    write_dataset(quality, f"{folder}/cluster_quality.parquet")
    return read_dataset(spark, f"{folder}/cluster_quality.parquet")


def run_topics(
    spark: SparkSession, vectors_path: str, folder: str, min_topic_size: int = 50, min_samples: int = 10,
    text_column: str = "prompt_text", top_n: int = 10,
) -> DataFrame:
    """Assign topics to all prompts, write terms and evolution; returns the one-row statistics."""
    assigned_path = f"{folder}/topic_assignments.parquet"
    write_dataset(
        topics.assign_topics(read_dataset(spark, vectors_path), min_topic_size=min_topic_size, min_samples=min_samples), assigned_path
    )
    assigned = read_dataset(spark, assigned_path)
    terms_path = f"{folder}/topic_top_terms.parquet"
    write_dataset(topics.top_terms_by_topic(assigned, text_column, top_n=top_n), terms_path)
    write_dataset(topics.class_tfidf(assigned, text_column), f"{folder}/topic_class_tfidf.parquet")
    write_dataset(topics.topic_sizes(assigned), f"{folder}/topic_info.parquet")
    if "year_month" in assigned.columns:
        write_dataset(topics.topic_evolution(assigned), f"{folder}/topic_evolution.parquet")
    statistics = topics.topic_statistics(assigned, read_dataset(spark, terms_path))
    write_dataset(statistics, f"{folder}/topic_validation.parquet")
    return read_dataset(spark, f"{folder}/topic_validation.parquet")
