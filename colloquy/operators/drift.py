"""Centroids per period, their movement, and rolling centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.arrays import cosine_distance, divide, doubles, vector_mean, vector_sum
from colloquy.schema import require_columns


def group_centroids(vectors: DataFrame, group: str, vector_column: str = "embedding") -> DataFrame:
    """``group, num_records, centroid``. Partial sums are built map-side, so hot groups are cheap."""
    require_columns(vectors.columns, [group, vector_column], "centroids")
    return vectors.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("num_records"),
        vector_mean(doubles(F.col(vector_column))).alias("centroid"),
    )


def attach_metadata(vectors: DataFrame, metadata: DataFrame, id_column: str = "record_id") -> DataFrame:
    """Vectors and metadata belong together by id, never by row position."""
    return vectors.join(metadata, id_column)


def centroid_drift(centroids: DataFrame, period: str) -> DataFrame:
    """Cosine distance between each period's centroid and the one before (one row per period)."""
    ordered = W.orderBy(period)
    previous = {c: F.lag(c).over(ordered) for c in (period, "num_records", "centroid")}
    moved = centroids.select(
        previous[period].alias("from_period"),
        F.col(period).alias("to_period"),
        previous["num_records"].alias("from_records"),
        F.col("num_records").alias("to_records"),
        previous["centroid"].alias("_from"),
        F.col("centroid").alias("_to"),
    ).filter(F.col("from_period").isNotNull())
    return moved.withColumn("cosine_distance", cosine_distance(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def rolling_centroids(
    vectors: DataFrame, period: str, window: int = 3, vector_column: str = "embedding"
) -> DataFrame:
    """Record-weighted centroid of every full window of consecutive periods.

    Vector sums and counts are taken per period first; the window then adds a handful of vectors
    per output row.
    """
    sums = vectors.filter(F.col(period).isNotNull()).groupBy(period).agg(
        F.count(F.lit(1)).alias("_n"), vector_sum(doubles(F.col(vector_column))).alias("_sum")
    )
    frame = W.orderBy(period).rowsBetween(1 - window, 0)
    windowed = sums.select(
        F.min(period).over(frame).alias("window_start"),
        F.col(period).alias("window_end"),
        F.sum("_n").over(frame).alias("num_records"),
        F.count(F.lit(1)).over(frame).alias("_periods"),
        F.collect_list("_sum").over(frame).alias("_sums"),
    ).filter(F.col("_periods") == window)
    added = F.aggregate(
        F.slice("_sums", 2, window), F.get("_sums", F.lit(0)),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
    )
    return windowed.select(
        "window_start", "window_end", "num_records",
        divide(added, F.col("num_records")).alias("centroid"),
    )
