"""Dimension reduction, KMeans, quality metrics and cluster labels; density clusters are in ``density.py``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.arrays import (
    dot, doubles, squared_distance, vector_mean, vector_sum,
)
from colloquy.functions.planning import explode_once
from colloquy.functions.stats import safe_ratio
from colloquy.functions.text import SPACE
from colloquy.operators.density import NOISE
from colloquy.operators.neighbours import _matrix
from colloquy.operators.sequences import top_n_per_group

STAND_INS = 16_384
DISTANCES = 1_000_000  # distances that a task holds at a time


def reduce_dimensions(
    vectors: DataFrame, k: int = 2, vector_column: str = "embedding", output: str = "reduced", fit_on: DataFrame | None = None
) -> DataFrame:
    """First ``k`` principal components as ``array<double>``; ``fit_on`` has the same vectors, stored."""
    vector = array_to_vector(doubles(F.col(vector_column)))
    prepared = vectors.withColumn("_vector", vector)
    model = PCA(k=k, inputCol="_vector", outputCol="_pca").fit(prepared if fit_on is None else fit_on.withColumn("_vector", vector))
    return model.transform(prepared).withColumn(output, vector_to_array("_pca")).drop("_vector", "_pca")


def kmeans_clusters(
    vectors: DataFrame, k: int, vector_column: str = "embedding", output: str = "cluster", seed: int = 42
) -> DataFrame:
    prepared = vectors.withColumn("_vector", array_to_vector(doubles(F.col(vector_column))))
    model = KMeans(k=k, seed=seed, featuresCol="_vector", predictionCol=output).fit(prepared)
    return model.transform(prepared).drop("_vector")


def euclidean_silhouette(
    df: DataFrame, vector_column: str = "embedding", cluster: str = "cluster", stand_ins: int = STAND_INS, seed: int = 42
) -> DataFrame:
    """One row: ``silhouette``, the mean over all rows outside the noise, and ``silhouette_error``, which bounds its error.

    Distances to every row of a cluster are distances to its stand-ins, ``stand_ins`` in all. Rows go to the
    nearest of their cluster's first rows by hash; each such cell counts with its size, mean and spread,
    as sqrt(distance to the mean squared + spread). A row is at most the spread from the mean on average,
    so the bound is twice the average spread, carried through the ratio. A cluster that has no more rows than
    its share is exact. Both are null below two clusters or without more rows than clusters, and where there are
    more clusters than half of ``stand_ins``.
    """
    schema = "silhouette double, silhouette_error double"
    spark = df.sparkSession
    members = df.select(doubles(F.col(vector_column)).alias("_x"), F.col(cluster).cast("long").alias("_c")).filter(
        F.col("_c").isNotNull() & (F.col("_c") != NOISE) & F.col("_x").isNotNull()
    )
    counts = members.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).orderBy("_c").limit(stand_ins // 2 + 1).collect()
    sizes = {r["_c"]: r["n"] for r in counts}
    if not 2 <= len(sizes) <= stand_ins // 2 or sum(sizes.values()) <= len(sizes):
        return spark.createDataFrame([(None, None)], schema)
    order = [F.xxhash64(F.lit(seed), "_x"), F.col("_x")]
    seeds = top_n_per_group(members, ["_c"], order, stand_ins // len(sizes), ["_x"]).select("_c", "_x").toArrow()
    owner, first = np.asarray(seeds.column("_c")), _matrix(seeds.column("_x"))
    sorted_ = np.argsort(owner, kind="stable")
    owner, first = owner[sorted_], first[sorted_]
    centre = first.mean(axis=0)
    first = first - centre
    names = np.array(sorted(sizes))
    total = np.array([sizes[c] for c in names.tolist()], dtype=float)
    width = first.shape[1]

    def cells_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Each row's cell: the nearest first row of its own cluster."""
        out = np.empty(len(x), dtype=np.int64)
        for name in np.unique(c):
            low, high = np.searchsorted(owner, name, side="left"), np.searchsorted(owner, name, side="right")
            rows, step = np.flatnonzero(c == name), max(1, DISTANCES // (high - low))
            for part in (rows[at:at + step] for at in range(0, len(rows), step)):
                out[part] = low + squared_distances(x[part], first[low:high]).argmin(axis=1)
        return out

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weight, squares = np.zeros_like(first), np.zeros(len(first)), np.zeros(len(first))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)) - centre
                cell = cells_of(x, np.asarray(batch.column(1)))
                np.add.at(sums, cell, x)
                weight += np.bincount(cell, minlength=len(first))
                squares += np.bincount(cell, weights=((x - first[cell]) ** 2).sum(axis=1), minlength=len(first))
        used = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(weight[used]), pa.array(squares[used]), pa.array(list(sums[used]), pa.list_(pa.float64()))],
            ["cell", "w", "q", "s"],
        )

    parts = members.mapInArrow(moments, "cell long, w double, q double, s array<double>")
    added = parts.groupBy("cell").agg(F.sum("w").alias("w"), F.sum("q").alias("q"), vector_sum(F.col("s")).alias("s")).orderBy("cell").toArrow()
    used = np.asarray(added.column("cell"))
    weight = np.asarray(added.column("w"))
    mean = _matrix(added.column("s")) / weight[:, None]
    # Squares around a cell's first row, moved to its mean; a cell of one row has no spread.
    spread = np.maximum(np.asarray(added.column("q")) / weight - ((mean - first[used]) ** 2).sum(axis=1), 0.0)
    spread[weight == 1] = 0.0
    place = np.full(len(first), -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    group = np.searchsorted(names, owner[used])
    error = np.bincount(group, weights=2 * weight * np.sqrt(spread), minlength=len(names)) / total
    # Cells are in the order of their clusters, so that a cluster's weighted distances are a run of columns.
    begins = np.searchsorted(group, np.arange(len(names)))
    slice_rows = max(1, DISTANCES // len(used))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, value, bound = 0, 0.0, 0.0
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                rows = batch.slice(start, slice_rows)
                x, c = _matrix(rows.column(0)) - centre, np.searchsorted(names, np.asarray(rows.column(1)))
                distance = np.sqrt(squared_distances(x, mean) + spread)
                sums = np.add.reduceat(distance * weight, begins, axis=1)
                at = np.arange(len(x))
                own = place[cells_of(x, np.asarray(rows.column(1)))]
                a = np.maximum(sums[at, c] - distance[at, own], 0.0) / np.maximum(total[c] - 1, 1)
                means = sums / total
                means[at, c] = np.inf
                other = means.argmin(axis=1)
                b = means[at, other]
                most = np.maximum(a, b)
                s = np.divide(b - a, most, out=np.zeros_like(a), where=most > 0)
                off = error[c] * total[c] / np.maximum(total[c] - 1, 1) + error.max()
                reach = most - off
                wrong = np.where(off == 0, 0.0, np.where(reach > 0, np.minimum(off / np.where(reach > 0, reach, 1.0), 2.0), 2.0))
                single = total[c] == 1
                n, value, bound = n + len(x), value + s[~single].sum(), bound + wrong[~single].sum()
        yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([float(value)]), pa.array([float(bound)])], ["n", "v", "e"])

    found = members.mapInArrow(compared, "n double, v double, e double")
    return found.agg((F.sum("v") / F.sum("n")).alias("silhouette"), (F.sum("e") / F.sum("n")).alias("silhouette_error"))


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0.0)


def cluster_quality(df: DataFrame, vector_column: str = "embedding", cluster: str = "cluster") -> DataFrame:
    """One row: sizes, noise share, Davies–Bouldin, Calinski–Harabasz, Euclidean and squared-Euclidean silhouette.

    The Euclidean silhouette comes with a bound of its error (:func:`euclidean_silhouette`). All other metrics
    are exact and linear in the rows: a first pass gives the cluster means, a second one compares each point
    with those means (one entry per cluster). Noise is left out of the metrics,
    which are null unless there are two clusters and more points than clusters.
    """
    points = df.select(doubles(F.col(vector_column)).alias("_x"), F.col(cluster).alias("_c"))
    members = points.filter(F.col("_c") != NOISE)
    squared = dot(F.col("_x"), F.col("_x"))
    means = members.groupBy("_c").agg(
        F.count(F.lit(1)).alias("n"), vector_mean(F.col("_x")).alias("mean"), F.avg(squared).alias("q")
    )
    table = means.agg(
        F.array_sort(F.collect_list(F.struct(F.col("_c").alias("c"), "n", "mean", "q")))
    ).scalar()
    compared = members.withColumns({"_all": table, "_sq": squared})

    def mean_squared_distance(entry: Column) -> Column:
        """Mean squared distance from the point to all members of the entry's cluster."""
        return F.greatest(F.col("_sq") - dot(F.col("_x"), entry["mean"]) * 2 + entry["q"], F.lit(0.0))

    own = F.get(F.filter("_all", lambda e: e["c"] == F.col("_c")), F.lit(0))
    others = F.transform(F.filter("_all", lambda e: e["c"] != F.col("_c")), mean_squared_distance)
    compared = compared.withColumns({"_own": own, "_b": F.array_min(others)})
    compared = compared.withColumns(
        {
            "_d2": squared_distance(F.col("_x"), F.col("_own.mean")),
            "_a": mean_squared_distance(F.col("_own")) * F.try_divide(F.col("_own.n"), F.col("_own.n") - 1),
        }
    )
    silhouette = F.when(F.col("_own.n") == 1, F.lit(0.0)).otherwise(
        safe_ratio(F.col("_b") - F.col("_a"), F.greatest("_a", "_b"))
    )
    spread = compared.groupBy(F.col("_c").alias("c")).agg(
        F.count(F.lit(1)).alias("n"),
        F.first("_own.mean").alias("mean"),
        F.avg(F.sqrt("_d2")).alias("s"),
        F.sum("_d2").alias("within"),
        F.sum(silhouette).alias("sil"),
    )
    gathered = spread.agg(
        F.count(F.lit(1)).alias("k"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("m"),
        F.sum("within").alias("within"),
        F.sum("sil").alias("sil"),
        F.collect_list(F.struct("c", "n", "mean", "s")).alias("cl"),
    )
    dims = F.size(F.get(F.col("cl"), F.lit(0))["mean"])
    overall = F.transform(
        F.sequence(F.lit(0), dims - 1),
        lambda i: F.aggregate("cl", F.lit(0.0), lambda acc, e: acc + F.get(e["mean"], i) * e["n"]) / F.col("m"),
    )

    def worst(e: Column) -> Column:
        ratios = F.transform(
            F.filter("cl", lambda o: o["c"] != e["c"]),
            lambda o: safe_ratio(e["s"] + o["s"], F.sqrt(squared_distance(e["mean"], o["mean"]))),
        )
        return F.array_max(ratios)

    between = F.aggregate(
        "cl", F.lit(0.0), lambda acc, e: acc + squared_distance(e["mean"], F.col("overall")) * e["n"]
    )
    db = F.aggregate(F.transform("cl", worst), F.lit(0.0), lambda acc, v: acc + v) / F.col("k")
    ch = F.when(F.col("within") == 0, F.lit(1.0)).otherwise(
        safe_ratio(between * (F.col("m") - F.col("k")), F.col("within") * (F.col("k") - 1))
    )
    defined = (F.col("k") >= 2) & (F.col("m") > F.col("k"))
    metrics = gathered.withColumn("overall", F.when(defined, overall)).select(
        F.col("k").alias("num_clusters"),
        F.when(defined, F.col("sil") / F.col("m")).alias("silhouette_squared_euclidean"),
        F.when(defined, db).alias("davies_bouldin"),
        F.when(defined, ch).alias("calinski_harabasz"),
    )
    counts = points.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            safe_ratio(F.count_if(F.col("_c") == NOISE), F.count(F.lit(1))).alias("noise"),
        )
    ).scalar()
    both = F.struct("silhouette", "silhouette_error")
    exact = euclidean_silhouette(df, vector_column, cluster).select(both).scalar()
    return metrics.withColumns({"_t": counts, "_e": exact}).select(
        F.col("_t.n").alias("num_records"), "num_clusters", F.col("_t.noise").alias("noise_fraction"),
        F.col("_e.silhouette").alias("silhouette"), F.col("_e.silhouette_error").alias("silhouette_error"),
        "silhouette_squared_euclidean", "davies_bouldin", "calinski_harabasz",
    )


def label_clusters(
    df: DataFrame, text_column: str = "prompt_text", cluster: str = "cluster",
    top_n: int = 5, min_length: int = 4,
) -> DataFrame:
    """``cluster, num_records, label``: the most frequent longer tokens of the cluster's texts.

    All texts are read. Equal counts are ordered by token.
    """
    assigned = df.filter(F.col(cluster).isNotNull() & (F.col(cluster) != NOISE))
    sizes = assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("num_records"))
    texts = assigned.filter(F.col(text_column).isNotNull()).select(cluster, text_column)
    tokens = F.filter(
        F.split(F.lower(F.col(text_column)), f"{SPACE}+"), lambda t: F.char_length(t) >= min_length
    )
    counts = explode_once(texts, [cluster], tokens, "_token").groupBy(cluster, "_token").agg(
        F.count(F.lit(1)).alias("_n")
    )
    best = top_n_per_group(counts, [cluster], [F.desc("_n"), F.col("_token")], top_n, ["_token"])
    labels = best.groupBy(cluster).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_token"))), lambda e: e["_token"]), ", "
        ).alias("label")
    )
    return sizes.join(labels, cluster, "left").select(
        cluster, "num_records", F.coalesce("label", F.lit("")).alias("label")
    )


__all__ = [
    "NOISE", "cluster_quality", "kmeans_clusters", "label_clusters", "reduce_dimensions",
]
