"""Deterministic samples of an exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_BITS = 16


def exact_sample(
    df: DataFrame, id_column: str, n: int | None, seed: int = 42, order: Column | None = None
) -> DataFrame:
    """The ``n`` rows with the smallest seeded id hash (all rows when ``n`` is None or too large).

    ``order`` replaces the hash by another 64-bit number of the id that is spread evenly.

    A histogram of the leading hash bits finds the bucket that holds the n-th smallest hash. Only
    rows up to it enter the final top-n, so large samples of large tables do not pass n rows per
    task to the last step.
    """
    if n is None:
        return df
    hashed = F.xxhash64(F.lit(seed), F.col(id_column)) if order is None else order
    bucket = F.shiftright(hashed, 64 - BUCKET_BITS)
    cumulative = (
        df.groupBy(bucket.alias("_bucket"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(W.orderBy("_bucket")))
    )
    last = cumulative.filter(F.col("_upto") >= n).agg(F.min("_bucket")).scalar()
    near = df.withColumn("_hash", hashed).filter(
        bucket <= F.coalesce(last, F.lit(2 ** (BUCKET_BITS - 1)))
    )
    return near.orderBy("_hash", id_column).limit(int(n)).drop("_hash")
