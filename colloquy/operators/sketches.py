"""Quantiles of values that are no whole numbers, by mergeable sketches (KLL).

A sketch holds a bounded number of values whatever it has seen, so one per partition and group is merged map-side,
stored, and merged again over periods. ``k`` sets the size: a quantile's rank is off by about 2.3 / k^0.9 of
the rows with 99 % confidence, 0.6 % for the default. :func:`rank_errors` measures it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import written_table

SIZE = 800


def rank_bound(k: int = SIZE) -> float:
    """The share of rows by which a quantile's rank is off at most, with 99 % confidence."""
    return 2.3 / k**0.9


def quantile_sketches(df: DataFrame, groups: list[str], value: str, k: int = SIZE) -> DataFrame:
    """``groups``, ``num_records`` and ``sketch``; missing values and NaN are left out."""
    known = df.withColumn("_value", F.col(f"`{value}`").cast("double")).filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
    return known.groupBy(*groups).agg(F.count(F.lit(1)).alias("num_records"), F.kll_sketch_agg_double("_value", k).alias("sketch"))


def merge_sketches(sketches: DataFrame, groups: list[str], k: int = SIZE) -> DataFrame:
    """The sketches of finer groups, such as days, as one per coarser group."""
    return sketches.groupBy(*groups).agg(F.sum("num_records").alias("num_records"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, groups: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """``groups, num_records, q, value``, a row per quantile."""
    found = F.array(*[
        F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("value")) for q in quantiles
    ])
    return sketches.select(*groups, "num_records", F.inline(found))


def rank_errors(df: DataFrame, groups: list[str], value: str, found: DataFrame) -> DataFrame:
    """``found`` with ``rank_error``, how far ``q`` is from the ranks that the value really has.

    Rows meet the quantiles of their group, a handful, and only counts leave the tasks. A sketch decides by chance
    what it forgets, so the quantiles are written and measured as they are.
    """
    found = written_table(found, "sketched-quantiles")
    known = df.withColumn("_value", F.col(f"`{value}`").cast("double")).filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
    listed = found.groupBy(*groups).agg(F.collect_list(F.struct("q", "value")).alias("_found"))
    met = known.join(listed, groups).select(*groups, "_value", F.explode("_found").alias("_f"))
    ranks = met.groupBy(*groups, F.col("_f.q").alias("q")).agg(
        F.avg((F.col("_value") < F.col("_f.value")).cast("double")).alias("_below"),
        F.avg((F.col("_value") <= F.col("_f.value")).cast("double")).alias("_to"),
    )
    error = F.greatest(F.lit(0.0), F.col("_below") - F.col("q"), F.col("q") - F.col("_to"))
    return found.join(ranks, [*groups, "q"]).withColumn("rank_error", error).drop("_below", "_to")


def above_quantile(df: DataFrame, value: str, q: float, k: int = SIZE) -> DataFrame:
    """Rows above the sketched quantile of the whole table."""
    limit = sketch_quantiles(quantile_sketches(df, [], value, k), [], (q,)).select("value").scalar()
    return df.filter(F.col(f"`{value}`") > limit)
