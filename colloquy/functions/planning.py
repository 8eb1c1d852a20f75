"""Hints to the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_once(df: DataFrame, untouched: list[str], computed: dict[str, Column] | list[str]) -> DataFrame:
    """Select columns whose expressions the optimizer must not copy.

    A filter on a computed column is normally rewritten in terms of its inputs and moved below the
    projection, which evaluates the expression again, once per mention; over chained projections the
    copies multiply. A projection with a random column is left where it is, so the computed columns
    travel in a struct next to one. A list names columns of ``df`` itself.
    """
    if isinstance(computed, list):
        packed = F.expr(f"struct({', '.join(f'`{name}`' for name in computed)}, rand(0) AS _random)")
    else:
        packed = F.struct(*[column.alias(name) for name, column in computed.items()], F.rand(0).alias("_random"))
    dropped = [f"`{name}`" for name in df.columns if name not in untouched]
    stars = [f"* EXCEPT ({', '.join([*dropped, '_computed'])})"] if untouched else []
    return df.select("*", packed.alias("_computed")).selectExpr(*stars, "_computed.* EXCEPT (_random)")


def explode_once(df: DataFrame, keep: list[str], values: Column, name: str, outer: bool = False) -> DataFrame:
    """One row per element of an array that is expensive to build.

    Spark drops rows with empty arrays below an explode, by a filter that builds the array again;
    the array is therefore computed in a projection of its own.
    """
    arrays = select_once(df, keep, {"_values": values})
    explode = F.explode_outer if outer else F.explode
    return arrays.select(*keep, explode("_values").alias(name))
