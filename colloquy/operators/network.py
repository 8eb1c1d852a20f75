"""Co-occurrence network of behaviour signals.

A prompt's signals form a small sorted array. Prompts are first counted per distinct array (there
are few), so nodes and pairs are expanded from combinations, not from rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.planning import select_once
from colloquy.schema import FLAG_COLUMNS, LABEL_COLUMNS

SIGNAL_COLUMNS = ("interaction_mode", "emotion_primary", "cognitive_outsourcing_type", *FLAG_COLUMNS)


def row_signals(df: DataFrame) -> Column:
    """``column:value`` for labels other than none, the bare column name for true flags; sorted."""
    parts = []
    for name in SIGNAL_COLUMNS:
        if name not in df.columns:
            continue
        if isinstance(df.schema[name].dataType, T.BooleanType):
            parts.append(F.when(F.col(name), F.lit(name)))
        else:
            value = F.col(name).cast("string")
            parts.append(F.when(~value.isin("none", "<NA>"), F.concat(F.lit(f"{name}:"), value)))
    if not parts:
        raise ValueError("no signal column found")
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*parts))))


def signal_combinations(df: DataFrame) -> DataFrame:
    """``signals, n``: how many prompts show exactly this set of signals."""
    marked = select_once(df, [], {"signals": row_signals(df)})
    return marked.groupBy("signals").agg(F.count(F.lit(1)).alias("n"))


def network_edges(combinations: DataFrame) -> DataFrame:
    """``source, target, weight`` with source < target."""
    def partners(signal: Column, i: Column) -> Column:
        return F.transform(
            F.slice("signals", i + 2, F.greatest(F.size("signals") - i - 1, F.lit(0))),
            lambda other: F.struct(signal.alias("source"), other.alias("target")),
        )

    pairs = combinations.select("n", F.explode(F.flatten(F.transform("signals", partners))).alias("_p"))
    return pairs.groupBy("_p.source", "_p.target").agg(F.sum("n").alias("weight"))


def network_nodes(combinations: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, count, degree_centrality``; a lone node has centrality 1, isolated nodes 0."""
    nodes = combinations.select("n", F.explode("signals").alias("node")).groupBy("node").agg(
        F.sum("n").alias("count")
    )
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    degrees = ends.groupBy("node").agg(F.count(F.lit(1)).alias("_degree"))
    total = nodes.agg(F.count(F.lit(1))).scalar()
    centrality = F.when(total == 1, F.lit(1.0)).otherwise(
        F.try_divide(F.coalesce("_degree", F.lit(0)).cast("double"), (total - 1).cast("double"))
    )
    return nodes.join(degrees, "node", "left").select(
        "node", "count", centrality.alias("degree_centrality")
    )


def behavior_network(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the co-occurrence network."""
    combinations = signal_combinations(df)
    edges = network_edges(combinations)
    return network_nodes(combinations, edges), edges


def top_edges(edges: DataFrame, n: int = 30) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "source", "target").limit(n)


__all__ = [
    "LABEL_COLUMNS", "SIGNAL_COLUMNS", "behavior_network", "network_edges", "network_nodes",
    "row_signals", "signal_combinations", "top_edges",
]
