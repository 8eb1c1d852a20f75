"""Behaviour over time: period trends, rolling means, differences, state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.stats import rate
from colloquy.operators.sequences import count_adjacent_states
from colloquy.schema import FLAG_COLUMNS, require_columns

# Scores with a trend.
SCORE_COLUMNS = (
    "dependency_score", "companionship_score", "vulnerability_score", "anthropomorphism_score",
    "reassurance_seeking_score", "prompt_sophistication_score", "conversational_depth_score",
)


def add_rolling_and_delta(trends: DataFrame, period: str, columns: list[str], window: int) -> DataFrame:
    """Rolling mean over the last ``window`` rows and difference to the previous row.

    The window has no partition key: its input is one row per period.
    """
    ordered = W.orderBy(period)
    recent = ordered.rowsBetween(1 - window, 0)
    added = {}
    for name in columns:
        added[f"{name}_rolling_{window}"] = F.avg(name).over(recent)
        added[f"{name}_delta"] = (F.col(name) - F.lag(name).over(ordered)).cast("double")
    return trends.withColumns(added)


def behavior_trends(
    df: DataFrame, period: str = "year_month", window: int = 3, id_column: str = "record_id"
) -> DataFrame:
    """Rates and mean scores per period with rolling means and differences for every number."""
    require_columns(df.columns, [period, id_column], "behavior trends")
    aggregates = [F.count(id_column).alias("num_records")]
    aggregates += [rate(F.col(c)).alias(f"{c}_rate") for c in FLAG_COLUMNS if c in df.columns]
    aggregates += [F.avg(c).alias(f"mean_{c}") for c in SCORE_COLUMNS if c in df.columns]
    base = df.filter(F.col(period).isNotNull()).groupBy(period).agg(*aggregates)
    return add_rolling_and_delta(base, period, base.columns[1:], window)


def transition_matrix(
    df: DataFrame, state: str, conversation: str = "conversation_id", turn: str = "turn_index",
    tie_break: str | None = "record_id", write_first: bool = False,
) -> DataFrame:
    """Counts and row-wise probabilities of state changes between neighbouring prompts.

    Set ``write_first`` when the states are computed in the same plan.
    """
    require_columns(df.columns, [state, conversation, turn], "transitions")
    present = df.filter(F.col(conversation).isNotNull())
    order: list[Column] = [F.col(turn)]
    if tie_break and tie_break in df.columns:
        order.append(F.col(tie_break))
    counts = count_adjacent_states(present, conversation, order, state, write_first=write_first)
    per_state = W.partitionBy("from_state")
    return counts.select(
        "from_state", "to_state", F.col("n").alias("count"),
        (F.col("n") / F.sum("n").over(per_state)).alias("probability"),
    )


def sort_transitions(matrix: DataFrame) -> DataFrame:
    return matrix.orderBy("from_state", F.desc("count"), "to_state")
