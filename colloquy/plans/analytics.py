"""Classified prompts to trends, transitions, archetypes, network and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.operators import archetypes, events, network, temporal, trendtests
from colloquy.session import use_utc
from colloquy.settings import AnalyticsSettings
from colloquy.sources.files import load_prompts, read_dataset, write_dataset
from colloquy.sources.runlog import RunClock, append_record, run_record


def temporal_tables(classified: DataFrame, settings: AnalyticsSettings) -> dict[str, DataFrame]:
    trends = temporal.behavior_trends(
        classified, settings.time_column, settings.rolling_window, settings.id_column
    )

    def transitions(state: str) -> DataFrame:
        return temporal.transition_matrix(
            classified, state, settings.conversation_column, settings.turn_column, settings.id_column
        )

    return {
        "behavior_trends": trends,
        "interaction_transitions": transitions("interaction_mode"),
        "emotion_transitions": transitions("emotion_primary"),
        "trend_statistics": trendtests.trend_statistics(trends, settings.time_column),
    }


def run_analytics(
    spark: SparkSession, classified_path: str, folder: str, settings: AnalyticsSettings = AnalyticsSettings(),
    max_records: int | None = None, record_path: str | None = None,
) -> DataFrame:
    """Write every analysis under ``folder``; branches are independent scans of the same table."""
    use_utc(spark)
    clock = RunClock()
    classified = load_prompts(
        read_dataset(spark, classified_path), (settings.id_column, settings.conversation_column),
        limit=max_records,
    )
    assignments_path = f"{folder}/archetype_assignments.parquet"
    write_dataset(archetypes.discover_archetypes(classified, settings), assignments_path)
    assigned = read_dataset(spark, assignments_path)
    nodes, edges = network.behavior_network(classified)
    tables = {
        **temporal_tables(classified, settings),
        "archetype_summary": archetypes.summarize_archetypes(assigned, settings.conversation_column),
        "network_nodes": nodes,
        "network_edges": edges,
    }
    if "timestamp" in classified.columns:
        tables["event_windows"] = events.event_windows(classified, settings.events)
    for name, table in tables.items():
        write_dataset(table, f"{folder}/{name}.parquet")
    record = run_record(
        classified, "analytics", classified.count(), clock.seconds(), classified_path=classified_path,
        tables=sorted([*tables, "archetype_assignments"]),
    )
    if record_path:
        append_record(record, record_path)
    return record
