"""Raw prompts or conversations to the canonical, filtered, split prompt table."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from colloquy.operators.canonical import base_columns, derived_columns, filter_records
from colloquy.operators.splits import assign_splits
from colloquy.session import use_utc
from colloquy.settings import CanonicalSettings, SplitSettings
from colloquy.sources.files import read_dataset, write_dataset, write_split_outputs
from colloquy.sources.runlog import RunClock, append_record, counts_as_dict, observed_rows, run_record


def canonical_prompts(
    raw: DataFrame, source_dataset: str, settings: CanonicalSettings = CanonicalSettings(),
    splits: SplitSettings = SplitSettings(), cleaned_at: str | None = None,
) -> DataFrame:
    """One lazy plan with one shuffle of prompt text (deduplication).

    Filters come before the shuffle, text analysis after it, and the length threshold is a subquery
    over the same exchange.
    """
    kept = filter_records(base_columns(raw, source_dataset, settings, cleaned_at), settings)
    return assign_splits(derived_columns(kept), splits)


def run_prompts(
    spark: SparkSession, input_path: str, output_path: str, source_dataset: str | None = None,
    settings: CanonicalSettings = CanonicalSettings(), splits: SplitSettings = SplitSettings(),
    split_folder: str | None = None, record_path: str | None = None,
) -> DataFrame:
    """Read, normalize, filter, split and write; returns the run record."""
    use_utc(spark)
    clock = RunClock()
    raw = read_dataset(spark, input_path)
    counted, seen = observed_rows(raw, "raw_rows")
    label = source_dataset or PurePosixPath(input_path).stem
    write_dataset(canonical_prompts(counted, label, settings, splits), output_path)
    processed = read_dataset(spark, output_path)
    outputs = write_split_outputs(processed, split_folder) if split_folder and splits.enabled else {}
    kept = processed.count()
    total = seen.get["rows"]
    record = run_record(
        processed, "prompts", kept, clock.seconds(), input_path=input_path, output_path=output_path,
        source_dataset=label, raw_rows=total, processed_rows=kept, dropped_rows=total - kept,
        split_counts=counts_as_dict(processed, "data_split"),
        language_counts=counts_as_dict(processed, "language"), split_outputs=outputs,
        columns=processed.columns,
    )
    if record_path:
        append_record(record, record_path)
    return record


def regenerate_splits(
    spark: SparkSession, input_path: str, folder: str, splits: SplitSettings = SplitSettings()
) -> dict[str, int]:
    """Assign splits anew and rewrite the partitioned outputs; returns rows per split."""
    df = read_dataset(spark, input_path)
    placed = assign_splits(df.drop("data_split"), splits)
    write_split_outputs(placed, folder)
    return counts_as_dict(spark.read.parquet(folder), "data_split")
