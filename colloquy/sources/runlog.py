"""Run records: what a run read, kept and wrote, as rows that are appended to a table."""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from colloquy.operators.diagnostics import count_by

SCHEMA = (
    "run string, generated_at string, num_records long, elapsed_seconds double, "
    "records_per_second double, details string"
)


class RunClock:
    """Elapsed time of a run; never zero, so that rates are defined."""

    def __init__(self) -> None:
        self._start = time.perf_counter()

    def seconds(self) -> float:
        return max(time.perf_counter() - self._start, 1e-6)


def observed_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows while they flow through the next action, without a job of its own."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


def counts_as_dict(df: DataFrame, column: str, limit: int = 20) -> dict[str, int]:
    """Top counts of a column for the record (at most ``limit`` rows reach the driver)."""
    return {str(row[0]): row[1] for row in count_by(df, column, limit).collect()}


def run_record(df: DataFrame, run: str, num_records: int, seconds: float, **details) -> DataFrame:
    """One row with throughput and free-form details as JSON."""
    rate = num_records / seconds if num_records else 0.0
    row = (run, datetime.now(UTC).isoformat(), num_records, seconds, rate, json.dumps(details, sort_keys=True))
    return df.sparkSession.createDataFrame([row], SCHEMA)


def append_record(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)
