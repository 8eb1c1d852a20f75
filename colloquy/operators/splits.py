"""Deterministic train / validation / test assignment by conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.hashing import assign_split
from colloquy.settings import SplitSettings


def assign_splits(df: DataFrame, settings: SplitSettings = SplitSettings()) -> DataFrame:
    """Add ``data_split``. Rows without a conversation are placed by their record id."""
    if not settings.enabled:
        return df.withColumn("data_split", F.lit(None).cast("string"))
    if round(settings.train + settings.validation + settings.test, 6) != 1.0:
        raise ValueError("split ratios must add up to 1")
    key = F.coalesce("conversation_id", "record_id")
    return df.withColumn("data_split", assign_split(key, settings.train, settings.validation))
