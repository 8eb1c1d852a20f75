"""Content hashes, record ids and hash-based positions in the unit interval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def record_id(digest: Column) -> Column:
    return F.concat(F.lit("prompt_"), F.substring(digest, 1, 16))


def unit_interval(key: Column) -> Column:
    """First 64 bits of the key's SHA-256 as a double in [0, 1)."""
    bits = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10)
    return bits.cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def assign_split(key: Column, train: float, validation: float) -> Column:
    """train / validation / test by where the key falls in the unit interval."""
    position = unit_interval(key)
    return (
        F.when(position < train, F.lit("train"))
        .when(position < train + validation, F.lit("validation"))
        .otherwise(F.lit("test"))
    )
