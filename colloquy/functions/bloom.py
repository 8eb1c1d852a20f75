"""A Bloom filter of fixed size as a column expression, for sparing rows a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 26
HASHES = 3


def _places(hashed: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(hashed, F.lit(k)), F.lit(bits)) for k in range(HASHES)]


def bits_for(n: int, most: int = MAX_BITS) -> int:
    """A power of two, ten bits or more per key up to ``most``; beyond that the filter lets more rows pass."""
    return min(most, max(1 << 10, 1 << (10 * max(n, 1)).bit_length()))


def may_contain(keys: DataFrame, hashed: str, bits: int, probe: Column) -> Column:
    """Whether the 64-bit hash ``probe`` may be one of ``keys``; never false for one that is.

    The filter is one row of ``bits / 64`` numbers, at most 8 MB, which reaches every task as a subquery's result.
    """
    place = F.explode(F.array(*_places(F.col(hashed), bits))).alias("_place")
    filled = keys.select(place).select(
        F.floor(F.col("_place") / 64).alias("id"), F.expr("shiftleft(1L, int(_place % 64))").alias("_bit")
    ).groupBy("id").agg(F.bit_or("_bit").alias("_word"))
    words = keys.sparkSession.range(bits // 64).join(filled, "id", "left").select("id", F.coalesce("_word", F.lit(0)).alias("_word"))
    dense = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "_word"))), lambda e: e["_word"])).scalar()
    found = F.lit(True)
    for place in _places(probe, bits):
        word = F.get(dense, F.floor(place / 64).cast("int"))
        shifted = F.call_function("shiftrightunsigned", word, F.pmod(place, F.lit(64)).cast("int"))
        found = found & (shifted.bitwiseAND(F.lit(1)) == 1)
    return found
