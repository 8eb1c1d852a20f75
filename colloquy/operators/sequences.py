"""Order-dependent helpers that never put one key's rows, or all rows, into a single task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.session import written_table

POSITION_BITS = 33


def with_row_number(df: DataFrame, name: str) -> DataFrame:
    """Consecutive 0-based numbers in partition order.

    ``monotonically_increasing_id`` holds the partition and the position in it. Adding the sizes of
    the partitions before makes it consecutive; that side has one row per partition, which bounds
    its broadcast. It relies on the input giving the same partitions when read twice, so apply it
    to a scan.
    """
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    partition = F.shiftright("_mid", POSITION_BITS)
    sizes = (
        df.select(F.monotonically_increasing_id().alias("_mid"))
        .groupBy(partition.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    position = F.col("_mid").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return (
        tagged.withColumn("_part", partition)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + position)
        .drop("_part", "_mid", "_before")
    )


def top_n_per_group(
    df: DataFrame, groups: list[str], order: list[Column], n: int, spread_by: list[str],
    salts: int = 256,
) -> DataFrame:
    """First ``n`` rows per group, exact, with the rank in ``_rank``.

    Spark already cuts each map task to ``n`` rows per group before the shuffle. Ranking first
    within salted parts of a group keeps what reaches the last ranking at ``n`` rows per salt.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    local = W.partitionBy(*groups, "_salt").orderBy(*order)
    kept = salted.withColumn("_rank", F.row_number().over(local)).filter(F.col("_rank") <= n).drop("_salt")
    final = W.partitionBy(*groups).orderBy(*order)
    return kept.withColumn("_rank", F.row_number().over(final)).filter(F.col("_rank") <= n)


def _count_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count (state, next state) inside one sorted partition and report its two edge rows."""
    schema = pa.schema(
        [
            ("slot", pa.int64()), ("from_state", pa.string()), ("to_state", pa.string()),
            ("n", pa.int64()), ("tail_key", pa.string()), ("tail_state", pa.string()),
            ("head_key", pa.string()), ("head_state", pa.string()),
        ]
    )
    partition, first, last = None, None, None
    for batch in batches:
        known = pc.and_(batch.column(1).is_valid(), batch.column(2).is_valid())
        part, keys, states = (batch.column(i).filter(known) for i in range(3))
        if len(keys) == 0:
            continue
        if first is None:
            partition = part[0].as_py()
            first = (keys[0].as_py(), states[0].as_py())
        else:
            keys = pa.concat_arrays([pa.array([last[0]], keys.type), keys])
            states = pa.concat_arrays([pa.array([last[1]], states.type), states])
        last = (keys[len(keys) - 1].as_py(), states[len(states) - 1].as_py())
        same = pc.equal(keys[:-1], keys[1:])
        pairs = pa.table({"f": states[:-1].filter(same), "t": states[1:].filter(same)})
        counts = pairs.group_by(["f", "t"]).aggregate([([], "count_all")])
        size = counts.num_rows
        empty = pa.nulls(size, pa.string())
        columns = [
            pa.array([-1] * size, pa.int64()), counts["f"].combine_chunks(), counts["t"].combine_chunks(),
            counts["count_all"].combine_chunks(), empty, empty, empty, empty,
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
    if first is not None:
        rows = {
            "slot": [partition, partition - 1], "from_state": [None, None], "to_state": [None, None],
            "n": [0, 0], "tail_key": [last[0], None], "tail_state": [last[1], None],
            "head_key": [None, first[0]], "head_state": [None, first[1]],
        }
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


def count_adjacent_states(
    df: DataFrame, key: str, order: list[Column], state: str, partitions: int | None = None,
    write_first: bool = False,
) -> DataFrame:
    """Counts of (state, next state of the same key) in the given order: ``from_state, to_state, n``.

    Rows without a key or a state are left out before rows are dealt to partitions, so that every
    partition but the last holds a state and the chain of edge rows has no gap.

    Rows are range-partitioned by key *and* order, so a key with very many rows spans many tasks.
    Each task counts its neighbours over Arrow batches. Its last row and the first row of the next
    partition share a slot and are matched afterwards: two rows per partition. Range partitions
    other than the last are never empty, which makes "next partition" well defined. Range bounds are
    sampled from the rows in a pass of their own; ``write_first`` stores the narrow rows for it, which
    pays when states are computed on the fly rather than read from a table: the test for missing states
    would otherwise evaluate them a second time.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = df.select(
        F.col(key).cast("string").alias("_key"), F.col(state).cast("string").alias("_state"),
        *[column.alias(f"_o{i}") for i, column in enumerate(order)],
    )
    if write_first:
        narrow = written_table(narrow, "states")
    narrow = narrow.filter(F.col("_key").isNotNull() & F.col("_state").isNotNull())
    keys = ["_key", *[F.col(f"_o{i}").asc_nulls_last() for i in range(len(order))], "_state"]
    ranged = narrow.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    tagged = ranged.select(F.spark_partition_id().cast("long").alias("_part"), "_key", "_state")
    parts = tagged.mapInArrow(
        _count_neighbours,
        "slot long, from_state string, to_state string, n long, tail_key string, tail_state string, "
        "head_key string, head_state string",
    )
    merged = parts.groupBy("slot", "from_state", "to_state").agg(
        F.sum("n").alias("n"),
        *[F.max(c).alias(c) for c in ("tail_key", "tail_state", "head_key", "head_state")],
    )
    joined = F.col("tail_key") == F.col("head_key")
    return (
        merged.select(
            F.coalesce("from_state", F.when(joined, F.col("tail_state"))).alias("from_state"),
            F.coalesce("to_state", F.when(joined, F.col("head_state"))).alias("to_state"),
            F.when(joined, F.lit(1)).otherwise(F.col("n")).alias("n"),
        )
        .filter(F.col("from_state").isNotNull() & F.col("to_state").isNotNull())
        .groupBy("from_state", "to_state")
        .agg(F.sum("n").cast("long").alias("n"))
    )
