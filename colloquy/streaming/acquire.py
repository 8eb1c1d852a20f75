"""Incremental acquisition: conversation files to prompt rows, and on to classified prompts.

Each micro-batch picks up the files that arrived since the checkpoint. Extraction and classification are
stateless projections. :func:`first_seen` remembers conversations, so that one that arrives again in another
file is taken once, and :func:`write_partial_sums` keeps sums per batch that are merged when they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from colloquy.operators.canonical import normalize_records
from colloquy.operators.classify import add_complexity_metrics, add_rule_columns
from colloquy.settings import CanonicalSettings
from colloquy.sources.conversations import MESSAGES, extract_user_prompts

CONVERSATION_SCHEMA = T.StructType(
    [
        T.StructField("conversation_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("conversation", MESSAGES),
    ]
)


def stream_conversations(
    spark: SparkSession, folder: str, schema: T.StructType = CONVERSATION_SCHEMA,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """JSON-lines files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(folder)


def first_seen(records: DataFrame, id_column: str = "conversation_id", event_time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Each conversation once, over all batches; records without an id are told apart by their content.

    The state holds one key per conversation. With ``event_time`` a key is forgotten ``delay`` after it, and
    records that are later than that are dropped, which bounds the state.
    """
    content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns])), 256)
    keyed = records.withColumn("_seen", F.coalesce(F.col(f"`{id_column}`").cast("string"), F.concat(F.lit("content:"), content)))
    if event_time is None:
        return keyed.dropDuplicates(["_seen"]).drop("_seen")
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_seen"]).drop("_seen")


def write_partial_sums(
    df: DataFrame, output: str, checkpoint: str, groups: list[str], sums: dict[str, Column]
) -> StreamingQuery:
    """Per micro-batch, the sums of its own rows by ``groups``; a batch that runs again replaces its part."""

    def add(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(*groups).agg(*[F.sum(value).alias(name) for name, value in sums.items()])
        part.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return (
        df.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )


def merged_sums(spark: SparkSession, output: str, groups: list[str], sums: list[str]) -> DataFrame:
    """The sums of all batches: what one pass over everything that ever arrived would give."""
    return spark.read.parquet(output).groupBy(*groups).agg(*[F.sum(name).alias(name) for name in sums])


def stream_prompts(records: DataFrame, source_dataset: str) -> DataFrame:
    """Prompt rows of streamed conversations (no record numbers on a stream)."""
    return extract_user_prompts(records, source_dataset, number_records=False)


def stream_classified(
    prompts: DataFrame, source_dataset: str, settings: CanonicalSettings = CanonicalSettings()
) -> DataFrame:
    """Canonical columns, rule labels and complexity metrics for streamed prompts."""
    canonical = normalize_records(prompts, source_dataset, settings)
    return add_complexity_metrics(add_rule_columns(canonical, normalized=True), normalized=True)


def write_stream(
    df: DataFrame, output: str, checkpoint: str, file_format: str = "json"
) -> StreamingQuery:
    """Append everything available now and stop; call again to pick up new files."""
    return (
        df.writeStream.format(file_format)
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
