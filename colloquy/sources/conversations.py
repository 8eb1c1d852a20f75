"""Conversation records to one row per user prompt.

Nested records (an array of messages per conversation) need no shuffle. Long tables (one row per
message) are numbered with a window whose partitions are blocks of turns, so that one very long
conversation is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.planning import select_once
from colloquy.functions.text import normalize_whitespace
from colloquy.operators.sequences import with_row_number

MESSAGE = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("role", "from", "content", "value")]
)
MESSAGES = T.ArrayType(MESSAGE)
# Columns that name a conversation.
ID_COLUMNS = ("conversation_id", "conversation_hash", "id")
TURNS_PER_BLOCK = 4096


def _field(df: DataFrame, names: tuple[str, ...]) -> Column:
    """First non-blank of the named columns that exist, as a string."""
    present = [F.nullif(F.col(name).cast("string"), F.lit("")) for name in names if name in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def _element_type(df: DataFrame, column: str) -> T.StructType:
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return MESSAGE
    if isinstance(kind, T.StructType):
        kind = kind["messages"].dataType
    return kind.elementType


def _messages(df: DataFrame, column: str) -> Column:
    """The message array, unwrapped from ``{messages: [...]}`` or parsed from a JSON string."""
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, T.StringType):
        wrapped = T.StructType([T.StructField("messages", MESSAGES)])
        is_list = F.ltrim(value).startswith("[")
        return F.when(is_list, F.from_json(value, MESSAGES)).otherwise(
            F.from_json(value, wrapped)["messages"]
        )
    return value["messages"] if isinstance(kind, T.StructType) else value


def _message_field(message: Column, names: tuple[str, ...], present: list[str]) -> Column:
    values = [F.nullif(message[name].cast("string"), F.lit("")) for name in names if name in present]
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def extract_user_prompts(
    records: DataFrame,
    source_dataset: str,
    conversation_column: str = "conversation",
    fallback_prefix: str = "conversation",
    max_conversations: int | None = None,
    sample_size: int | None = None,
    number_records: bool | None = None,
) -> DataFrame:
    """Explode nested conversations into user prompts with turn and message positions.

    ``turn_index`` counts the kept user prompts, ``message_index`` is the position in the message
    list. Where the table has no id column, records are numbered, which reads it twice, and a record's ordinal
    is its id. Where it has one, and with ``number_records=False`` (streams, where rows have no ordinal), a
    record without an id gets a hash of its messages. The limits, which need numbers, keep the first
    records and then the first prompts, as a development aid.
    """
    if number_records is None:
        has_id = any(name in records.columns for name in ID_COLUMNS)
        number_records = not has_id or max_conversations is not None or bool(sample_size)
    element = _element_type(records, conversation_column)
    messages = F.filter(
        F.coalesce(_messages(records, conversation_column), F.array().cast(T.ArrayType(element))),
        lambda m: m.isNotNull(),
    )
    prompts = F.transform(
        messages,
        lambda m, i: F.struct(
            i.cast("long").alias("message_index"),
            _message_field(m, ("role", "from"), element.names).alias("role"),
            normalize_whitespace(_message_field(m, ("content", "value"), element.names)).alias("prompt"),
        ),
    )
    kept = F.filter(prompts, lambda p: (p["role"] == "user") & (p["prompt"] != ""))
    if number_records:
        df, fallback = with_row_number(records, "_ordinal"), F.col("_ordinal").cast("string")
        if max_conversations is not None:
            df = df.filter(F.col("_ordinal") < max_conversations)
    elif max_conversations is not None or sample_size:
        raise ValueError("limits need numbered records")
    else:
        df = records.withColumn("_ordinal", F.lit(0))
        fallback = F.substring(F.sha2(F.to_json(prompts), 256), 1, 16)
    found = df.select(
        "_ordinal",
        F.coalesce(
            _field(df, ID_COLUMNS),
            F.concat(F.lit(f"{fallback_prefix}_"), fallback),
        ).alias("conversation_id"),
        _field(df, ("timestamp", "created_at", "date")).alias("timestamp"),
        _field(df, ("language",)).alias("language"),
        _field(df, ("model",)).alias("model"),
        kept.alias("_kept"),
    )
    rows = select_once(found, found.columns[:-1], {"_kept": F.col("_kept")}).select(
        *found.columns[:-1], F.posexplode("_kept").alias("_turn", "_message")
    ).select(
        "_ordinal",
        "conversation_id",
        F.col("_turn").cast("long").alias("turn_index"),
        F.col("_message.message_index").alias("message_index"),
        F.col("_message.prompt").alias("prompt"),
        "timestamp",
        "language",
        "model",
        F.lit(source_dataset).alias("source_dataset"),
    )
    if sample_size:
        rows = rows.orderBy("_ordinal", "turn_index").limit(int(sample_size))
    return rows.drop("_ordinal")


def extract_long_prompts(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    turns_per_block: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """User prompts of a long message table, numbered within their conversation.

    Numbers are local to a block of turns; prompts in earlier blocks of the conversation are added
    by a join that reuses the window's partitioning. Only conversations with more than one block
    have a row on the right side.
    """
    kept = (
        messages.filter(F.col(role) == "user")
        .select(
            F.col(conversation).alias("conversation_id"),
            F.col(turn).cast("long").alias("message_index"),
            F.floor(F.col(turn) / turns_per_block).alias("_block"),
            normalize_whitespace(F.col(text)).alias("prompt"),
        )
        .filter(F.col("prompt") != "")
    )
    block = W.partitionBy("conversation_id", "_block")
    local = kept.withColumn("_local", F.row_number().over(block.orderBy("message_index")) - 1)
    earlier = W.partitionBy("conversation_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        kept.groupBy("conversation_id", "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.sum("_n").over(earlier))
        .filter(F.col("_offset").isNotNull())
        .select("conversation_id", "_block", "_offset")
    )
    return local.join(offsets, ["conversation_id", "_block"], "left").select(
        "conversation_id",
        (F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))).cast("long").alias("turn_index"),
        "message_index",
        "prompt",
    )
