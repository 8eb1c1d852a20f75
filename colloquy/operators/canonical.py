"""Raw prompts to the canonical prompt table, and its quality filters.

The work is split in two selects: the columns that filters and deduplication need, and the columns
derived from the text alone. The plan in :mod:`colloquy.plans.prompts` runs the second one after
deduplication, so the shuffle carries no derived columns and no dropped text is analysed.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import hashing, text
from colloquy.functions.bloom import bits_for, may_contain
from colloquy.functions.planning import select_once
from colloquy.operators.sequences import with_row_number
from colloquy.schema import CANONICAL_COLUMNS, first_existing, require_one_of
from colloquy.session import written_table
from colloquy.settings import CanonicalSettings

UNITS_PER_SECOND = {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}
ORDER = ("conversation_id", "turn_index")
BROADCAST_ROWS = 200_000


def parse_timestamp(column: Column, kind: T.DataType, unit: str = "ns") -> Column:
    """UTC timestamp; unreadable text becomes null. Numbers count ``unit`` since the epoch."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column.cast("timestamp")
    if isinstance(kind, T.NumericType):
        seconds = column.cast("decimal(38,9)") / F.lit(UNITS_PER_SECOND[unit])
        return F.timestamp_seconds(seconds)
    return F.try_to_timestamp(column)


def base_columns(
    raw: DataFrame, source_dataset: str, settings: CanonicalSettings = CanonicalSettings(),
    cleaned_at: str | None = None,
) -> DataFrame:
    """Resolve source columns by candidate names and build what filters and deduplication need."""
    names = raw.columns
    prompt = require_one_of(names, settings.text_columns, "prompt text")
    when = first_existing(names, settings.timestamp_columns)
    conversation = first_existing(names, settings.conversation_columns)
    turn = first_existing(names, settings.turn_columns)
    language = first_existing(names, settings.language_columns)
    if turn is None:
        raw, turn = with_row_number(raw, "_turn"), "_turn"

    null_string = F.lit(None).cast("string")
    timestamp = (
        parse_timestamp(F.col(when), raw.schema[when].dataType, settings.timestamp_unit)
        if when else F.lit(None).cast("timestamp")
    )
    turn_kind = raw.schema[turn].dataType
    turn_value = F.col(turn).try_cast("double").try_cast("long") if isinstance(
        turn_kind, T.StringType) else F.col(turn).cast("long")
    sources = raw.select(
        F.col(prompt).alias("_prompt"),
        (F.col(conversation).cast("string") if conversation else null_string).alias("_conversation"),
        turn_value.alias("turn_index"),
        timestamp.alias("timestamp"),
        (F.col(language).cast("string") if language else null_string).alias("language_original"),
    )
    normalized = select_once(
        sources, sources.columns[1:], {"prompt_text": text.normalize_whitespace(F.col("_prompt"))}
    )
    hashed = normalized.withColumn("raw_text_hash", text_hash_column())
    short_hash = F.substring("raw_text_hash", 1, 16)
    known = F.col("_conversation") if conversation else F.concat(F.lit("conversation_"), short_hash)
    detected = text.detect_language(F.col("prompt_text"))
    label = text.normalize_language_label(F.col("language_original")) if language else detected
    stamp = cleaned_at or datetime.now(UTC).isoformat()
    base = hashed.select(
        "prompt_text",
        "raw_text_hash",
        known.alias("conversation_id"),
        "turn_index",
        "timestamp",
        F.lit(source_dataset).alias("source_dataset"),
        text.char_count(F.col("prompt_text")).alias("prompt_length"),
        text.word_count(F.col("prompt_text")).alias("prompt_word_count"),
        "language_original",
        label.alias("language"),
        F.lit(stamp).alias("cleaned_at"),
    ).withColumn("is_short_prompt", F.col("prompt_word_count") < settings.min_prompt_words)
    return base if language else base.withColumn("language_detected", F.col("language"))


def text_hash_column() -> Column:
    return hashing.text_hash(F.col("prompt_text"))


def derived_columns(base: DataFrame) -> DataFrame:
    """Add calendar parts, text flags, scores and placeholders; the result is in canonical order."""
    prompt, when = F.col("prompt_text"), F.col("timestamp")
    null_string = F.lit(None).cast("string")
    flagged = base.withColumns(
        {
            "has_question": text.has_question(prompt),
            "contains_code": text.contains_code(prompt),
        }
    )
    if "language_detected" not in base.columns:
        flagged = flagged.withColumn("language_detected", text.detect_language(prompt))
    if "is_length_outlier" not in base.columns:
        flagged = flagged.withColumn("is_length_outlier", F.lit(False))
    return flagged.withColumns(
        {
            "record_id": hashing.record_id(F.col("raw_text_hash")),
            "date": F.to_date(when),
            "year": F.year(when),
            "month": F.month(when),
            "year_month": F.date_format(when, "yyyy-MM"),
            "complexity_score": text.complexity_proxy(
                F.col("prompt_length"), F.col("prompt_word_count"),
                F.col("has_question"), F.col("contains_code"),
            ),
            "disclosure_score": F.lit(0.0),
            "dependency_score": F.lit(0.0),
            "interaction_type": null_string,
            "semantic_cluster": null_string,
            "emotion_scores": F.lit(None).cast("map<string,double>"),
        }
    ).select(*CANONICAL_COLUMNS)


def normalize_records(
    raw: DataFrame, source_dataset: str, settings: CanonicalSettings = CanonicalSettings(),
    cleaned_at: str | None = None,
) -> DataFrame:
    """One select from raw rows to the 27 canonical columns."""
    return derived_columns(base_columns(raw, source_dataset, settings, cleaned_at))


def keep_first(df: DataFrame, keys: list[str], order: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per key: the first in ``order``, remaining columns breaking ties.

    Two passes over ``df``, which must give the same rows twice. The first counts rows by key and order
    columns alone and writes the keys that repeat, each with its first place. The second lets rows of all
    other keys pass where they are. Up to ``broadcast_rows`` repeated keys, counted before, are broadcast;
    beyond that a Bloom filter of fixed size lets the rest pass and only what may repeat is joined. Rows
    are compared as a whole only where several are first. Null order values come last.
    """
    place = F.struct(*[part for name in order for part in (F.col(name).isNull().alias(f"_null_{name}"), F.col(name))])
    first = place if order else F.struct(F.lit(0).alias("_none"))
    places = df.select(*keys, first.alias("_place")).groupBy(*keys, "_place").agg(F.count(F.lit(1)).alias("_n"))
    repeated = places.groupBy(*keys).agg(F.sum("_n").alias("_rows"), F.min(F.struct("_place", "_n")).alias("_first"))
    repeated = written_table(
        repeated.filter("_rows > 1").select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_first"), "repeated-keys"
    )
    n = repeated.count()
    if n == 0:
        return df
    match = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    if n <= broadcast_rows:
        straight, joined = None, df.join(F.broadcast(repeated), match, "left")
    else:
        hashed = repeated.withColumn("_hash", F.xxhash64(*[f"_key{i}" for i in range(len(keys))]))
        maybe = may_contain(hashed, "_hash", bits_for(n), F.xxhash64(*keys))
        straight, joined = df.filter(~maybe), df.filter(maybe).join(repeated, match, "left")
    kept = joined.filter(F.col("_first").isNull() | (first == F.col("_first._place")))
    out = kept.filter(F.coalesce(F.col("_first._n"), F.lit(1)) == 1).select(*df.columns)
    if not repeated.filter("_first._n > 1").isEmpty():
        out = out.unionByName(_least(kept.filter("_first._n > 1").select(*df.columns), keys))
    return out if straight is None else out.unionByName(straight)


def _least(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the least by its other columns; maps have no order, so they travel as their entries."""
    maps = {f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)}
    rest = [F.map_entries(n).alias(n) if n in maps else F.col(n) for n in df.columns if n not in keys]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest, F.lit(0).alias("_none"))).alias("_first"))

    def restore(name: str) -> Column:
        if name in keys:
            return F.col(name)
        value = F.col(f"_first.{name}")
        return (F.map_from_entries(value) if name in maps else value).alias(name)

    return picked.select(*[restore(name) for name in df.columns])


def quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Exact linear-interpolated quantile of a whole-number column as a one-row frame.

    Only the histogram reaches the last step: for word counts at most one entry per length.
    """
    histogram = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return histogram.agg(F.percentile(column, F.lit(q), F.col("_n")).alias("threshold"))


def apply_row_filters(df: DataFrame, settings: CanonicalSettings) -> DataFrame:
    kept = df.filter(F.col("prompt_length") >= settings.min_prompt_chars)
    if settings.remove_short_prompts:
        kept = kept.filter(~F.col("is_short_prompt"))
    wanted = settings.language_filter
    if wanted.enabled:
        kept = kept.filter(
            F.array_contains(
                F.array(*[text.normalize_language_label(F.lit(v)) for v in wanted.include]),
                F.col("language"),
            )
        )
    return kept


def flag_length_outliers(df: DataFrame, settings: CanonicalSettings) -> DataFrame:
    """Mark prompts longer (in words) than the quantile of the frame itself."""
    if not settings.flag_long_prompts:
        return df
    threshold = quantile(df, "prompt_word_count", settings.long_prompt_quantile).scalar()
    flagged = df.withColumn(
        "is_length_outlier", F.coalesce(F.col("prompt_word_count") > threshold, F.lit(False))
    )
    return flagged.filter(~F.col("is_length_outlier")) if settings.remove_long_prompts else flagged


def filter_records(df: DataFrame, settings: CanonicalSettings = CanonicalSettings()) -> DataFrame:
    """Row filters, then deduplication by text hash, then the length-outlier flag."""
    kept = apply_row_filters(df, settings)
    if settings.drop_duplicates:
        kept = keep_first(kept, ["raw_text_hash"], list(ORDER))
    return flag_length_outliers(kept, settings)
