"""Before/after comparison of behaviour around dated events, all events in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.settings import DEFAULT_EVENTS, EventWindow

# Measures before and after an event.
EVENT_METRICS = (
    "is_companionship", "is_vulnerable", "is_dependency_signal", "is_cognitive_outsourcing",
    "dependency_score", "prompt_sophistication_score", "conversational_depth_score",
)


def _midnight(day: date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp")


def _bounds(event: EventWindow) -> dict[str, tuple[date, date]]:
    """Inclusive midnights. The day before the event only counts up to its 00:00."""
    day = date.fromisoformat(event.date)
    return {
        "before": (day - timedelta(days=event.days_before), day - timedelta(days=1)),
        "after": (day, day + timedelta(days=event.days_after)),
    }


def in_range(
    df: DataFrame, events: Sequence[EventWindow] = DEFAULT_EVENTS, timestamp: str = "timestamp"
) -> DataFrame:
    """The rows from the first window's start to the last one's end.

    On raw rows it comes before classification, so that only rows of the range are classified, and
    reaches the scan if the timestamp is a column of the table.
    """
    days = [day for event in events for span in _bounds(event).values() for day in span]
    if not days:
        return df.limit(0)
    when = F.col(timestamp).cast("timestamp")
    return df.filter((when >= _midnight(min(days))) & (when <= _midnight(max(days))))


def event_windows(
    df: DataFrame, events: Sequence[EventWindow] = DEFAULT_EVENTS, timestamp: str = "timestamp"
) -> DataFrame:
    """``event, event_date, metric, before_value, after_value, difference``.

    A row is multiplied only by the windows that hold it. The overall time range reaches the scan
    as a filter where ``df`` is a stored table; cut raw rows by ``in_range`` before classifying them.
    A window without rows counts 0 everywhere.
    """
    metrics = [m for m in EVENT_METRICS if m in df.columns]
    names = sorted(["num_records", *metrics])
    schema = T.StructType(
        [T.StructField("event", T.StringType()), T.StructField("event_date", T.StringType())]
    )
    listed = df.sparkSession.createDataFrame([(e.name, e.date) for e in events], schema)
    if not events:
        empty = "event string, event_date string, metric string, before_value double, after_value double, difference double"
        return df.sparkSession.createDataFrame([], empty)
    windows = F.array(
        *[
            F.struct(F.lit(e.name).alias("event"), F.lit(side).alias("side"),
                     _midnight(low).alias("low"), _midnight(high).alias("high"))
            for e in events for side, (low, high) in _bounds(e).items()
        ]
    )
    when = F.col(timestamp).cast("timestamp")
    inside = F.filter(windows, lambda w: (F.col("_when") >= w["low"]) & (F.col("_when") <= w["high"]))
    rows = (
        in_range(df, events, timestamp)
        .select(when.alias("_when"), *metrics)
        .select(F.explode(inside).alias("_w"), *metrics)
    )
    sums = rows.groupBy(F.col("_w.event").alias("event"), F.col("_w.side").alias("side")).agg(
        F.count(F.lit(1)).cast("double").alias("num_records"),
        *[F.avg(F.col(m).cast("int") if m.startswith("is_") else F.col(m)).alias(m) for m in metrics],
    )
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])
    long = sums.select("event", "side", F.explode(values).alias("_v"))
    sides = long.groupBy("event", F.col("_v.metric").alias("metric")).agg(
        *[F.max(F.when(F.col("side") == side, F.col("_v.value"))).alias(f"{side}_value")
          for side in ("before", "after")]
    )
    grid = listed.select("event", "event_date", F.explode(F.array(*[F.lit(m) for m in names])).alias("metric"))
    before, after = (F.coalesce(f"{side}_value", F.lit(0.0)) for side in ("before", "after"))
    return grid.join(sides, ["event", "metric"], "left").select(
        "event", "event_date", "metric", before.alias("before_value"), after.alias("after_value"),
        (after - before).alias("difference"),
    )
