"""Places of pattern matches in texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.llm.common import let

SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches: array of (start, end, value) in code points, end exclusive.

    The text is split by the pattern; pieces and matches alternate, so their lengths add up to places.
    """

    def placed(values: Column) -> Column:
        def step(state: Column, pair: Column) -> Column:
            start = state["at"] + F.length(pair["piece"])
            end = start + F.length(pair["value"])
            span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
            return F.when(pair["value"].isNull(), state).otherwise(
                F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))
            )

        pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), values.alias("value"))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
        return F.when(F.size(values) > 0, F.aggregate(pairs, begin, step)["spans"]).otherwise(F.array().cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), placed)


def labelled(spans: Column, kind: str, order: int) -> Column:
    """Spans as (start, order, kind, end), which sort by start and then by the order of kinds."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")
    ))


def written(labelled_spans: Column) -> Column:
    """``kind:start:end`` by start, then order, joined by commas."""
    return F.array_join(
        F.transform(F.sort_array(labelled_spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))
