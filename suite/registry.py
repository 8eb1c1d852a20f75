"""Query registry and output hygiene shared by all queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 9


def comparable(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded (without negative zero), timestamps without zone."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column, digits) + F.lit(0.0)
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def rounded_sql(sql: str, digits: int, *doubles: str) -> str:
    """The same rounding on the oracle side for the named columns."""
    if not doubles:
        return sql
    replaced = ", ".join(f'round("{name}", {digits}) + 0.0 AS "{name}"' for name in doubles)
    return f"SELECT * REPLACE ({replaced}) FROM (\n{sql}\n) AS unrounded"


def register(name: str, sql: str | None = None, doubles: tuple[str, ...] = (), digits: int = DIGITS) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its check, ``doubles`` its columns to round."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return comparable(build(use_utc(spark), folder), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = rounded_sql(sql.strip().rstrip(";"), digits, *doubles)
        return build

    return add
