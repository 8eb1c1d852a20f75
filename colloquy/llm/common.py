"""Column helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; a missing one counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of text in a table, for choosing the number of parts of a job."""
    total = df.select(F.sum(F.octet_length(F.col(f"`{column}`").cast("string")))).first()[0]
    return int(total or 0)
