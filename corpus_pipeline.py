"""Cleaning a corpus for training: five stages over ``documents``, each one of the operators.

Stages are functions of (spark, docs, folder). What one keeps is written and is all that the next one
sees. All but the last return the columns of their input.

Rows are told apart by a number that the stage writes beside them, never by ``doc_id``: ids that are missing
or repeated, and rows that repeat, are rows like any other. Other columns may have any name. Every stage
takes an empty table and texts of any length; a missing text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from colloquy.llm.bpe import encode
from colloquy.llm.exact import exact_groups
from colloquy.llm.mixing import mixed_documents, mixture
from colloquy.llm.quality import quality_filter
from colloquy.llm.simhash import near_duplicates
from colloquy.session import written_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# The fingerprints of operator 1: words to a shingle, and differing bits at which texts are linked.
SHINGLE_WORDS = 4
MAX_BITS = 4


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a unique number, written so that it stays; its column has a name that ``docs`` does not use."""
    name = "_row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return written_table(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", "zstd"), name


def without(rows: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """The rows whose number is not in the one column of ``dropped``; only few numbers are moved if few go."""
    gone = written_table(dropped.toDF(row), "dropped")
    return rows.join(gone, row, "left_anti").drop(row)


def rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines. Rows that repeat fare alike."""
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of equal texts: the one with the largest id, and of several such rows the last one.

    A row without an id stays only where no copy has one. A text without a copy always stays.
    """
    rows, row = numbered(docs)
    keyed = rows.select(F.struct(F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("key"), "text")
    return without(rows, row, exact_groups(keyed, "key").filter("_id != keep_id").select("_id.row"))


def near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of texts that fingerprints link: the one with the smallest id, then the first.

    A row without an id stays only where no member has one.
    """
    rows, row = numbered(docs)
    found = near_duplicates(rows.select(F.col(row).alias("_key"), "text"), "_key", "text", SHINGLE_WORDS, MAX_BITS)
    ids = rows.select(F.col(row).alias("_key"), F.col("doc_id").alias("_id"))
    member = written_table(found.select("_key", "component_id").join(ids, "_key"), "near-members")
    place = F.struct(F.col("_id").isNull(), "_id", "_key")
    stay = member.groupBy("component_id").agg(F.min_by("_key", place).alias("_key"))
    return without(rows, row, member.join(stay, "_key", "left_anti").select("_key"))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources at their target weights: documents repeated, cut to blocks or left out, row by row."""
    rows, row = numbered(docs)
    narrow = rows.select(F.col(row).alias("key"), F.col("doc_id").alias("id"), "source", "text")
    decisions = written_table(mixture(narrow, "key", seed_column="id"), "mixture")
    return mixed_documents(rows, decisions.withColumnRenamed("key", row), row).drop(row)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return encode(docs, TOKENIZER).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", rules), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]
# Token ids and fingerprints are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
