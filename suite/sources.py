"""Queries that write, read back and compare: formats, splits, vectors, run records, whole runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colloquy.operators.splits import assign_splits
from colloquy.plans.semantics import run_clustering
from colloquy.session import shared_folder
from colloquy.settings import ClusterSettings
from colloquy.sources.files import load_prompts, read_dataset, write_dataset, write_split_outputs
from colloquy.sources.runlog import RunClock, append_record, run_record
from suite.inputs import sql_split, table
from suite.registry import register


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "format_roundtrips",
    """SELECT suffix, lang, count(*) AS num_records, CAST(sum(doc_id) AS BIGINT) AS id_sum, count(nullif(text, '')) AS num_texts,
              CAST(sum(length(text)) AS BIGINT) AS characters, max(md5(text)) AS last_digest
       FROM documents CROSS JOIN (SELECT unnest(['csv', 'jsonl', 'parquet']) AS suffix) AS s GROUP BY ALL""",
)
def _(spark, folder):
    """All documents through every format that keeps them whole; empty text is missing in CSV."""
    docs = table(spark, folder, "documents")
    out = None
    for suffix in ("csv", "jsonl", "parquet"):
        path = f"{_place(spark, 'roundtrip')}.{suffix}"
        write_dataset(docs, path)
        text = F.coalesce("text", F.lit(""))
        back = read_dataset(spark, path, docs.schema).groupBy("lang").agg(
            F.count(F.lit(1)).alias("num_records"), F.sum("doc_id").alias("id_sum"), F.count(F.nullif("text", F.lit(""))).alias("num_texts"),
            F.sum(F.length(text)).alias("characters"), F.max(F.md5(text.cast("binary"))).alias("last_digest"),
        ).select(F.lit(suffix).alias("suffix"), "*")
        out = back if out is None else out.unionByName(back)
    return out


@register(
    "split_outputs",
    f"""SELECT doc_id, {sql_split("CAST(doc_id AS VARCHAR)")} AS data_split FROM documents""",
)
def _(spark, folder):
    """Every document from the output of its split, each read by itself."""
    docs = table(spark, folder, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("conversation_id"), F.col("doc_id").cast("string").alias("record_id")
    )
    out = None
    for split, path in write_split_outputs(assign_splits(docs), _place(spark, "splits")).items():
        part = spark.read.schema("doc_id long").parquet(path).withColumn("data_split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


@register("required_columns", "SELECT doc_id, length(text) AS characters FROM documents WHERE text IS NOT NULL")
def _(spark, folder):
    """A scan with its required columns checked and rows without text left out."""
    return load_prompts(table(spark, folder, "documents"), ("doc_id", "text"), "text").select("doc_id", F.length("text").cast("long").alias("characters"))


@register("first_prompts", "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 100")
def _(spark, folder):
    """The development limit: the first rows by key, its feature."""
    return load_prompts(table(spark, folder, "documents"), ("doc_id", "text"), "text", 100, "doc_id").select("doc_id", "lang")


@register(
    "vector_roundtrip",
    """SELECT vec_id, label, len(embedding) AS dimensions, list_aggregate(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), 'sum') AS total
       FROM embeddings""",
    ("total",),
)
def _(spark, folder):
    """Vectors written and read back."""
    path = f"{_place(spark, 'vectors')}.parquet"
    write_dataset(table(spark, folder, "embeddings"), path)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return read_dataset(spark, path).select("vec_id", "label", F.size("embedding").cast("long").alias("dimensions"), total.alias("total"))


@register(
    "run_records",
    """SELECT 'events' AS run, event_type, count(*) AS num_records, TRUE AS rate_agrees FROM events GROUP BY event_type""",
)
def _(spark, folder):
    """A throughput record per event type, appended to one table and read back."""
    path, clock = _place(spark, "records"), RunClock()
    counts = table(spark, folder, "events").groupBy("event_type").count()
    for row in counts.orderBy("event_type").toLocalIterator():
        append_record(run_record(counts, "events", row["count"], clock.seconds(), event_type=row["event_type"]), path)
    back = spark.read.schema("run string, num_records long, elapsed_seconds double, records_per_second double, details string").json(path)
    rate = F.abs(F.col("records_per_second") * F.col("elapsed_seconds") - F.col("num_records")) < 1e-6 * F.col("num_records")
    return back.select("run", F.get_json_object("details", "$.event_type").alias("event_type"), "num_records", rate.alias("rate_agrees"))


@register("clustering_run")
def _(spark, folder):
    """The whole clustering run over stored vectors: quality of every method."""
    path = f"{_place(spark, 'clustering')}.parquet"
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("record_id"), "embedding", F.concat(F.lit("label "), F.col("label").cast("string")).alias("prompt_text")
    )
    write_dataset(vectors, path)
    return run_clustering(spark, path, _place(spark, "clustering-out"), ClusterSettings())
