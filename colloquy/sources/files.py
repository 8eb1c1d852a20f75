"""File formats chosen by suffix, JSON-lines sink, partitioned split output."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_LINES = (".jsonl", ".ndjson")
SUPPORTED = (".csv", ".json", ".jsonl", ".ndjson", ".parquet")
SPLITS = ("train", "validation", "test")
CSV_TIMESTAMP = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def suffix_of(path: str) -> str:
    return PurePosixPath(str(path)).suffix.lower()


def _check_suffix(path: str, direction: str) -> str:
    suffix = suffix_of(path)
    if suffix not in SUPPORTED:
        raise ValueError(f"{direction} {path!r}: suffix {suffix!r} is not one of {', '.join(SUPPORTED)}")
    return suffix


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.MapType, T.ArrayType, T.StructType))


def _read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None, multi_line: bool) -> DataFrame:
    """CSV with a header; nested columns of a given schema are read from their JSON text."""
    options = {
        "header": True, "multiLine": multi_line, "quote": '"', "escape": '"', "timestampFormat": CSV_TIMESTAMP,
    }
    if schema is None:
        return spark.read.csv(path, inferSchema=True, **options)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    flat = T.StructType([T.StructField(f.name, T.StringType() if _nested(f.dataType) else f.dataType) for f in wanted])
    rows = spark.read.schema(flat).csv(path, **options)
    return rows.select(*[
        (F.from_json(F.col(f"`{f.name}`"), f.dataType) if _nested(f.dataType) else F.col(f"`{f.name}`")).alias(f.name)
        for f in wanted
    ])


def read_dataset(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """Read CSV, JSON array, JSON lines or Parquet; pass ``schema`` to skip inference on large text.

    A CSV value or a JSON array may span lines, so these files are read by one task each. With
    ``multi_line=False`` they are split like any other: one record a line. Parquet and JSON lines
    always are.
    """
    suffix = _check_suffix(path, "cannot read")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if suffix == ".csv":
        return _read_csv(spark, path, schema, multi_line)
    if suffix == ".json":
        return reader.json(path, multiLine=multi_line)
    if suffix in JSON_LINES:
        return reader.json(path)
    return reader.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give per-row text work one partition per core when a small scan has fewer.

    Tables of cluster size have far more scan partitions than that and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write in the format the suffix names. The output is a folder of part files.

    CSV holds maps, arrays and structs as JSON text. It cannot tell empty text from a missing value: both
    are read as missing.
    """
    suffix = _check_suffix(path, "cannot write")
    writer = df.write.mode(mode)
    if suffix == ".csv":
        flat = df.select(*[
            (F.to_json(F.col(f"`{f.name}`")) if _nested(f.dataType) else F.col(f"`{f.name}`")).alias(f.name)
            for f in df.schema
        ])
        flat.write.mode(mode).csv(path, header=True, quote='"', escape='"', timestampFormat=CSV_TIMESTAMP)
    elif suffix == ".parquet":
        writer.parquet(path)
    else:
        writer.json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ssXXX", dateFormat="yyyy-MM-dd")


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON object with ISO timestamps; nulls are kept as explicit nulls."""
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX", "ignoreNullFields": "false"}
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), options).alias("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_lines(df).write.mode(mode).text(path)


def write_split_outputs(df: DataFrame, folder: str) -> dict[str, str]:
    """One pass, one sub-folder per split (``data_split=train`` ...); reads prune by partition."""
    df.write.mode("overwrite").partitionBy("data_split").parquet(folder)
    return {split: f"{folder}/data_split={split}" for split in SPLITS}


def load_prompts(
    df: DataFrame, required: tuple[str, ...], text_column: str | None = None,
    limit: int | None = None, order_by: str | None = None,
) -> DataFrame:
    """Check required columns, drop rows without text, optionally keep the first rows by key."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    if text_column:
        df = df.filter(F.col(text_column).isNotNull())
    if limit is not None:
        df = df.orderBy(order_by or required[0]).limit(int(limit))
    return df
