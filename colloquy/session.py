"""Session helpers: defaults for new sessions and tables written between stages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str = "colloquy", master: str | None = None, **conf: str
) -> SparkSession:
    """Create (or get) a session with UTC time, AQE and Arrow switched on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Calendar columns are defined in UTC, so pin the session time zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _name_checkpoint_folder(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one up only for local sessions (tests, notebooks)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="colloquy-checkpoint-", dir=os.environ.get("TMPDIR"))
    spark.sparkContext.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder that checkpoints use; every executor can reach it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        _name_checkpoint_folder(spark)
    return context.getCheckpointDir()


def written_table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write the rows once to the shared folder and read them back; ``compression`` is a codec of Parquet.

    For results that are read several times or in loops: the work behind them is done once, and lost
    executors do not bring it back. The folder is the cluster's to clean up, like any checkpoint.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
