"""Cosine search for many queries: an exact way in blocks, and an inverted-file index.

The index groups unit vectors by their nearest coarse centre. A row keeps its vector and a code: its residual
from the centre, one byte per dimension. It is a Parquet table partitioned by list, so a search reads only the
lists it probes, first ids and codes, then the vectors of the candidates that the codes put in front. Lists
are cut into blocks of bounded size and queries too, so a list that holds a third of all rows is many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.arrays import cosine_similarity, doubles
from colloquy.operators.neighbours import _matrix, ranked
from colloquy.operators.sequences import top_n_per_group
from colloquy.session import written_table

ROW_BLOCK = 16_384
QUERY_BLOCK = 2_048
SAMPLE_PER_LIST = 64
MAX_LISTS = 4_096
SCORES = 1_000_000  # numbers of a matrix that a task holds at a time


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, lengths, out=np.zeros_like(x), where=lengths > 0)


def _best(ids: np.ndarray, queries: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best columns of every row of ``scores``, ties by id: queries, ids, scores."""
    kept = min(k, scores.shape[1])
    if kept < scores.shape[1]:
        limit = -np.partition(-scores, kept - 1, axis=1)[:, kept - 1]
    else:
        limit = scores.min(axis=1)
    row, column = np.nonzero(scores >= limit[:, None])
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    row, column = row[place < kept], column[place < kept]
    return queries[row], ids[column], scores[row, column]


def _compare(queries: np.ndarray, asked: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pa.Table:
    """The ``k`` best rows of every query, for as many queries at a time as ``SCORES`` allows."""
    step = max(1, SCORES // len(ids))
    found = [_best(ids, queries[low:low + step], asked[low:low + step] @ rows.T, k) for low in range(0, len(queries), step)]
    return _matches(*[np.concatenate(part) for part in zip(*found)])


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row's centre of the largest product, and that product."""
    step = max(1, SCORES // len(centres))
    own, most = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for low in range(0, len(x), step):
        scores = x[low:low + step] @ centres.T
        own[low:low + step] = scores.argmax(axis=1)
        most[low:low + step] = scores.max(axis=1)
    return own, most


MATCH = "_query long, _id long, similarity double"


def _matches(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
    return pa.table({"_query": pa.array(queries), "_id": pa.array(ids), "similarity": pa.array(scores)})


def _nothing() -> pa.Table:
    return _matches(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _named(df: DataFrame, id_column: str, vector_column: str, name: str, vector: str) -> DataFrame:
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias(name), doubles(F.col(f"`{vector_column}`")).alias(vector))
    return rows.filter(F.col(name).isNotNull() & F.col(vector).isNotNull())


def _result(found: DataFrame, k: int, id_column: str, query_column: str) -> DataFrame:
    best = top_n_per_group(found, ["_query"], [F.desc("similarity"), F.col("_id")], k, ["_id"])
    return best.select(F.col("_query").alias(query_column), F.col("_rank").alias("rank"), F.col("_id").alias(id_column), "similarity")


def exact_search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "record_id", vector_column: str = "embedding",
                 query_column: str = "query_id", row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_column, rank, id_column, similarity``: the ``k`` most similar rows of every query, ties by id.

    Every block of queries meets every block of rows in a task of its own, and only ``k`` rows per query
    leave it. Zero vectors have similarity 0; rows without id or vector are left out. Ids are whole numbers.
    """
    rows = _named(vectors, id_column, vector_column, "_id", "_v")
    asked = written_table(_named(queries, id_column, vector_column, "_query", "_q"), "queries")
    blocks = max(1, -(-asked.count() // query_block))
    many = max(1, -(-rows.count() // row_block))
    spread = rows.withColumn("_row", F.pmod(F.xxhash64("_id"), F.lit(many)).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("_query"), F.lit(blocks)).cast("int")).withColumn(
        "_row", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    )

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _nothing()
        asked, near = _unit(_matrix(left.column("_q"))), _unit(_matrix(right.column("_v")))
        return _compare(np.asarray(left.column("_query")), asked, np.asarray(right.column("_id")), near, k)

    found = asked.groupBy("_row", "_block").cogroup(spread.groupBy("_row", "_block")).applyInArrow(compared, MATCH)
    return _result(found, k, id_column, query_column)


@dataclass(frozen=True)
class VectorIndex:
    """Centres (unit vectors) and byte scales of an index, and where its rows are."""

    path: str
    centres: np.ndarray
    scale: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        """``_list, _block, _id, _code, _v``"""
        return spark.read.schema("_block int, _id long, _code binary, _v array<float>, _list int").parquet(f"{self.path}/rows")

    def save(self, spark: SparkSession) -> None:
        model = json.dumps({"centres": self.centres.tolist(), "scale": self.scale.tolist()})
        spark.createDataFrame([(model,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/model")


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    model = json.loads(spark.read.text(f"{path}/model").first()[0])
    return VectorIndex(path, np.array(model["centres"]), np.array(model["scale"]))


def _fit_centres(x: np.ndarray, lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on the sample; an empty centre takes the row that is worst off."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own, most = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        worst = np.argsort(most)
        for place, empty in enumerate(np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)):
            sums[empty] = x[worst[place % len(x)]]
        centres = _unit(sums)
    return centres


def build_index(vectors: DataFrame, path: str, id_column: str = "record_id", vector_column: str = "embedding",
                lists: int | None = None, row_block: int = ROW_BLOCK, seed: int = 42) -> VectorIndex:
    """Write the index of all rows with an id and a vector to ``path``.

    Centres are fitted on at most ``SAMPLE_PER_LIST`` rows per list, those with the smallest hashes of their
    ids; every row is indexed. Lists: the square root of the number of rows, ``MAX_LISTS`` at most.
    """
    spark = vectors.sparkSession
    rows = _named(vectors, id_column, vector_column, "_id", "_v")
    n = rows.count()
    lists = lists or int(max(1, min(MAX_LISTS, round(n ** 0.5))))
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(lists * SAMPLE_PER_LIST).select("_v").toArrow()
    if not sample.num_rows:
        raise ValueError("an index needs at least one vector")
    x = _unit(_matrix(sample.column("_v")))
    centres = _fit_centres(x, lists, seed)
    residuals = x - centres[_nearest(x, centres)[0]]
    scale = np.maximum(np.abs(residuals).max(axis=0), 1e-6) / 127

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1)))
            own = _nearest(unit, centres)[0]
            codes = np.clip(np.rint((unit - centres[own]) / scale), -127, 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(list(unit.astype(np.float32)), pa.list_(pa.float32()))],
                ["_list", "_id", "_code", "_v"],
            )

    coded = rows.mapInArrow(placed, "_list int, _id long, _code binary, _v array<float>")
    blocked = ranked(coded, ["_list"], ["_id"], "_place").select(
        F.floor(F.col("_place") / row_block).cast("int").alias("_block"), "_id", "_code", "_v", "_list"
    )
    blocked.write.mode("overwrite").partitionBy("_list").parquet(f"{path}/rows")
    index = VectorIndex(path, centres, scale)
    index.save(spark)
    return index


def search_index(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int = 4,
                 id_column: str = "record_id", vector_column: str = "embedding", query_column: str = "query_id",
                 query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_column, rank, id_column, similarity`` from the ``probes`` lists nearest to each query (three fifths).

    Codes choose ``rerank * k`` rows per query and block; their vectors give the similarity. Probing
    every list leaves only the codes' choice inexact.
    """
    spark = queries.sparkSession
    centres, scale = index.centres, index.scale
    probes = min(len(centres), probes or -(-3 * len(centres) // 5))
    asked = _named(queries, id_column, vector_column, "_query", "_q")

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORES // max(len(centres), probes * centres.shape[1]))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                rows = batch.slice(low, step)
                unit = _unit(_matrix(rows.column(1)))
                chosen = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :probes]
                repeated = pa.array(np.repeat(np.arange(rows.num_rows), probes))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(repeated), pa.array(list(unit), pa.list_(pa.float64())).take(repeated), pa.array(chosen.ravel().astype(np.int32))],
                    ["_query", "_q", "_list"],
                )

    probing = written_table(asked.mapInArrow(probed, "_query long, _q array<double>, _list int"), "probes")
    rows = index.rows(spark)
    blocks = rows.select(F.col("_list").alias("_list"), F.col("_block").alias("_block")).distinct()
    parts = probing.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("_parts"))
    asking = probing.join(parts, "_list").withColumn("_part", F.pmod(F.xxhash64("_query"), "_parts").cast("int")).join(blocks, "_list")
    coded = rows.select("_list", "_block", "_id", "_code").join(parts, "_list").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    )
    keys = ["_list", "_block", "_part"]

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _nothing()
        codes = np.frombuffer(b"".join(right.column("_code").to_pylist()), dtype=np.int8).reshape(right.num_rows, -1)
        near = centres[int(right.column("_list")[0].as_py())] + codes * scale
        return _compare(np.asarray(left.column("_query")), _matrix(left.column("_q")), np.asarray(right.column("_id")), near, rerank * k)

    found = asking.select(*keys, "_query", "_q").groupBy(*keys).cogroup(
        coded.select(*keys, "_id", "_code").groupBy(*keys)
    ).applyInArrow(compared, MATCH)
    front = top_n_per_group(found, ["_query"], [F.desc("similarity"), F.col("_id")], rerank * k, ["_id"]).select("_query", "_id")
    exact = (
        front.join(rows.select("_id", "_v"), "_id").join(asked, "_query")
        .select("_query", "_id", cosine_similarity(doubles(F.col("_v")), F.col("_q")).alias("similarity"))
    )
    return _result(exact, k, id_column, query_column)


def recall(found: DataFrame, exact: DataFrame, id_column: str = "record_id", query_column: str = "query_id") -> DataFrame:
    """One row: queries, rows the exact way returns, and the share of them found."""
    hits = exact.join(found.select(query_column, id_column, F.lit(1).alias("_hit")), [query_column, id_column], "left")
    return hits.agg(
        F.count_distinct(query_column).alias("num_queries"), F.count(F.lit(1)).alias("num_matches"),
        (F.count("_hit") / F.count(F.lit(1))).alias("recall"),
    )
