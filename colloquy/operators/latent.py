"""A learned encoder: truncated singular value decomposition of the TF-IDF matrix, by a randomised block.

Terms are hashed, so a row is sparse and the number of columns is a parameter. The block starts from seeded
random columns. A power round is one pass over the rows: tasks add up A'(A B) for the columns B, whose size
does not depend on the rows, and the driver makes them orthonormal again. At the end the tall, skinny A B is
factored by partial QR: each task factors its rows, triangles are stacked and factored again, and the
singular value decomposition of the last triangle gives values and right vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import clean_text, words
from colloquy.session import written_table

TERMS = 4096
CHUNK = 4_000  # non-zero entries that are multiplied at a time; their products stay in the cache


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, columns and values of a batch of ``_indices``, ``_values``."""
    indices, values = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    lengths = np.diff(indices.offsets.to_numpy())
    return np.concatenate(([0], np.cumsum(lengths))), indices.flatten().to_numpy(), values.flatten().to_numpy()


def _times(starts: np.ndarray, columns: np.ndarray, values: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Sparse rows times ``block``."""
    out = np.zeros((len(starts) - 1, block.shape[1]))
    row = 0
    while row < len(out):
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + CHUNK, side="right")) - 1)
        part = slice(int(starts[row]), int(starts[end]))
        filled = np.flatnonzero(np.diff(starts[row:end + 1])) + row
        if len(filled):
            out[filled] = np.add.reduceat(values[part, None] * block[columns[part]], starts[filled] - starts[row], axis=0)
        row = end
    return out


def _triangle(rows: np.ndarray, held: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.concatenate((held, rows)), mode="r")


@dataclass(frozen=True)
class LatentEncoder:
    """Fitted document frequencies and right singular vectors (``terms`` by ``k``)."""

    idf: IDFModel
    vectors: np.ndarray
    singular_values: np.ndarray
    terms: int

    def transform(self, df: DataFrame, text_column: str, output: str = "embedding") -> DataFrame:
        """Add unit vectors (zero for texts without a known term), the latent coordinates of the texts."""
        kept = [c for c in df.columns if c != output]
        texts = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{text_column}`").alias("_text"))
        packed = _weighted(texts, self.idf, self.terms)
        axes = self.vectors

        def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _times(*_sparse(batch), axes)
                lengths = np.linalg.norm(found, axis=1, keepdims=True)
                found = np.divide(found, lengths, out=np.zeros_like(found), where=lengths > 0).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.float32()))], ["_row", output])

        row = packed.schema["_row"].dataType.simpleString()
        return packed.mapInArrow(projected, f"_row {row}, `{output}` array<float>").select("_row.*", output)


def _counted(df: DataFrame, terms: int) -> DataFrame:
    tokens = df.withColumn("_tokens", words(clean_text(F.col("_text"))))
    return HashingTF(numFeatures=terms, inputCol="_tokens", outputCol="_tf").transform(tokens).drop("_tokens", "_text")


def _weighted(df: DataFrame, idf: IDFModel, terms: int) -> DataFrame:
    """Columns of ``df`` but ``_text``, then ``_indices`` and ``_values`` of the unit TF-IDF rows."""
    return _unit_rows(_counted(df, terms), idf)


def _unit_rows(counted: DataFrame, idf: IDFModel) -> DataFrame:
    """Columns of ``counted`` but ``_tf``, then ``_indices`` and ``_values`` of the unit TF-IDF rows."""
    weighted = Normalizer(p=2.0, inputCol="_idf", outputCol="_unit").transform(idf.transform(counted))
    entries = weighted.withColumn("_u", F.unwrap_udt("_unit")).drop("_tf", "_idf", "_unit")
    return entries.select("*", F.col("_u.indices").alias("_indices"), F.col("_u.values").alias("_values")).drop("_u")


def _power_round(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """A'(A B): every task adds up its rows, then rows of the sums are added by term."""
    width = block.shape[1]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(block)
        for batch in batches:
            starts, columns, values = _sparse(batch)
            image = _times(starts, columns, values, block)
            owner = np.repeat(np.arange(len(image)), np.diff(starts))
            order = np.argsort(columns, kind="stable")
            for low in range(0, len(order), CHUNK):
                part = order[low:low + CHUNK]
                own = columns[part]
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                total[own[first]] += np.add.reduceat(values[part, None] * image[owner[part]], first, axis=0)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(list(total[used]), pa.list_(pa.float64()))], ["term", "sums"]
        )

    partial = rows.select("_indices", "_values").mapInArrow(added, "term int, sums array<double>")
    sums = partial.groupBy("term").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)])
    table = sums.toArrow()
    out = np.zeros_like(block)
    out[np.asarray(table.column("term"))] = np.column_stack([np.asarray(table.column(f"s{k}")) for k in range(width)])
    return out


def _tall_triangle(rows: DataFrame, block: np.ndarray, fan: int = 16) -> np.ndarray:
    """The triangle of the QR factors of A B, from partial factors that are joined ``fan`` or so at a time."""
    width = block.shape[1]

    def row(held: np.ndarray) -> pa.Array:
        return pa.array([held.ravel().tolist()], pa.list_(pa.float64()))

    def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                held = _triangle(_times(*_sparse(batch), block), held)
        if len(held):
            yield pa.RecordBatch.from_arrays([row(held)], ["r"])

    def stacked(triangles: list[list[float]]) -> np.ndarray:
        held = np.zeros((0, width))
        for entries in sorted(triangles):
            held = _triangle(np.array(entries).reshape(-1, width), held)
        return held

    parts = written_table(rows.select("_indices", "_values").mapInArrow(factored, "r array<double>"), "triangles")
    while (count := parts.count()) > fan:
        dealt = parts.withColumn("part", F.pmod(F.xxhash64("r"), F.lit(-(-count // fan))))
        joined = dealt.groupBy("part").applyInArrow(
            lambda table: pa.table({"r": row(stacked(table.column("r").to_pylist()))}), "r array<double>"
        )
        parts = written_table(joined, "triangles")
    return stacked([r["r"] for r in parts.collect()])


def fit_latent_encoder(df: DataFrame, text_column: str = "prompt_text", k: int = 64, terms: int = TERMS, rounds: int = 4,
                       extra: int = 10, seed: int = 42) -> LatentEncoder:
    """Fit on all rows with a text; ``rounds`` power rounds over a block of ``k + extra`` columns."""
    texts = df.filter(F.col(f"`{text_column}`").isNotNull()).select(F.col(f"`{text_column}`").alias("_text"))
    counted = written_table(_counted(texts, terms), "term-counts")
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted)
    rows = written_table(_unit_rows(counted, idf).select("_indices", "_values"), "tfidf-rows")
    width = min(k + extra, terms)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    for _ in range(rounds):
        block = np.linalg.qr(_power_round(rows, block))[0]
    triangle = _tall_triangle(rows, block)
    _, values, right = np.linalg.svd(triangle)
    kept = min(k, len(values))
    vectors = block @ right[:kept].T
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
    return LatentEncoder(idf, vectors * np.where(signs == 0, 1.0, signs), values[:kept], terms)
