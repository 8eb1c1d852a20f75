"""Text to vectors, encoder comparison, reproducibility and cosine search."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.arrays import cosine_similarity, doubles, literal_vector
from colloquy.functions.text import clean_text, words
from colloquy.operators.sampling import exact_sample
from colloquy.sources.files import load_prompts

METADATA_COLUMNS = (
    "conversation_id", "timestamp", "year_month", "language", "data_split", "prompt_length",
    "prompt_word_count",
)
Encoder = Callable[[list[str]], np.ndarray]
EncoderFactory = Callable[[], Encoder]


class FrameEncoder(Protocol):
    """An encoder that works on whole frames, such as ``latent.LatentEncoder``."""

    def transform(self, df: DataFrame, text_column: str) -> DataFrame: ...


def encode_column(factory: EncoderFactory, batch_size: int = 64, normalize: bool = True):
    """Arrow iterator UDF from text to ``array<float>``; the encoder is built once per worker."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()
        for texts in batches:
            vectors: list[np.ndarray] = []
            for start in range(0, len(texts), batch_size):
                block = np.asarray(encoder(texts.iloc[start : start + batch_size].tolist()), dtype=np.float32)
                if normalize:
                    lengths = np.linalg.norm(block, axis=1, keepdims=True)
                    block = np.divide(block, lengths, out=np.zeros_like(block), where=lengths != 0)
                vectors.extend(block)
            yield pd.Series(vectors, index=texts.index)

    return encode


def hashed_tfidf(
    df: DataFrame, text_column: str, dimensions: int = 256, use_idf: bool = True, normalize: bool = True
) -> DataFrame:
    """Built-in encoder without a model file: hashed term counts, optional IDF, unit length.

    Runs in the JVM. With ``use_idf`` the document frequencies are fitted in one pass first.
    """
    tokens = df.withColumn("_tokens", words(clean_text(F.col(text_column))))
    counted = HashingTF(numFeatures=dimensions, inputCol="_tokens", outputCol="_tf").transform(tokens)
    last = "_tf"
    if use_idf:
        counted = IDF(inputCol="_tf", outputCol="_idf").fit(counted).transform(counted)
        last = "_idf"
    if normalize:
        counted = Normalizer(p=2.0, inputCol=last, outputCol="_unit").transform(counted)
        last = "_unit"
    return counted.withColumn("embedding", vector_to_array(F.col(last), "float32")).drop(
        "_tokens", "_tf", "_idf", "_unit"
    )


def embed_prompts(
    prompts: DataFrame, text_column: str = "prompt_text", id_column: str = "record_id",
    factory: EncoderFactory | None = None, dimensions: int = 256, batch_size: int = 64,
    normalize: bool = True,
) -> DataFrame:
    """Vectors keyed by record id, with the metadata columns that exist."""
    source = load_prompts(prompts, (text_column, id_column), text_column)
    kept = [c for c in (id_column, text_column, *METADATA_COLUMNS) if c in source.columns]
    source = source.select(*kept)
    if factory is None:
        return hashed_tfidf(source, text_column, dimensions, normalize=normalize)
    return source.withColumn("embedding", encode_column(factory, batch_size, normalize)(F.col(text_column)))


def cosine_top_k(
    vectors: DataFrame, query: Sequence[float] | DataFrame, k: int = 10, id_column: str = "record_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The ``k`` most similar rows, ties by id. ``query`` is a literal or a one-row, one-column frame.

    One scan with a per-task top-k; zero vectors have similarity 0.
    """
    target = query.scalar() if isinstance(query, DataFrame) else literal_vector(query)
    scored = vectors.withColumn("_query", doubles(target)).withColumn(
        "similarity", cosine_similarity(doubles(F.col(vector_column)), F.col("_query"))
    )
    return scored.drop("_query").orderBy(F.desc("similarity"), id_column).limit(k)


def compare_encoders(
    prompts: DataFrame, encoders: dict[str, EncoderFactory | FrameEncoder | None], text_column: str = "prompt_text",
    id_column: str = "record_id", sample_size: int | None = None, batch_size: int = 64,
    normalize: bool = True,
) -> DataFrame:
    """Time every encoder over the same sample: records, seconds, rate, dimensions.

    An encoder is a factory of a function from texts to vectors, a fitted one with ``transform(df, text_column)``,
    or None for the built-in one.
    """
    sample = exact_sample(load_prompts(prompts, (text_column, id_column), text_column), id_column, sample_size)
    rows = []
    for name, factory in encoders.items():
        started = time.perf_counter()
        if hasattr(factory, "transform"):
            encoded = factory.transform(sample, text_column)
        else:
            encoded = embed_prompts(sample, text_column, id_column, factory, 256, batch_size, normalize)
        total, size = encoded.agg(F.count("embedding"), F.max(F.size("embedding"))).first()
        seconds = max(time.perf_counter() - started, 1e-6)
        rows.append((name, total, batch_size, seconds, total / seconds, size))
    return prompts.sparkSession.createDataFrame(
        rows,
        "model_name string, num_records long, batch_size int, seconds double, "
        "records_per_second double, embedding_dimensions int",
    )


def max_difference(
    first: DataFrame, second: DataFrame, id_column: str, vector_column: str = "embedding",
    tolerance: float = 1e-6,
) -> DataFrame:
    """Largest absolute difference between two encodings of the same rows, joined by id."""
    left = first.select(id_column, doubles(F.col(vector_column)).alias("_a"))
    right = second.select(id_column, doubles(F.col(vector_column)).alias("_b"))
    gap = F.array_max(F.zip_with("_a", "_b", lambda a, b: F.abs(a - b)))
    return (
        left.join(right, id_column)
        .agg(F.count(F.lit(1)).alias("sample_size"), F.max(gap).alias("max_absolute_difference"))
        .withColumn("is_reproducible", F.col("max_absolute_difference") < tolerance)
    )


def embedding_reproducibility(
    prompts: DataFrame, text_column: str = "prompt_text", id_column: str = "record_id",
    factory: EncoderFactory | None = None, sample_size: int | None = None,
) -> DataFrame:
    """Encode the same sample twice and compare."""
    sample = exact_sample(load_prompts(prompts, (text_column, id_column), text_column), id_column, sample_size)
    runs = [embed_prompts(sample, text_column, id_column, factory) for _ in range(2)]
    return max_difference(*runs, id_column)
