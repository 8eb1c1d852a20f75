"""A predictor that reads the text: multinomial logistic regression on hashed terms.

It fits on every labelled row by MLlib and becomes a predictor factory for ``operators/models.py``: what a
worker holds is one row of weights per class, whose size does not depend on the rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.models import Predictor
from colloquy.session import written_table

TERMS = 1024
ROWS = 512  # rows of dense counts that a task holds at a time
TERM = re.compile(r"\w+")


def term_vector(text: str, terms: int) -> np.ndarray:
    """Damped counts of hashed terms, of length one; zero for a text without any."""
    places = [zlib.crc32(t.encode()) % terms for t in TERM.findall(text.lower())]
    counts = np.log1p(np.bincount(places, minlength=terms).astype(float)) if places else np.zeros(terms)
    length = np.linalg.norm(counts)
    return counts / length if length else counts


@dataclass(frozen=True)
class TextClassifier:
    """``weights`` has a row per class; ``classes`` are in the order of their names."""

    classes: tuple[str, ...]
    weights: np.ndarray
    intercepts: np.ndarray

    def scores(self, text: str) -> np.ndarray:
        """Probability of every class."""
        margins = self.weights @ term_vector(text, self.weights.shape[1]) + self.intercepts
        shares = np.exp(margins - margins.max())
        return shares / shares.sum()

    def factory(self) -> Predictor:
        """Once per worker: a function from texts to (label, score) lists."""
        return lambda texts: [list(zip(self.classes, self.scores(text).tolist())) for text in texts]


def fit_text_classifier(df: DataFrame, text_column: str = "prompt_text", label_column: str = "label", terms: int = TERMS,
                        regularization: float = 1e-3, max_iter: int = 50) -> TextClassifier:
    """Fit on all rows with a text and a label. The number of classes is that of distinct labels, two or more."""
    known = df.select(F.col(f"`{text_column}`").cast("string").alias("_text"), F.col(f"`{label_column}`").cast("string").alias("_label"))
    known = known.filter("_text IS NOT NULL AND _label IS NOT NULL")
    classes = tuple(sorted(r["_label"] for r in known.select("_label").distinct().collect()))
    if len(classes) < 2:
        raise ValueError("a classifier needs two labels or more")
    number = {name: float(k) for k, name in enumerate(classes)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(low, ROWS) for whole in batches for low in range(0, whole.num_rows, ROWS)):
            rows = np.empty((batch.num_rows, terms))
            for place, text in enumerate(batch.column(0)):
                rows[place] = term_vector(text.as_py(), terms)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number[n] for n in batch.column(1).to_pylist()], pa.float64()), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))],
                ["label", "_array"],
            )

    rows = written_table(known.mapInArrow(features, "label double, _array array<double>"), "classifier-rows")
    model = LogisticRegression(
        family="multinomial", maxIter=max_iter, regParam=regularization, featuresCol="_vector", labelCol="label"
    ).fit(rows.withColumn("_vector", array_to_vector("_array")))
    return TextClassifier(classes, model.coefficientMatrix.toArray(), model.interceptVector.toArray())
