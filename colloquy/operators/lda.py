"""Latent Dirichlet allocation by stochastic variational Bayes, for several numbers of topics at a time.

The method, its step sizes and its priors are those of MLlib's online optimizer with ``subsamplingRate`` 1, but
a pass infers the topics of every row once for all models, without resampling. Rows keep what they inferred, and
the next pass starts from there: a model moves little between passes, so few rounds per row are left. A round
goes over a block of rows at once, as a dense matrix of the terms that occur in the block. Rows that share their
first terms stand together, which keeps these few.

Blocks and their states alternate between two folders as bytes, so that only two passes are stored. What a task
adds up is a matrix of terms by topics, whose size does not depend on the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.session import shared_folder, written_table

OFFSET, DECAY = 1024, 0.51
SHAPE = 100.0
CHANGE = 1e-4  # mean change of a row's topic weights at which it has converged; MLlib stops at 1e-3
CELLS = 262_144  # rows times terms of a block
ADDERS = 8  # tasks that add up what the tasks of a pass found
BLOCKS = "_size int, _known binary, _cells binary, _values binary, _gamma binary"


def _shifted(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    return x + 6.0, [x + i for i in range(6)]


def _digamma_parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``y`` and ``c`` with digamma(x) = ln y - c."""
    y = x + 6.0
    r = 1.0 / y
    s = r * r
    t = x * (x + 5.0)  # the reciprocals of x to x + 5 add up to one fraction of t
    below = (2.0 * x + 5.0) * ((3.0 * t + 20.0) * t + 24.0) / (t * (t + 4.0) * (t + 6.0))
    return y, 0.5 * r + s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s * (1 / 132))))) + below


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ln Γ for positive numbers."""
    y, c = _digamma_parts(x)
    return np.log(y) - c


def trigamma(x: np.ndarray) -> np.ndarray:
    """Second derivative of ln Γ for positive numbers."""
    y, below = _shifted(x)
    r = 1.0 / y
    s = r * r
    series = r * s * (1 / 6 - s * (1 / 30 - s * (1 / 42 - s * (1 / 30 - s * (5 / 66)))))
    return r + 0.5 * s + series + sum(1.0 / (b * b) for b in below)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Γ for positive numbers."""
    y, below = _shifted(x)
    r = 1.0 / y
    s = r * r
    series = r * (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680))))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - sum(np.log(b) for b in below)


def _expected_log(x: np.ndarray) -> np.ndarray:
    """Expected logarithms of Dirichlet variables, one per row of ``x``."""
    return digamma(x) - digamma(x.sum(axis=-1, keepdims=True))


def _shares(gamma: np.ndarray) -> np.ndarray:
    """exp(digamma(gamma)): a row's exp(E ln θ) but for a factor, which the variational round does not depend on."""
    y, c = _digamma_parts(gamma)
    return y * np.exp(-c)


def _blocks(starts: np.ndarray, columns: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, columns and values of rows with entries, padded to the longest of a block; padding has value 0."""
    lengths = np.diff(starts)
    order = np.flatnonzero(lengths)
    first = starts[order]
    second = np.where(lengths[order] > 1, columns[np.minimum(first + 1, len(columns) - 1)], -1)
    order = order[np.lexsort((lengths[order], second, columns[first]))]
    terms = int(columns.max(initial=0)) + 1
    at = 0
    while at < len(order):
        end, entries = at + 1, int(lengths[order[at]])
        while end < len(order) and (end + 1 - at) * min(terms, entries + int(lengths[order[end]])) <= CELLS:
            entries += int(lengths[order[end]])
            end += 1
        rows = order[at:end]
        place = np.arange(lengths[rows].max())
        filled = place < lengths[rows][:, None]
        source = np.where(filled, starts[rows][:, None] + place, starts[rows][:, None])
        yield rows, columns[source], np.where(filled, values[source], 0.0)
        at = end


def _cells(columns: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a block, and the places and values of its cells in a matrix of its rows by these terms."""
    known, own = np.unique(columns, return_inverse=True)
    places = np.arange(len(columns))[:, None] * len(known) + own.reshape(columns.shape)
    held = values != 0
    return known, places[held], values[held]


def _matrix(size: int, terms: int, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    counts = np.zeros(size * terms)
    counts[places] = values
    return counts.reshape(size, terms)


def _infer(columns: np.ndarray, values: np.ndarray, topics: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Topic weights of a block of rows, from ``gamma`` on; ``topics`` are exp(E ln β), a row per term."""
    known, places, held = _cells(columns, values)
    counts = _matrix(len(columns), len(known), places, held)
    return _settle(counts, topics[known], _across(topics[known]), alpha, gamma, np.empty(counts.shape))


def _across(topics: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(topics.T) + 1e-100


def _settle(counts: np.ndarray, topics: np.ndarray, across: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Topic weights of the rows of ``counts``, whose columns are the rows of ``topics``; ``room`` is overwritten.

    The fixed point of the variational round, by squared extrapolation: two rounds give each row's direction and
    step. A row has converged when a plain round no longer moves it.
    """
    found = gamma.astype(np.float64)
    left, now, reach = np.arange(len(gamma)), found, np.ones(len(gamma))
    limit = CHANGE * len(alpha)

    def moved(at: np.ndarray) -> np.ndarray:
        share = _shares(at)
        ratio = np.matmul(share, across, out=room[:len(at)])
        np.divide(counts, ratio, out=ratio)
        after = np.matmul(ratio, topics)
        after *= share
        after += alpha
        return after

    while True:
        one = moved(now)
        two = moved(one)
        if len(left) == len(found):
            found = two
        else:
            found[left] = two
        last = two - one
        going = np.abs(last).sum(axis=1) > limit
        still = np.count_nonzero(going)
        if not still:
            return found
        first = one - now
        bend = last - first
        length = np.sqrt(np.einsum("nk,nk->n", first, first) / np.maximum(np.einsum("nk,nk->n", bend, bend), 1e-300))
        step = np.where(going, np.clip(length, 1.0, reach), 1.0)
        reach = np.where(length >= reach, 4 * reach, reach)
        if 2 * still <= len(left):
            left, now, reach, counts = left[going], now[going], reach[going], counts[going]
            first, bend, step = first[going], bend[going], step[going]
        step = step[:, None]
        now = np.maximum(now + 2 * step * first + step * step * bend, alpha)


def _entries(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, columns and values of the two columns from ``first`` on."""
    indices, values = batch.column(first), batch.column(first + 1)
    lengths = np.diff(indices.offsets.to_numpy())
    return np.concatenate(([0], np.cumsum(lengths))), indices.flatten().to_numpy(), values.flatten().to_numpy()


def _sparse_rows(df: DataFrame, column: str, *kept: str) -> DataFrame:
    """``kept`` and the vectors of ``column`` as ``_indices``, ``_values``; missing vectors have no entries."""
    entries = df.withColumn("_u", F.unwrap_udt(column))
    values = F.coalesce("_u.values", F.array().cast("array<double>"))
    dense = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    return entries.select(*kept, F.coalesce("_u.indices", dense).alias("_indices"), values.alias("_values"))


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of rows as bytes: terms, places of cells, their values, and ``width`` topic weights of 1 a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(rows), *_cells(columns, values)) for rows, columns, values in _blocks(*_entries(batch, 0))]
            sizes, known, places, values = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                pa.array(sizes, pa.int32()),
                *[pa.array([a.astype(kind).tobytes() for a in part], pa.binary()) for part, kind in ((known, np.int32), (places, np.int32), (values, np.float64))],
                pa.array([np.ones(size * width, dtype=np.float32).tobytes() for size in sizes], pa.binary()),
            ], ["_size", "_known", "_cells", "_values", "_gamma"])

    return rows.select("_indices", "_values").mapInArrow(pack, BLOCKS)


def _unpacked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Terms, places, values and topic weights of each block."""
    for known, places, values, gammas in zip(*batch.columns[1:5]):
        yield (np.frombuffer(known.as_buffer(), dtype=np.int32), np.frombuffer(places.as_buffer(), dtype=np.int32),
               np.frombuffer(values.as_buffer(), dtype=np.float64), np.frombuffer(gammas.as_buffer(), dtype=np.float32).reshape(-1, width))


@dataclass(frozen=True)
class TopicModel:
    """Term weights ``weights`` (``k`` by terms) and the priors ``alpha`` (of topics) and ``eta`` (of terms)."""

    weights: np.ndarray
    alpha: np.ndarray
    eta: float

    @property
    def k(self) -> int:
        return len(self.alpha)

    def top_terms(self, n: int) -> list[tuple[int, int, int, float]]:
        """``topic, rank, term, weight``: each topic's ``n`` strongest terms, its weights adding up to one."""
        shares = self.weights / self.weights.sum(axis=1, keepdims=True)
        order = np.argsort(-shares, axis=1, kind="stable")[:, :n]
        return [(t, r + 1, int(term), float(shares[t, term])) for t in range(self.k) for r, term in enumerate(order[t])]

    def _topics(self) -> np.ndarray:
        return np.ascontiguousarray(np.exp(_expected_log(self.weights)).T)

    def transform(self, df: DataFrame, features: str = "features", output: str = "topic_shares") -> DataFrame:
        """Add every row's share of each topic, zeros for a row without a known term."""
        kept = [c for c in df.columns if c != output]
        packed = _sparse_rows(df, features, F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"))
        topics, alpha = self._topics(), self.alpha

        def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.zeros((batch.num_rows, len(alpha)))
                for rows, columns, values in _blocks(*_entries(batch, 1)):
                    gamma = _infer(columns, values, topics, alpha, np.ones((len(rows), len(alpha))))
                    found[rows] = gamma / gamma.sum(axis=1, keepdims=True)
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(alpha))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["_row", output])

        schema = T.StructType([packed.schema["_row"], T.StructField(output, T.ArrayType(T.DoubleType()))])
        return packed.mapInArrow(shared, schema).select("_row.*", output)


def _bounds(blocks: DataFrame, models: list[TopicModel]) -> list[tuple[float, float]]:
    """Lower bound of each model's log likelihood, and minus that by the sum of all values."""
    logs = [np.ascontiguousarray(_expected_log(m.weights).T) for m in models]
    alphas = [m.alpha for m in models]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(alphas) + 1)
        for batch in batches:
            for known, places, values, gammas in _unpacked(batch, sum(map(len, alphas))):
                row, column = np.divmod(places, len(known))
                counts = _matrix(len(gammas), len(known), places, values)
                total[-1] += values.sum()
                low, room = 0, np.empty(counts.shape)
                for number, (log, alpha) in enumerate(zip(logs, alphas)):
                    beta = np.exp(log[known])
                    gamma = _settle(counts, beta, _across(beta), alpha, gammas[:, low:low + len(alpha)], room)
                    low += len(alpha)
                    theta = _expected_log(gamma)
                    both = theta[row] + log[known[column]]
                    most = both.max(axis=1)
                    total[number] += (values * (most + np.log(np.exp(both - most[:, None]).sum(axis=1)))).sum()
                    total[number] += ((alpha - gamma) * theta + log_gamma(gamma) - log_gamma(alpha)).sum()
                    total[number] += (log_gamma(alpha.sum()) - log_gamma(gamma.sum(axis=1))).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["model", "part"])

    parts = blocks.mapInArrow(measured, "model long, part double")
    sums = {r["model"]: r["part"] for r in parts.groupBy("model").agg(F.sum("part").alias("part")).collect()}
    found = []
    for number, (model, log) in enumerate(zip(models, logs)):
        w, eta = model.weights, model.eta
        prior = ((eta - w) * log.T + log_gamma(w) - log_gamma(np.array(eta))).sum()
        prior += (log_gamma(np.array(eta * w.shape[1])) - log_gamma(w.sum(axis=1))).sum()
        bound = float(sums.get(number, 0.0) + prior)
        found.append((bound, -bound / sums[len(models)] if sums.get(len(models)) else float("nan")))
    return found


def _new_alpha(alpha: np.ndarray, logs: np.ndarray, rows: int, step: float) -> np.ndarray:
    """A Newton step of the topics' prior, given the mean expected logarithms of all rows' topics."""
    gradient = rows * (logs - _expected_log(alpha))
    c, q = rows * trigamma(alpha.sum()), -rows * trigamma(alpha)
    b = (gradient / q).sum() / (1 / c + (1 / q).sum())
    moved = alpha - step * (gradient - b) / q
    return moved if (moved > 0).all() else alpha


def _sum(parts: Iterable[pa.Scalar]) -> np.ndarray:
    return sum(np.frombuffer(part.as_buffer()) for part in parts)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _sum(part for batch in batches for part in batch.column(0))
    if isinstance(sums, np.ndarray):
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["_sums"])


def fit_topic_models(features: DataFrame, terms: int, ks: tuple[int, ...], max_iter: int, seed: int = 42,
                     column: str = "features") -> list[tuple[TopicModel, float, float]]:
    """A model per ``k`` with its bound of the log likelihood and its log perplexity, all rows in every pass."""
    spark = features.sparkSession
    width = sum(ks)
    ends = np.cumsum((0, *ks)).tolist()
    models = [TopicModel(np.random.default_rng([seed, k]).gamma(SHAPE, 1 / SHAPE, (k, terms)), np.full(k, 1 / k), 1 / k) for k in ks]
    state = written_table(_packed(_sparse_rows(features, column).filter(F.size("_indices") > 0), width), "lda-blocks")
    n = state.agg(F.sum("_size")).first()[0] or 0
    folders = [f"{shared_folder(spark)}/lda-{uuid.uuid4().hex}" for _ in range(2)]
    names = ["_size", "_known", "_cells", "_values", "_gamma", "_sums"]

    for turn in range(max_iter if n else 0):
        topics, alphas = [m._topics() for m in models], [m.alpha for m in models]

        def inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, logs = np.zeros((terms, width)), np.zeros(width)
            for batch in batches:
                states = []
                for known, places, values, gammas in _unpacked(batch, width):
                    counts, gamma, added = _matrix(len(gammas), len(known), places, values), np.empty(gammas.shape), np.empty((len(known), width))
                    room = np.empty(counts.shape)
                    for low, high, beta, alpha in zip(ends, ends[1:], topics, alphas):
                        own = beta[known]
                        across = _across(own)
                        gamma[:, low:high] = settled = _settle(counts, own, across, alpha, gammas[:, low:high], room)
                        share = _shares(settled)
                        np.divide(counts, np.matmul(share, across, out=room), out=room)
                        added[:, low:high] = room.T @ share
                    logs += digamma(gamma).sum(axis=0)
                    wholes = digamma(np.add.reduceat(gamma, ends[:-1], axis=1)).sum(axis=0)
                    logs -= np.repeat(wholes, ks)
                    total[known] += added
                    states.append(gamma.astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(states, pa.binary()), pa.nulls(batch.num_rows, pa.binary())], names)
            sums = pa.array([np.concatenate((total, logs[None, :])).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.binary())] * 4, sums], names)

        path = folders[turn % 2]
        state.mapInArrow(inferred, f"{BLOCKS}, _sums binary").write.mode("overwrite").parquet(path)
        written = spark.read.schema(f"{BLOCKS}, _sums binary").parquet(path)
        state = written.filter("_sums IS NULL").drop("_sums")
        added = written.filter("_sums IS NOT NULL").select("_sums").coalesce(ADDERS).mapInArrow(_added, "_sums binary").toArrow()
        found = _sum(added.column("_sums")).reshape(terms + 1, width)  # the last row has the logarithms
        step = (OFFSET + turn + 1) ** -DECAY
        models = [
            TopicModel((1 - step) * m.weights + step * (found[:terms, low:high] * beta + m.eta).T,
                       _new_alpha(m.alpha, found[terms, low:high] / n, n, step), m.eta)
            for m, low, high, beta in zip(models, ends, ends[1:], topics)
        ]
    return [(m, *bound) for m, bound in zip(models, _bounds(state, models))]
