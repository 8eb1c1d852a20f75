"""Whitening of embeddings: exact moments by Spark, eigenvectors by contour integration (FEAST).

Vectors become whole numbers, so that every sum over the rows is exact and does not depend on how rows
are stored. Tasks add up sums and centred products of their rows; what reaches the driver is one number
per dimension and per pair of dimensions, however many rows there are.

The eigenvectors of the largest eigenvalues come from that d x d covariance. Inertia counts (the signs of
a symmetric factorisation of V - sI) place the end of the interval in a gap of the spectrum. Quadrature
over a circle around the interval, one complex shifted solve per node, projects a seeded block onto its
eigenvectors; Rayleigh-Ritz extracts them, and rounds go on until residuals are at rounding level. The
number found must be the number that inertia counts in the interval, else the block grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import use_utc, written_table

SCALE = 1024
SHIFT = 100_000
LIMB = 20
ROWS = 4096
LONG_MAX = 2**63 - 1


def negatives(matrix: np.ndarray) -> int:
    """Number of negative eigenvalues of a symmetric matrix, by symmetric elimination with full pivoting.

    A 1 x 1 pivot counts by its sign; a 2 x 2 pivot is indefinite, so it counts one.
    """
    a = matrix.astype(np.float64, copy=True)
    found = 0
    while (size := len(a)):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        r, s = divmod(int(off.argmax()), size)
        if diagonal[p] == 0 and off[r, s] == 0:
            return found
        if diagonal[p] >= 0.6404 * off[r, s]:
            chosen = [p]
            found += int(a[p, p] < 0)
        else:
            chosen = [r, s]
            found += 1
        rest = np.setdiff1d(np.arange(size), chosen)
        column = a[np.ix_(rest, chosen)]
        a = a[np.ix_(rest, rest)] - column @ np.linalg.solve(a[np.ix_(chosen, chosen)], column.T)
    return found


def above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues over ``shift``."""
    return negatives(shift * np.eye(len(matrix)) - matrix)


def interval(matrix: np.ndarray, wanted: int, extra: int = 8, steps: int = 44) -> tuple[float, float, int]:
    """An interval with the ``wanted`` largest eigenvalues and at most ``extra`` more, and how many it holds.

    Its lower end is in the middle of the widest gap below the wanted ones, found by bisection on counts.
    """
    size = len(matrix)
    bound = float(np.abs(matrix).sum(axis=1).max()) or 1.0
    margin = 1e-3 * bound
    places = []
    for k in range(min(wanted, size), min(wanted + extra + 1, size) + 1):
        low, high = -margin, bound + margin
        for _ in range(steps):  # the k-th largest eigenvalue is between low and high
            middle = (low + high) / 2
            low, high = (middle, high) if above(matrix, middle) >= k else (low, middle)
        places.append((low + high) / 2)
    top_low, top_high = -margin, bound + margin
    for _ in range(12):
        middle = (top_low + top_high) / 2
        top_low, top_high = (middle, top_high) if above(matrix, middle) >= 1 else (top_low, middle)
    if wanted >= size:
        return min(places[-1], 0.0) - margin, top_high + margin, size
    gaps = [a - b for a, b in zip(places, places[1:])]
    best = int(np.argmax(gaps))
    end = (places[best] + places[best + 1]) / 2
    return end, top_high + 0.01 * (top_high - end), above(matrix, end)


def feast(matrix: np.ndarray, low: float, high: float, count: int, nodes: int = 8, rounds: int = 80,
          seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high), falling, and their unit eigenvectors as columns; ``count`` of them exist."""
    size = len(matrix)
    block = min(size, max(2 * count, count + 10))
    points, weights = np.polynomial.legendre.leggauss(nodes)
    turns = np.exp(-0.5j * np.pi * (points - 1))
    centre, radius = (low + high) / 2, (high - low) / 2
    shifted = [(centre + radius * t) * np.eye(size) - matrix for t in turns]
    norm = float(np.linalg.norm(matrix, 2)) or 1.0
    while True:
        basis = np.random.default_rng(seed).standard_normal((size, block))
        best = (np.inf, None, None)
        stale = 0
        for _ in range(rounds):
            projected = np.zeros((size, block))
            for turn, weight, factor in zip(turns, weights, shifted):
                projected += 0.5 * weight * (radius * turn * np.linalg.solve(factor, basis.astype(complex))).real
            q, _ = np.linalg.qr(projected)
            ritz, inner = np.linalg.eigh(q.T @ matrix @ q)
            basis = q @ inner
            inside = np.flatnonzero((ritz > low) & (ritz < high))[::-1]
            if len(inside) == count:
                found, vectors = ritz[inside], basis[:, inside]
                residual = float(np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max())
                stale = stale + 1 if residual > 0.5 * best[0] else 0
                if residual < best[0]:
                    best = (residual, found, vectors)
                if residual <= 1e-15 * norm or stale >= 4 and best[0] <= 1e-11 * norm:
                    break
        if best[0] <= 1e-9 * norm:
            return best[1], best[2]
        if block == size:
            raise ArithmeticError(f"{count} eigenvalues are counted in the interval, and not all are found")
        block = min(size, 2 * block)


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, with unit eigenvectors; none that is zero but for rounding."""
    scale = float(np.abs(matrix).max(initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((len(matrix), 0))
    values, vectors = feast(matrix / scale, *interval(matrix / scale, wanted))
    values, vectors = values[:wanted], vectors[:, :wanted]
    kept = values > len(matrix) * 1e-14 * values[0]
    values, vectors = values[kept] * scale, vectors[:, kept]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])


def _rows(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return np.asarray(batch.column("_x").flatten()).reshape(batch.num_rows, size)


def _exact_sums(x: np.ndarray) -> list[int]:
    low = (1 << 26) - 1
    return [(int(h) << 26) + int(w) for h, w in zip((x >> 26).sum(axis=0), (x & low).sum(axis=0))]


def _exact_products(y: np.ndarray) -> np.ndarray:
    """y.T @ y in whole numbers: limbs are so short that doubles hold every sum of a chunk exactly."""
    size = y.shape[1]
    total = np.zeros((size, size), dtype=object)
    for start in range(0, len(y), ROWS):
        rest, limbs = y[start:start + ROWS], []
        while np.abs(rest).max(initial=0) >= 1 << LIMB:
            limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
            rest = rest >> LIMB
        limbs.append(rest.astype(np.float64))
        for i, left in enumerate(limbs):
            for j, right in enumerate(limbs):
                part = (left.T @ right).astype(np.int64).astype(object)
                total = total + (part << (LIMB * (i + j)) if i + j else part)
    return total


def _moments(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * size
        for batch in batches:
            n += batch.num_rows
            sums = [a + b for a, b in zip(sums, _exact_sums(_rows(batch, size)))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, size), pa.int32()), pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38))], ["i", "v"]
        )

    added = fit.select("_x").mapInArrow(partial, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    found = {r["i"]: int(r["v"]) for r in added.collect()}
    return found[-1], [found[i] for i in range(size)]


def _products(fit: DataFrame, size: int, centre: list[int]) -> dict[tuple[int, int], int]:
    """Sums over all rows of the products of pairs of entries, less ``centre``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), dtype=object)
        for batch in batches:
            total = total + _exact_products(_rows(batch, size) - np.array(centre, dtype=np.int64))
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38))],
            ["i", "j", "v"],
        )

    rows = fit.select("_x").mapInArrow(partial, "i int, j int, v decimal(38,0)")
    added = rows.groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    return {(r["i"], r["j"]): int(r["v"]) for r in added.collect()}


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 8) -> DataFrame:
    """One row per usable row and component: id, ``component`` from 1, ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``.

    An entry c counts as x = floor(1024 c) + 100000. Rows whose vector is missing or holds a missing or
    non-finite entry (or one beyond 2^42, which doubles cannot place) are dropped, and so are
    vectors whose length is not the most common one (of equally common ones the longest). Everything else
    is the fit list: a row without an id and rows that repeat count as they stand. Components whose
    eigenvalue is zero but for rounding do not exist: a table of equal vectors, of one vector, or without
    any gives no rows. ``deviation`` is exact, and missing where it does not fit a long. Equal eigenvalues
    share a space in which any basis is right. Other columns are not read.
    """
    use_utc(df.sparkSession)
    kind = dict(df.dtypes)[id_column]
    result = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = df.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("_v"))
    usable = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(2**42)))
    whole = F.transform("_v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    fit = written_table(
        vectors.filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & usable).select("_id", whole.alias("_x")), "whitening-fit"
    )
    common = fit.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return df.sparkSession.createDataFrame([], result)
    size = common["d"]
    fit = fit.filter(F.size("_x") == size)
    n, sums = _moments(fit, size)
    centre = [s // n for s in sums]
    left = [s - n * c for s, c in zip(sums, centre)]  # sums of the centred entries
    added = _products(fit, size, centre)
    covariance = np.zeros((size, size))
    for (i, j), v in added.items():
        covariance[i, j] = covariance[j, i] = (n * v - left[i] * left[j]) / (n * n)
    values, axes = leading(covariance, components)
    if not len(values):
        return df.sparkSession.createDataFrame([], result)
    trace = float(sum((n * added[i, i] - left[i] * left[i]) for i in range(size)) / (n * n))
    whitener = axes / np.sqrt(values)
    offset = np.array([v / n for v in left])
    middle, remainder = np.array(centre, dtype=np.int64), np.array(left, dtype=object)
    long_left = remainder.astype(np.int64) if max(map(abs, left)) < 2**62 else None

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _rows(batch, size) - middle
            widest = n * int(np.abs(y).max(initial=0)) + max(map(abs, left))
            if long_left is not None and widest * widest * size <= LONG_MAX:
                deviation = ((n * y - long_left) ** 2).sum(axis=1).tolist()
            else:
                deviation = [sum((n * int(a) - t) ** 2 for a, t in zip(row, left)) for row in y]
            out = (y - offset) @ whitener
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), pa.array([v if v <= LONG_MAX else None for v in deviation], pa.int64()),
                    pa.array(list(out), pa.list_(pa.float64())),
                ],
                ["_id", "_deviation", "_w"],
            )

    white = written_table(fit.mapInArrow(projected, f"_id {kind}, _deviation long, _w array<double>"), "whitened")
    error = _identity_error(white, len(values), n)
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    return white.select("_id", "_deviation", F.posexplode("_w").alias("_k", "_value")).select(
        F.col("_id").alias(id_column), (F.col("_k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
        F.col("_deviation").alias("deviation"), F.col("_value").alias("whitened"), F.get(shares, F.col("_k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _identity_error(white: DataFrame, k: int, n: int) -> float:
    """Largest entry, by size, of the covariance of the whitened rows less the identity."""

    def added(rows: DataFrame, centre: np.ndarray, products: bool) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k) if products else k)
            for batch in batches:
                w = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, k) - centre
                total += w.T @ w if products else w.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["i", "v"])

        sums = rows.select("_w").mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(sums, key=lambda r: r["i"])])

    mean = added(white, np.zeros(k), False) / n
    covariance = added(white, mean, True).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())
