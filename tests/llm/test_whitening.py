"""Whitening against a dense eigensolver and exact arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import whitening
from colloquy.llm.whitening import above, feast, interval, leading, whiten

SCHEMA = "vec_id long, embedding array<float>"


def vectors(n=300, d=12, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.linspace(1, 4, d)).astype(np.float32) @ np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.float32)


def test_against_dense_solver(spark):
    data = vectors()
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(data)]
    odd = [(900, None), (901, [None] + [1.0] * 11), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, []), (905, [1.0]), (None, rows[0][1]), (7, rows[7][1])]
    frame = spark.createDataFrame(rows + odd, SCHEMA).repartition(3).withColumns({"n": F.lit(1), "_x": F.lit("x"), "component": F.lit(2)})
    found = whiten(frame).collect()
    used = rows + odd[-2:]
    x = np.floor(1024 * np.array([np.float32(v) for _, v in used]).astype(float)).astype(np.int64) + 100000
    n, sums = len(used), x.sum(axis=0)
    values, axes = np.linalg.eigh((x - sums / n).T @ (x - sums / n) / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(found) == 8 * n and {r.component for r in found} == set(range(1, 9))
    assert {r.n for r in found} == {n} and {r.vec_id for r in found} == {i for i, _ in used}
    exact = {i: sum(int(n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for (i, _), row in zip(used, x)}
    assert all(r.deviation == exact[r.vec_id] for r in found)
    place = {i: k for k, (i, _) in enumerate(used)}
    for c in range(8):
        own = [r for r in found if r.component == c + 1]
        got = np.array([r.whitened for r in own])
        want = ((x - sums / n) @ axes[:, c] / np.sqrt(values[c]))[[place[r.vec_id] for r in own]]
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert own[0].explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert max(r.identity_error for r in found) < 1e-9


def test_intervals_and_counts():
    rng = np.random.default_rng(1)
    axes = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    for spectrum in (np.arange(20.0), np.r_[[5.0] * 10, [1.0] * 10], np.r_[[1e6, 3.0, 3.0], np.linspace(1, 2, 17)], np.r_[1.0, np.zeros(19)]):
        matrix = axes * spectrum @ axes.T
        matrix = (matrix + matrix.T) / 2
        for shift in (0.5, 1.55, 4.5):
            assert above(matrix, shift) == (spectrum > shift).sum()
        low, high, count = interval(matrix / np.abs(matrix).max(), 8)
        found, q = feast(matrix / np.abs(matrix).max(), low, high, count)
        assert len(found) == count >= 8 and np.allclose(q.T @ q, np.eye(count), atol=1e-12)
        values, _ = leading(matrix, 8)
        wanted = np.sort(spectrum)[::-1][:8]
        assert np.allclose(values, wanted[wanted > 1e-9], rtol=1e-9)


@pytest.mark.parametrize("rows, components", [([], 0), ([(1, [1.0, 2.0])], 0), ([(1, [1.0, 2.0])] * 5, 0), ([(1, None)], 0),
                                              ([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 5.0])], 1)])
def test_few_rows_and_dimensions(spark, rows, components):
    found = whiten(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(found.collect()) == components * len(rows)


def test_large_entries_are_exact():
    y = np.array([[2**52 - 1, -3], [-(2**50), 2**41 + 1], [5, -1]], dtype=np.int64)
    wanted = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(2)] for i in range(2)]
    assert whitening._exact_products(y).tolist() == wanted


def test_deviation_beyond_a_long_is_missing(spark):
    found = whiten(spark.createDataFrame([(1, [1e9, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in found} == {None} and len(found) == 3  # the second axis is lost in rounding
