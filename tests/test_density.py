"""Density clusters against a brute-force mutual-reachability tree; forests against plain Kruskal."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import clusters, density, neighbours
from colloquy.operators.density import density_clusters


def kruskal(n, edges):
    root, kept = list(range(n)), []

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for w, a, b in sorted(edges):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            kept.append((w, a, b))
    return kept


def reachability(x, samples):
    distance = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    core = np.sort(distance, axis=1)[:, min(samples, len(x) - 1)]
    return np.maximum(distance, np.maximum(core[:, None], core[None, :]))


def brute_labels(n, tree, least):
    """Top-down: walk from the root of the single-linkage tree, splitting where both sides are large."""
    size, sides, at, root = {k: 1 for k in range(n)}, {}, {k: k for k in range(n)}, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    top = 0
    for k, (w, a, b) in enumerate(sorted(tree)):
        x, y = find(a), find(b)
        top = n + k
        sides[top], size[top] = (at[x], at[y], 1 / max(w, 1e-10)), size[at[x]] + size[at[y]]
        root[x] = y
        at[y] = top

    def leaves(node):
        stack, out = [node], []
        while stack:
            v = stack.pop()
            stack.extend(sides[v][:2]) if v in sides else out.append(v)
        return out

    def walk(node, birth):
        gone, now, below = 0.0, node, []
        while True:
            left, right, d = sides[now]
            large = [c for c in (left, right) if size[c] >= least]
            if len(large) == 1:
                gone += (size[now] - size[large[0]]) * d
                now = large[0]
                continue
            gone += size[now] * d
            below = [walk(c, d) for c in large]
            break
        stability = gone - size[node] * birth
        best = sum(v for v, _ in below)
        return (stability, [node]) if stability >= best else (best, [c for _, chosen in below for c in chosen])

    def root_walk(node):
        while True:
            left, right, d = sides[node]
            large = [c for c in (left, right) if size[c] >= least]
            if len(large) == 2:
                return [c for v in large for c in walk(v, d)[1]]
            if not large:
                return []
            node = large[0]

    return {frozenset(leaves(c)) for c in root_walk(top)} if n > 1 else set()


def blobs(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-10, 10, (6, 3))
    spread = np.array([0.3, 0.5, 0.8, 0.4, 1.2, 0.6])
    which = rng.integers(0, 7, n)
    return np.where((which < 6)[:, None], centres[which % 6] + rng.standard_normal((n, 3)) * spread[which % 6][:, None], rng.uniform(-12, 12, (n, 3)))


def frame(spark, x):
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)


@pytest.mark.parametrize("part_edges", [1_000_000, 450])
def test_against_brute_force(spark, part_edges):
    x = blobs(1000)
    found = density_clusters(frame(spark, x), min_cluster_size=25, min_samples=5, local_edges=part_edges).collect()
    tree = kruskal(1000, [(w, a, b) for a, row in enumerate(reachability(x, 5).tolist()) for b, w in enumerate(row) if a < b])
    wanted = brute_labels(1000, tree, 25)
    groups = {}
    for r in found:
        groups.setdefault(r.cluster, set()).add(r.vec_id)
    noise = groups.pop(-1, set())
    assert {frozenset(g) for g in groups.values()} == wanted and len(wanted) >= 4
    assert len(found) == 1000 and 0 < len(noise) < 400 and set(groups) == set(range(len(groups)))


def test_cells_are_bounded_and_whole(spark):
    x = np.vstack([blobs(700, 1), np.ones((400, 3))])  # a third are copies of one vector
    rows = frame(spark, x).select(F.col("vec_id").alias("_id"), F.col("embedding").alias("_v"))
    placed = neighbours.cells(rows, 1100, x.mean(axis=0).tolist(), trees=3, cell_rows=100).collect()
    sizes = {}
    for r in placed:
        sizes.setdefault((r._tree, r._cell), []).append(r._id)
    assert max(map(len, sizes.values())) <= 100 and len(placed) == 3300
    for tree in range(3):
        assert sorted(i for (t, _), ids in sizes.items() if t == tree for i in ids) == list(range(1100))


def test_several_cells_find_the_blobs(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([c + 0.2 * rng.standard_normal((300, 4)) for c in (np.zeros(4), np.full(4, 9.0), np.array([9.0, -9, 9, -9]))])
    found = density_clusters(frame(spark, x), cell_rows=128, trees=4, min_cluster_size=60, min_samples=5).collect()
    by_blob = [{r.cluster for r in found if r.vec_id // 300 == k} - {-1} for k in range(3)]
    assert all(len(s) >= 1 for s in by_blob) and not (by_blob[0] & by_blob[1] or by_blob[1] & by_blob[2] or by_blob[0] & by_blob[2])
    assert sum(r.cluster == -1 for r in found) < 300


def test_neighbours_are_exact_in_one_cell(spark):
    x = blobs(200, 2)
    rows = frame(spark, x).select(F.col("vec_id").alias("_id"), F.col("embedding").alias("_v"))
    found = neighbours.nearest_neighbours(neighbours.cells(rows, 200, [0.0] * 3), 7).collect()
    for r in found:
        d = np.sqrt(((x - x[r._id]) ** 2).sum(axis=1))
        d[r._id] = np.inf
        assert [e.id for e in r.neighbours] == np.argsort(d, kind="stable")[:7].tolist()


@pytest.mark.parametrize("local_edges", [0, 10_000])
def test_spanning_forest_and_components(spark, local_edges):
    rng = random.Random(1)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randrange(15))) for _ in range(90)]
    edges += [(100 + k, 101 + k, 1.0) for k in range(30)] + [(100, 130, 0.5), (7, 7, 0.0)]
    table = spark.createDataFrame(edges, "a long, b long, w double")
    proper = {}
    for a, b, w in edges:
        if a != b:
            key = (min(a, b), max(a, b))
            proper[key] = min(w, proper.get(key, w))
    wanted = kruskal(200, [(w, a, b) for (a, b), w in proper.items()])
    found = sorted((r.w, r.a, r.b) for r in neighbours.spanning_forest(table, local_edges).collect())
    assert found == sorted(wanted)
    label = {r.node: r.component for r in neighbours.components(table, local_edges).collect()}
    parts = {}
    for node, c in label.items():
        parts.setdefault(c, set()).add(node)
    root = {n: n for ab in proper for n in ab}
    for a, b in proper:
        ra, rb = root[a], root[b]
        if ra != rb:
            root = {n: (ra if r == rb else r) for n, r in root.items()}
    groups = {}
    for n, r in root.items():
        groups.setdefault(r, set()).add(n)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, groups.values()))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert density_clusters(empty).columns == ["vec_id", "embedding", "cluster"] and density_clusters(empty).count() == 0
    few = spark.createDataFrame([(1, [0.0, 0.0], 5), (2, None, 5), (3, [0.0, 0.0], 5)], "vec_id long, embedding array<double>, cluster int")
    assert {(r.vec_id, r.cluster) for r in density_clusters(few).collect()} == {(1, -1), (2, -1), (3, -1)}
    copies = spark.createDataFrame([(k, [float(k // 60), 0.0], k) for k in range(180)], "vec_id long, embedding array<double>, _id long")
    rows = density_clusters(copies, min_cluster_size=50).collect()
    assert len({r.cluster for r in rows if r.cluster >= 0}) == 3 and [r.vec_id for r in rows if r._id != r.vec_id] == []
    assert density.NOISE == -1


@pytest.mark.parametrize("stand_ins", [16_384, 60])
def test_euclidean_silhouette_within_its_bound(spark, stand_ins):
    rng = np.random.default_rng(3)
    x = np.vstack([c + s * rng.standard_normal((n, 4)) for c, s, n in ((0, 0.3, 120), (4, 0.5, 90), (9, 0.4, 60))] + [np.full((1, 4), 30.0), np.full((3, 4), -9.0)])
    labels = np.repeat([0, 1, 2, 3, -1], [120, 90, 60, 1, 3])
    rows = [([float(v) for v in row], int(c)) for row, c in zip(x, labels)]
    table = spark.createDataFrame(rows, "embedding array<double>, cluster int").repartition(3)
    kept = labels >= 0
    points, own = x[kept], labels[kept]
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    wanted = []
    for k in range(len(points)):
        if (own == own[k]).sum() == 1:
            wanted.append(0.0)
            continue
        a = distance[k][own == own[k]].sum() / ((own == own[k]).sum() - 1)
        b = min(distance[k][own == c].mean() for c in set(own.tolist()) - {own[k]})
        wanted.append((b - a) / max(a, b))
    row = clusters.euclidean_silhouette(table, stand_ins=stand_ins).first()
    gap = abs(row.silhouette - np.mean(wanted))
    assert gap <= row.silhouette_error + 1e-7 and row.silhouette_error < 0.6
    assert (row.silhouette_error == 0 and gap < 1e-7) if stand_ins > 1000 else row.silhouette_error > 0 and gap < 0.05
