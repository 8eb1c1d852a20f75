"""Cells of near vectors, the nearest-neighbour graph, and minimum spanning forests.

A tree of cells sorts all vectors by the signs of a few random projections, then by one more projection, and
cuts that order into cells of equal size. No cell is larger than its bound, whatever the vectors: copies
of one vector, a third of the table, fill as many cells as they need. Several trees with projections of
their own put rows that one tree parts into a common cell of another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.operators.sequences import POSITION_BITS
from colloquy.session import written_table

CELL_ROWS = 1024
TREES = 4
LOCAL_EDGES = 1_000_000


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """0-based positions within each group, by a range sort; no task holds a group.

    The sorted rows are written with their partition and position. What is added up over partitions is one
    row per partition and group in it.
    """
    keys = [*groups, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    rows = written_table(rows, "ranked")
    part = F.shiftright("_mid", POSITION_BITS)
    sizes = rows.groupBy(*groups, part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_mid").alias("_first"))
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    joined = rows.withColumn("_part", part).join(F.broadcast(offsets), [*groups, "_part"])
    return joined.withColumn(name, F.col("_before") + F.col("_mid") - F.col("_first")).drop("_mid", "_part", "_first", "_before")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def cells(vectors: DataFrame, n: int, mean: list[float], trees: int = TREES, cell_rows: int = CELL_ROWS,
          seed: int = 42) -> DataFrame:
    """``_tree, _cell, _id, _v``: every vector once per tree, at most ``cell_rows`` to a cell.

    ``vectors``: ``_id`` (unique long) and ``_v`` (array<double> of equal lengths). One cell, in one tree, if
    that holds all ``n``.
    """
    count = max(1, math.ceil(n / cell_rows))
    if count == 1:
        return vectors.select(F.lit(0).alias("_tree"), F.lit(0).cast("long").alias("_cell"), "_id", "_v")
    bits = min(30, math.ceil(math.log2(count)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1)) - np.array(mean)
            for tree in range(trees):
                axes = np.random.default_rng([seed, tree]).standard_normal((len(mean), bits + 1))
                projected = x @ axes
                code = ((projected[:, :bits] > 0) << np.arange(bits)).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(x), tree, dtype=np.int32)), pa.array(code.astype(np.int64)),
                        pa.array(projected[:, bits]), batch.column(0), batch.column(1),
                    ],
                    ["_tree", "_code", "_at", "_id", "_v"],
                )

    coded_rows = vectors.select("_id", "_v").mapInArrow(coded, "_tree int, _code long, _at double, _id long, _v array<double>")
    # Copies of a vector are shuffled anew in every tree, or its cells would never meet.
    shuffled = coded_rows.withColumn("_tie", F.xxhash64("_tree", "_id"))
    placed = ranked(shuffled, ["_tree"], ["_code", "_at", "_tie", "_id"], "_rank")
    return placed.select("_tree", F.floor(F.col("_rank") * count / n).cast("long").alias("_cell"), "_id", "_v")


def _distances(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=0)
    squares = (x * x).sum(axis=1)
    found = squares[:, None] + squares[None, :] - 2 * (x @ x.T)
    np.fill_diagonal(found, 0.0)
    return np.sqrt(np.maximum(found, 0.0))


def nearest_neighbours(placed: DataFrame, k: int) -> DataFrame:
    """``_id``, ``neighbours`` (the ``k`` nearest met in any cell, ``distance`` and ``id``, nearest first).

    ``placed`` comes from :func:`cells`. Exact where one cell holds all rows. Equal distances go by id.
    """
    entry = pa.list_(pa.struct([("distance", pa.float64()), ("id", pa.int64())]))
    schema = "_id long, neighbours array<struct<distance:double,id:long>>"

    def inside(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("_id"))
        order = np.argsort(ids, kind="stable")
        ids, distances = ids[order], _distances(_matrix(table.column("_v"))[order])
        np.fill_diagonal(distances, np.inf)
        kept = min(k, len(ids) - 1)
        near = np.argsort(distances, axis=1, kind="stable")[:, :kept]
        values = pa.StructArray.from_arrays(
            [pa.array(np.take_along_axis(distances, near, axis=1).ravel()), pa.array(ids[near].ravel())], ["distance", "id"]
        )
        offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * kept)
        return pa.table({"_id": pa.array(ids), "neighbours": pa.ListArray.from_arrays(offsets, values)})

    found = placed.groupBy("_tree", "_cell").applyInArrow(inside, schema)
    lists = found.groupBy("_id").agg(F.flatten(F.collect_list("neighbours")).alias("neighbours"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(low, 1024) for whole in batches for low in range(0, whole.num_rows, 1024)):
            rows = []
            for met in batch.column(1).to_pylist():
                nearest: dict[int, float] = {}
                for e in met:
                    nearest[e["id"]] = min(e["distance"], nearest.get(e["id"], math.inf))
                chosen = sorted((d, i) for i, d in nearest.items())[:k]
                rows.append([{"distance": d, "id": i} for d, i in chosen])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, entry)], ["_id", "neighbours"])

    return lists.mapInArrow(best, schema)


def cell_edges(placed: DataFrame, core: DataFrame) -> DataFrame:
    """``a, b, w``: each cell's minimum spanning tree by mutual reachability.

    The weight of a pair is its distance or the larger of its two core distances; equal weights go by ``a``,
    then ``b``. The minimum spanning forest of all pairs that share a cell uses no other edges than these.
    """

    def tree(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("_id"))
        order = np.argsort(ids, kind="stable")
        ids, core_of = ids[order], np.asarray(table.column("_core"))[order]
        weights = np.maximum(_distances(_matrix(table.column("_v"))[order]), np.maximum(core_of[:, None], core_of[None, :]))
        n = len(ids)
        places = np.arange(n)
        best, source, pair = weights[0].copy(), np.zeros(n, dtype=np.int64), places.copy()
        outside = places > 0
        best[0] = np.inf
        a, b, w = [], [], []
        for _ in range(n - 1):
            lightest = np.flatnonzero(best == best.min())
            new = int(lightest[np.argmin(pair[lightest])])
            a.append(ids[source[new]])
            b.append(ids[new])
            w.append(best[new])
            outside[new] = False
            best[new] = np.inf
            own = np.minimum(places, new) * n + np.maximum(places, new)
            closer = outside & ((weights[new] < best) | ((weights[new] == best) & (own < pair)))
            best[closer], pair[closer], source[closer] = weights[new][closer], own[closer], new
        return pa.table({
            "a": pa.array(np.minimum(a, b).astype(np.int64)), "b": pa.array(np.maximum(a, b).astype(np.int64)),
            "w": pa.array(np.array(w, dtype=np.float64)),
        })

    rows = placed.join(core, "_id").select("_tree", "_cell", "_id", "_v", "_core")
    return rows.groupBy("_tree", "_cell").applyInArrow(tree, "a long, b long, w double")


def _kruskal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = list(batches)
    if not rows:
        return
    held = pa.Table.from_batches(rows)
    columns = {name: np.asarray(held.column(name)) for name in held.column_names}
    order = np.lexsort((columns["b"], columns["a"], columns["w"]))
    nodes, places = np.unique(np.concatenate((columns["ca"], columns["cb"])), return_inverse=True)
    left, right = places[:held.num_rows].tolist(), places[held.num_rows:].tolist()
    root = list(range(len(nodes)))
    kept = []
    for e in order.tolist():
        x, y = left[e], right[e]
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(e)
    yield pa.RecordBatch.from_arrays([pa.array(columns[c][kept]) for c in ("a", "b", "w")], ["a", "b", "w"])


def _roots(parents: DataFrame) -> DataFrame:
    """``c, root`` from ``c, parent``: pointers are doubled until none moves."""
    current = written_table(parents.select("c", F.col("parent").alias("root")), "roots")
    while True:
        further = current.select(F.col("c").alias("root"), F.col("root").alias("_next"))
        moved = written_table(current.join(further, "root").select("c", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")), "roots")
        if moved.filter("_moved").isEmpty():
            return moved.select("c", "root")
        current = moved.select("c", "root")


def spanning_forest(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``a, b, w`` of a minimum spanning forest, by Boruvka rounds over written edges.

    Every component takes its lightest edge (ties by ``a``, ``b``), components merge by pointer doubling, and of
    edges between the same two components the lightest stays. When ``local_edges`` or fewer are left, one
    task finishes them; their number is counted before.
    """
    lightest = F.min(F.struct("w", "a", "b")).alias("_e")
    edges = edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    edges = written_table(
        edges.groupBy("a", "b").agg(F.min("w").alias("w")).select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")),
        "forest-edges",
    )
    found = []
    while edges.count() > local_edges:
        both = edges.select(F.col("ca").alias("c"), F.col("cb").alias("o"), "w", "a", "b").unionByName(
            edges.select(F.col("cb").alias("c"), F.col("ca").alias("o"), "w", "a", "b")
        )
        best = written_table(
            both.groupBy("c").agg(F.min(F.struct("w", "a", "b", "o")).alias("_e")).select("c", "_e.*"), "forest-chosen"
        )
        found.append(best.select("a", "b", "w"))
        other = best.select(F.col("c").alias("o"), F.col("o").alias("_back"))
        parents = best.join(other, "o").select(
            "c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("parent")
        )
        roots = _roots(parents)
        moved = edges.join(roots.toDF("ca", "_ra"), "ca").join(roots.toDF("cb", "_rb"), "cb").filter("_ra != _rb")
        moved = moved.select(F.least("_ra", "_rb").alias("ca"), F.greatest("_ra", "_rb").alias("cb"), "w", "a", "b")
        edges = written_table(moved.groupBy("ca", "cb").agg(lightest).select("_e.a", "_e.b", "_e.w", "ca", "cb"), "forest-edges")
    last = edges.repartition(1).mapInArrow(_kruskal, "a long, b long, w double")
    for chosen in found:
        last = last.unionByName(chosen)
    return last.distinct()


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``node, component`` (a member) of the nodes of ``a, b`` edges."""
    edges = edges.select("a", "b").filter("a != b")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    labels = written_table(labels, "components")
    edges = written_table(edges.select(F.col("a").alias("ca"), F.col("b").alias("cb")).distinct(), "component-edges")
    while not edges.isEmpty():
        if edges.count() <= local_edges:
            parents = edges.repartition(1).mapInArrow(_joined, "c long, parent long")
        else:
            both = edges.select(F.col("ca").alias("c"), F.col("cb").alias("o")).union(edges.select("cb", "ca"))
            parents = both.groupBy("c").agg(F.min("o").alias("o")).select("c", F.least("c", "o").alias("parent"))
        roots = _roots(parents)
        labels = written_table(
            labels.join(roots.toDF("component", "_root"), "component", "left").select("node", F.coalesce("_root", "component").alias("component")),
            "components",
        )
        moved = edges.join(roots.toDF("ca", "_ra"), "ca").join(roots.toDF("cb", "_rb"), "cb").filter("_ra != _rb")
        edges = written_table(moved.select(F.least("_ra", "_rb").alias("ca"), F.greatest("_ra", "_rb").alias("cb")).distinct(), "component-edges")
    return labels


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in root], pa.int64())], ["c", "parent"])
