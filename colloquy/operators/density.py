"""Clusters of varying density: a condensed tree over a minimum spanning forest by mutual reachability.

1. Cells of near vectors give the nearest-neighbour graph and each row's core distance, the distance to its
   ``min_samples``-th neighbour (``operators/neighbours.py``).
2. The weight of a pair is its distance or the larger core distance. Spanning trees of the cells, joined by
   Boruvka rounds, give one spanning forest.
3. Its edges are merged from the lightest to the heaviest, in levels: a level takes so many edges that no
   connected part of it has more than ``part_edges``; parts are merged apart from each other, and the level
   above sees each as one node with its size and open cluster. Where two nodes of ``min_cluster_size`` rows or
   more meet, both clusters end and a new one begins; smaller nodes fall into the cluster they meet, or begin
   one when together they are large enough.
4. A cluster's stability is the sum over its rows of 1/weight where they leave it, less 1/weight where it
   begins. A cluster is chosen if it is at least as stable as the best choice below it; the topmost chosen ones
   are the result. Rows in none, and the root, are noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.arrays import doubles, vector_mean
from colloquy.operators.neighbours import (
    CELL_ROWS, LOCAL_EDGES, TREES, cell_edges, cells, components, nearest_neighbours, ranked, spanning_forest,
)
from colloquy.session import written_table

NOISE = -1
LEAST_WEIGHT = 1e-10  # copies are at distance zero; their density stays finite
EVENTS = "kind string, node long, root long, cluster long, parent long, size long, gone double, below double, chosen boolean"


class _Node:
    """A connected part: rows in it, and the cluster that is open in it, if any."""

    __slots__ = ("size", "cluster", "gone", "below")

    def __init__(self, size: int, cluster: int | None, gone: float, below: float) -> None:
        self.size, self.cluster, self.gone, self.below = size, cluster, gone, below


class _Merger:
    """Merges edges in the order of their weight; see the module's third step.

    ``gone`` adds up 1/weight at which rows have left the open cluster; ``below`` is the best that clusters
    under it give. A cluster is named by the edge that begins it: ``edge``, unique and rising with the weight.
    """

    def __init__(self, least: int) -> None:
        self.least = least
        self.root: dict[int, int] = {}
        self.nodes: dict[int, _Node] = {}
        self.waiting: dict[int, list[int]] = {}  # nodes of a part without a cluster
        self.events: list[tuple] = []

    def node(self, name: int, size: int, cluster: int | None, gone: float, below: float) -> int:
        if name not in self.root:
            self.root[name] = name
            self.nodes[name] = _Node(size, cluster, gone, below)
            if cluster is None:
                self.waiting[name] = [name]
            return name
        while self.root[name] != name:
            self.root[name] = name = self.root[self.root[name]]
        return name

    def merge(self, x: int, y: int, weight: float, edge: int) -> None:
        a, b = self.nodes[x], self.nodes[y]
        density = 1.0 / max(weight, LEAST_WEIGHT)
        size = a.size + b.size
        if a.cluster is not None and b.cluster is not None:
            below = self.close(a, edge, density) + self.close(b, edge, density)
            merged = _Node(size, edge, size * density, below)
        elif a.cluster is not None or b.cluster is not None:
            large, small, where = (a, b, y) if a.cluster is not None else (b, a, x)
            merged = _Node(size, large.cluster, large.gone + small.size * density, large.below)
            self.join(where, large.cluster)
        elif size >= self.least:
            merged = _Node(size, edge, size * density, 0.0)
            self.join(x, edge)
            self.join(y, edge)
        else:
            merged = _Node(size, None, 0.0, 0.0)
        keep, other = (x, y) if len(self.waiting.get(x, ())) >= len(self.waiting.get(y, ())) else (y, x)
        if merged.cluster is None:
            self.waiting[keep].extend(self.waiting.pop(other))
        self.root[other] = keep
        self.nodes[keep] = merged
        del self.nodes[other]

    def close(self, node: _Node, parent: int | None, density: float) -> float:
        stability = node.gone - node.size * density
        chosen = stability >= node.below
        self.events.append(("cluster", None, None, node.cluster, parent, node.size, None, None, chosen))
        return max(stability, node.below)

    def join(self, root: int, cluster: int) -> None:
        self.events.extend(("member", name, None, cluster, None, None, None, None, None) for name in self.waiting.pop(root))

    def parts(self) -> Iterator[tuple]:
        """What the next level needs: every node's root, and each root's state."""
        for name in self.root:
            root = self.node(name, 0, None, 0.0, 0.0)
            yield ("moved", name, root, None, None, None, None, None, None)
        for name, n in self.nodes.items():
            yield ("part", name, None, n.cluster, None, n.size, n.gone, n.below, None)


def _merge_level(edges: DataFrame, least: int) -> DataFrame:
    """Events of merging the edges of a level; ``edges`` have the state of both ends, and ``component``."""
    types = [pa.string(), *[pa.int64()] * 5, pa.float64(), pa.float64(), pa.bool_()]
    names = [part.split()[0] for part in EVENTS.split(", ")]

    def batch(events: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*events), types)], names)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _Merger(least)
        for rows in batches:
            for rank, a, b, w, sa, ca, ga, ba, sb, cb, gb, bb in zip(*[rows.column(k).to_pylist() for k in range(rows.num_columns)]):
                merger.merge(merger.node(a, sa, ca, ga, ba), merger.node(b, sb, cb, gb, bb), w, rank)
            if len(merger.events) > 50_000:
                yield batch(merger.events)
                merger.events = []
        rest = chain(merger.events, merger.parts())
        while part := list(islice(rest, 50_000)):
            yield batch(part)

    ordered = edges.repartition("component").sortWithinPartitions("rank")
    side = ["size", "cluster", "gone", "below"]
    return ordered.select("rank", "a", "b", "w", *[f"{end}_{c}" for end in "ab" for c in side]).mapInArrow(merged, EVENTS)


def condensed_tree(forest: DataFrame, min_cluster_size: int, part_edges: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame]:
    """Clusters ``cluster, parent, size, chosen`` and members ``node, cluster`` of a spanning forest ``a, b, w``.

    Clusters that are open when the edges end have no parent: the root, or, of a forest in several parts
    with clusters, the children of a root at density zero. The root is not chosen.
    """
    edges = written_table(ranked(forest, [], ["w", "a", "b"], "rank").select("rank", "a", "b", "w"), "tree-edges")
    total = edges.count()
    clusters, members, state, low = [], [], None, 0
    moves: list[DataFrame] = []
    while low < total:
        width = total - low
        while True:
            level = edges.filter((F.col("rank") >= low) & (F.col("rank") < low + width))
            if width <= part_edges:  # the whole level is small enough for one task
                joined = level.withColumn("component", F.lit(0).cast("long"))
                break
            labels = components(level).select(F.col("node").alias("a"), "component")
            joined = level.join(labels, "a")
            if joined.groupBy("component").count().filter(F.col("count") > part_edges).isEmpty():
                break
            width = max(part_edges, width // 2)
        for end in "ab":
            if state is None:
                known = joined.withColumns({f"{end}_size": F.lit(1).cast("long"), f"{end}_cluster": F.lit(None).cast("long"),
                                            f"{end}_gone": F.lit(0.0), f"{end}_below": F.lit(0.0)})
            else:
                side = state.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("size", "cluster", "gone", "below")])
                known = joined.join(side, end, "left").withColumns({
                    f"{end}_size": F.coalesce(f"{end}_size", F.lit(1).cast("long")), f"{end}_gone": F.coalesce(f"{end}_gone", F.lit(0.0)),
                    f"{end}_below": F.coalesce(f"{end}_below", F.lit(0.0)),
                })
            joined = known
        events = written_table(_merge_level(joined, min_cluster_size), "tree-events")
        clusters.append(events.filter("kind = 'cluster'").select("cluster", "parent", "size", "chosen"))
        members.append(events.filter("kind = 'member'").select("node", "cluster"))
        moved = events.filter("kind = 'moved'").select("node", "root")
        moves.append(moved)
        fresh = events.filter("kind = 'part'").select("node", "size", "cluster", "gone", "below")
        if state is not None:
            fresh = fresh.unionByName(state.join(moved, "node", "left_anti"))
        state = written_table(fresh, "tree-parts")
        low += width
        if low < total:
            for end in "ab":
                renamed = moved.select(F.col("node").alias(end), F.col("root").alias("_root"))
                edges = edges.filter(F.col("rank") >= low).join(renamed, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
            edges = written_table(edges.select("rank", "a", "b", "w"), "tree-edges")
    if state is None:
        spark = forest.sparkSession
        return (spark.createDataFrame([], "cluster long, parent long, size long, chosen boolean"),
                spark.createDataFrame([], "node long, cluster long"))
    remaining = state.filter("cluster IS NOT NULL")
    several = remaining.limit(2).count() > 1
    clusters.append(remaining.select(
        "cluster", F.lit(None).cast("long").alias("parent"), "size", (F.lit(several) & (F.col("gone") >= F.col("below"))).alias("chosen")
    ))
    # Nodes of a level stand for rows of the first one: follow the moves of the levels between.
    found, at = None, None
    for level, moved in enumerate(moves):
        if at is None:
            at = moved.select("node", F.col("node").alias("_at"))
        else:
            at = at.unionByName(moved.join(at, "node", "left_anti").select("node", F.col("node").alias("_at")))
        own = members[level].select(F.col("node").alias("_at"), "cluster")
        here = at.join(own, "_at").select("node", "cluster")
        found = here if found is None else found.unionByName(here)
        if level + 1 == len(moves):
            break
        left = at.join(own, "_at", "left_anti").join(moved.select(F.col("node").alias("_at"), "root"), "_at", "left")
        at = written_table(left.select("node", F.coalesce("root", "_at").alias("_at")), "tree-rows")
    every = clusters[0]
    for part in clusters[1:]:
        every = every.unionByName(part)
    return every, found


def topmost(clusters: DataFrame) -> DataFrame:
    """``cluster, label``: of each cluster, the topmost chosen one on the way to the root, itself included."""
    state = written_table(
        clusters.select("cluster", F.when(F.col("chosen"), F.col("cluster")).alias("label"), F.col("parent").alias("_up")), "cluster-tops"
    )
    while not state.filter("_up IS NOT NULL").isEmpty():
        above = state.select(F.col("cluster").alias("_up"), F.col("label").alias("_label"), F.col("_up").alias("_next"))
        state = written_table(
            state.join(above, "_up", "left").select("cluster", F.coalesce("_label", "label").alias("label"), F.col("_next").alias("_up")),
            "cluster-tops",
        )
    return state.select("cluster", "label")


def density_clusters(
    vectors: DataFrame, vector_column: str = "embedding", output: str = "cluster", min_cluster_size: int = 50,
    min_samples: int = 10, trees: int = TREES, cell_rows: int = CELL_ROWS, local_edges: int = LOCAL_EDGES, seed: int = 42,
) -> DataFrame:
    """The rows with a cluster number from 0, or -1 for noise, in ``output``.

    Exact for tables of up to ``cell_rows`` rows. Beyond, pairs are compared that share a cell in one of
    ``trees`` trees. Rows without a vector are noise. Clusters are numbered by their first merge, the densest
    first. Vectors must have equal lengths.
    """
    packed = vectors.select(
        F.monotonically_increasing_id().alias("_id"), doubles(F.col(f"`{vector_column}`")).alias("_v"),
        F.struct(*[F.col(f"`{c}`") for c in vectors.columns if c != output]).alias("_row"),
    )
    rows = written_table(packed, "density-rows")
    usable = rows.filter("_v IS NOT NULL").select("_id", "_v")
    n = usable.count()
    if not n:
        return rows.select("_row.*", F.lit(NOISE).alias(output))
    mean = usable.agg(vector_mean(F.col("_v"))).first()[0]
    placed = written_table(cells(usable, n, list(mean), trees, cell_rows, seed), "density-cells")
    neighbours = nearest_neighbours(placed, min_samples)
    farthest = F.coalesce(F.element_at("neighbours.distance", -1), F.lit(0.0)) if n > 1 else F.lit(0.0)
    core = written_table(neighbours.select("_id", farthest.alias("_core")), "density-core")
    forest = written_table(spanning_forest(cell_edges(placed, core), local_edges), "density-forest")
    clusters, members = condensed_tree(forest, min_cluster_size, local_edges)
    labels = topmost(written_table(clusters, "density-clusters")).filter("label IS NOT NULL")
    numbers = ranked(labels.select("label").distinct(), [], ["label"], "_number")
    named = members.join(labels, "cluster").join(numbers, "label").select(F.col("node").alias("_id"), F.col("_number").cast("int").alias("_number"))
    return rows.join(named, "_id", "left").select("_row.*", F.coalesce("_number", F.lit(NOISE)).alias(output))
