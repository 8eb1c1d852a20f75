"""SimHash near duplicates by a self-join of binary tries.

Fingerprints that differ in at most ``errors`` bits agree on at least two of ``errors + 2`` blocks of
bits. So the trie of all fingerprints is laid out once per pair of blocks, with that pair's bits first:
down to their depth only a node and itself can be a pair without error. These nodes are the groups
that Spark shuffles. Below them the trie is joined with itself level by level: pairs of nodes are
traversed together, differing bits add up, and a pair over its budget of errors is pruned. A pair whose
leaves are all known to be connected is pruned as well, so a large group of near copies costs little
more than its size, and no task emits more links than it holds fingerprints.

Equal fingerprints are folded to one before the join. A group over ``max_group`` fingerprints is cut
into parts, and each pair of parts is a task of its own, so nothing is lost and no task grows without
bound. Links become components by large-star and small-star rounds over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import use_utc, written_table

BITS = 64
SEED = 42


def fingerprint(text: str | None, shingle_words: int, seed: int = SEED) -> int:
    """64 bits; a bit is set if more than half of the shingles' hashes set it. No words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[shingle_words - 1:]
    digest = xxhash.xxh64_intdigest
    n = len(ends)
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist())), dtype="<u8", count=n
    )
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, 1 << 16):
        part = hashes[start:start + (1 << 16)].view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 4) -> DataFrame:
    """``_id`` and ``_print``, the fingerprint as a signed 64-bit number, one row per row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter(
                (fingerprint(t.as_py(), shingle_words) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["_id", "_print"])

    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{text_column}`").cast("string").alias("_text"))
    return rows.mapInArrow(hashed, "_id long, _print long")


def _views(errors: int) -> list[list[int]]:
    """Orders of the bits, most significant first: each pair of blocks in front once."""
    blocks = [list(map(int, b)) for b in np.array_split(np.arange(BITS - 1, -1, -1), errors + 2)]
    orders = []
    for pair in combinations(range(len(blocks)), 2):
        rest = [bit for k, block in enumerate(blocks) if k not in pair for bit in block]
        orders.append([*blocks[pair[0]], *blocks[pair[1]], *rest])
    return orders


def _depth(errors: int, order: int) -> int:
    sizes = [len(b) for b in np.array_split(np.arange(BITS), errors + 2)]
    first, second = list(combinations(range(errors + 2), 2))[order]
    return sizes[first] + sizes[second]


def _permuted(prints: np.ndarray, order: list[int]) -> np.ndarray:
    """The same fingerprints with the bits in another order."""
    out = np.zeros(len(prints), dtype=np.uint64)
    for place, bit in enumerate(order):
        out |= ((prints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(BITS - 1 - place)
    return out


class _Links:
    """Union-find over the leaves of a task, and the spanning links it has made."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Union all pairs: hook larger roots on smaller ones until none is left."""
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                higher = self.root[self.root]
                if np.array_equal(higher, self.root):
                    break
                self.root = higher


def _trie_join(keys: np.ndarray, groups: np.ndarray, sides: np.ndarray, depth: int, errors: int,
               chunk: int = 1 << 18) -> np.ndarray:
    """Roots of the leaves after joining each group's trie with itself below ``depth``.

    ``keys`` are sorted within ``groups``; of a group in two parts, ``sides`` tells them apart and the
    two tries are joined with each other. A node is a range of sorted keys.
    """
    n = len(keys)
    links = _Links(n)
    starts = np.flatnonzero(np.concatenate(([True], (groups[1:] != groups[:-1]) | (sides[1:] != sides[:-1]))))
    ends = np.concatenate((starts[1:], [n]))
    whole = sides[starts] < 0
    first = np.flatnonzero(sides[starts] == 0)
    other = first[np.isin(first + 1, np.flatnonzero(sides[starts] == 1))]
    other = other[groups[starts[other]] == groups[starts[other + 1]]]
    lo_a = np.concatenate((starts[whole], starts[other]))
    hi_a = np.concatenate((ends[whole], ends[other]))
    lo_b = np.concatenate((starts[whole], starts[other + 1]))
    hi_b = np.concatenate((ends[whole], ends[other + 1]))
    used = np.zeros(len(lo_a), dtype=np.int64)
    ones = np.zeros(n + 1, dtype=np.int64)
    stack = [(depth, lo_a, hi_a, lo_b, hi_b, used)]
    while stack:
        level, lo_a, hi_a, lo_b, hi_b, used = stack.pop()
        if len(lo_a) > chunk:
            half = len(lo_a) // 2
            stack.append((level, *(x[half:] for x in (lo_a, hi_a, lo_b, hi_b, used))))
            lo_a, hi_a, lo_b, hi_b, used = (x[:half] for x in (lo_a, hi_a, lo_b, hi_b, used))
            stack.append((level, lo_a, hi_a, lo_b, hi_b, used))
            continue
        size_a, size_b = hi_a - lo_a, hi_b - lo_b
        same = lo_a == lo_b
        live = (size_a > 0) & (size_b > 0) & (used <= errors) & ~(same & (size_a == 1))
        lo_a, hi_a, lo_b, hi_b, used, same = (x[live] for x in (lo_a, hi_a, lo_b, hi_b, used, same))
        single = (hi_a - lo_a == 1) & (hi_b - lo_b == 1)
        a, b = lo_a[single], lo_b[single]
        near = np.bitwise_count(keys[a] ^ keys[b]) <= errors
        links.join(a[near], b[near])
        # The ends of two ranges are leaves like any other: linking them early lets more pairs be pruned.
        lo_a, hi_a, lo_b, hi_b, used, same = (x[~single] for x in (lo_a, hi_a, lo_b, hi_b, used, same))
        for a, b in ((lo_a, lo_b), (hi_a - 1, hi_b - 1), (lo_a, hi_b - 1), (hi_a - 1, lo_b)):
            near = np.bitwise_count(keys[a] ^ keys[b]) <= errors
            links.join(a[near], b[near])
        changes = np.concatenate(([0], np.cumsum(links.root[1:] != links.root[:-1])))
        uniform = (changes[hi_a - 1] == changes[lo_a]) & (changes[hi_b - 1] == changes[lo_b])
        live = ~(uniform & (links.root[lo_a] == links.root[lo_b]))
        lo_a, hi_a, lo_b, hi_b, used, same = (x[live] for x in (lo_a, hi_a, lo_b, hi_b, used, same))
        if not len(lo_a) or level == BITS:
            links.join(lo_a, lo_b)
            continue
        bit = (keys >> np.uint64(BITS - 1 - level)) & np.uint64(1)
        np.cumsum(bit, out=ones[1:])
        mid_a = hi_a - (ones[hi_a] - ones[lo_a])
        mid_b = hi_b - (ones[hi_b] - ones[lo_b])
        cross = ~same
        stack.append((
            level + 1,
            np.concatenate((lo_a, mid_a, lo_a, mid_a[cross])),
            np.concatenate((mid_a, hi_a, mid_a, hi_a[cross])),
            np.concatenate((lo_b, mid_b, mid_b, lo_b[cross])),
            np.concatenate((mid_b, hi_b, hi_b, mid_b[cross])),
            np.concatenate((used, used, used + 1, used[cross] + 1)),
        ))
    return links.root


def near_links(classes: DataFrame, errors: int = 4, max_group: int = 1_000_000) -> DataFrame:
    """Links ``(a, b)``, a < b, that span the fingerprints within ``errors`` bits of each other.

    ``classes``: distinct ``_print`` with ``_node``, the number that stands for it.
    """
    views = _views(errors)
    exact = [sum(1 << bit for bit in order[:_depth(errors, k)]) for k, order in enumerate(views)]
    masks = F.array(*[F.lit(int(np.uint64(m).astype(np.int64))) for m in exact])
    placed = classes.select("_node", "_print", F.posexplode(masks).alias("_view", "_mask")).select(
        "_node", "_print", "_view", F.col("_print").bitwiseAND(F.col("_mask")).alias("_prefix")
    )
    # Parts of the few groups that are too large for one task; none in most tables.
    large = placed.groupBy("_view", "_prefix").count().filter(F.col("count") > max_group)
    large = written_table(
        large.select("_view", "_prefix", F.ceil(F.col("count") / max_group).cast("int").alias("_parts")), "simhash-large"
    )
    part = F.pmod(F.xxhash64("_print"), F.col("_parts")).cast("int")
    whole = placed.join(large, ["_view", "_prefix"], "left_anti").select(
        "_view", "_prefix", F.lit(-1).alias("_first"), F.lit(-1).alias("_second"), F.lit(-1).alias("_side"), "_node", "_print"
    )
    cut = (
        placed.join(large, ["_view", "_prefix"])
        .withColumn("_part", part)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .select(
            "_view", "_prefix", F.least("_part", "_other").alias("_first"), F.greatest("_part", "_other").alias("_second"),
            F.when(F.col("_part") == F.col("_other"), -1).when(F.col("_part") < F.col("_other"), 0).otherwise(1).alias("_side"),
            "_node", "_print",
        )
    )
    rows = whole.unionByName(cut).repartition("_view", "_prefix", "_first", "_second")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        column = {name: table.column(name).to_numpy() for name in table.column_names}
        for view in np.unique(column["_view"]):
            chosen = np.flatnonzero(column["_view"] == view)
            keys = _permuted(column["_print"][chosen].view(np.uint64), views[view])
            first, second, side = (column[c][chosen] for c in ("_first", "_second", "_side"))
            depth = _depth(errors, view)
            prefix = keys >> np.uint64(BITS - depth)
            order = np.lexsort((keys, side, second, first, prefix))
            keys, first, second, side, prefix = (x[order] for x in (keys, first, second, side, prefix))
            nodes = column["_node"][chosen][order]
            new = (prefix[1:] != prefix[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            groups = np.concatenate(([0], np.cumsum(new)))
            root = _trie_join(keys, groups, side, depth, errors)
            linked = np.flatnonzero(root != np.arange(len(root)))
            a, b = nodes[linked], nodes[root[linked]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["_a", "_b"])

    return rows.mapInArrow(joined, "_a long, _b long")


def components(links: DataFrame) -> DataFrame:
    """``_node`` and ``_component``, the smallest node reachable, for nodes that have a link.

    Large-star and small-star in turn; each round keeps components and makes them stars. A hub's
    links are folded to their minimum before the shuffle and split by adaptive execution in the join.
    """
    edges = written_table(links.filter("_a != _b").distinct(), "links")
    last = None
    while True:
        for larger_only in (True, False):
            both = edges.union(edges.select("_b", "_a")).toDF("_u", "_v")
            near = both if larger_only else both.filter("_v < _u")
            least = written_table(
                near.groupBy("_u").agg(F.min("_v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m")), "star-minima"
            )
            side = both.filter("_v > _u") if larger_only else near
            moved = side.join(least, "_u").select("_v", "_m")
            if not larger_only:
                moved = moved.union(least.select("_u", "_m"))
            edges = written_table(
                moved.filter("_v != _m").select(F.col("_m").alias("_a"), F.col("_v").alias("_b")).distinct(), "links"
            )
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("_b").alias("_node"), F.col("_a").alias("_component"))
        last = state


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 4,
                    errors: int = 4, max_group: int = 1_000_000) -> DataFrame:
    """One row per row: id, ``fingerprint`` as 16 hex digits, ``component_id``.

    ``component_id`` is the smallest id reachable over fingerprints at ``errors`` or fewer differing
    bits. Missing and empty texts, and texts of white space, have fingerprint zero and are linked like
    any other; rows that repeat an id are linked with each other if their texts are near; a row
    without an id takes part through its fingerprint but names no component. Ids are whole numbers. An
    empty table gives an empty table.
    """
    use_utc(df.sparkSession)
    prints = written_table(fingerprints(df, id_column, text_column, shingle_words), "fingerprints")
    classes = written_table(prints.groupBy("_print").agg(F.min("_id").alias("_least")), "fingerprint-classes")
    # A fingerprint stands for itself in the join and takes its smallest id afterwards.
    nodes = classes.select(F.col("_print").alias("_node"), "_print")
    member = written_table(components(near_links(nodes, errors, max_group)), "components")
    reached = (
        member.union(member.select("_component", "_component").distinct())
        .join(classes, F.col("_node") == F.col("_print"))
        .groupBy("_component").agg(F.min("_least").alias("_reached"))
    )
    labels = classes.join(member, F.col("_print") == F.col("_node"), "left").select(
        "_print", "_least", F.coalesce("_component", "_print").alias("_component")
    )
    labels = labels.join(reached, "_component", "left").select("_print", F.coalesce("_reached", "_least").alias("_reached"))
    labels = written_table(labels, "fingerprint-labels")
    return prints.join(labels, "_print").select(
        F.col("_id").alias(id_column), F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"),
        F.col("_reached").alias("component_id"),
    )
