"""Removal of passages that occur more than once, found with suffix arrays.

A suffix array of a whole corpus cannot be one array, and shards cut by document would all have to be
compared with each other. So text is dealt to shards by content. Every window of ``length`` bytes is
named by the smallest hash of the ``GRAM``-byte strings in it; equal windows have equal names. The
windows of a document that share a name are neighbours and make one segment, so a segment is a name and
a piece of text, and equal windows are always in segments of one name.

1. Names are counted, then segments by name and digest. A name met once holds nothing repeated and its text
   never moves. Copies of a segment are folded: all their windows are repeated, and one stands for all.
2. Segments of names with several different texts are fetched and dealt out by name, unless neither half of
   what surrounds the named string is met again under the name, which any shared window needs. A shard is
   a few million bytes of them. Its suffix array comes from Larsson-Sadakane refinement: suffixes sorted by a
   few bytes, then groups of equals refined by the ranks of the suffixes that follow, twice as far each
   round. Kasai's scan gives the common prefixes of neighbours; windows with a neighbour that shares
   ``length`` bytes are repeated.
3. A name with more than ``hot`` texts is spread over several shards. They are merged by slices of the
   digests of their windows: each shard's windows are a sorted run, and one that its own shard has not
   settled is looked up in the merged runs by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.bloom import bits_for, may_contain
from colloquy.llm.common import whole_text
from colloquy.session import use_utc, written_table

LENGTH = 400
GRAM = 64
PIECE = 1 << 21
PLACE_BITS = 23
SHARD_BYTES = 2_000_000
HOT = 2048
SLICE = 400_000
SYMBOLS = 7
SYMBOL_BITS = 9
_BYTE_HASH = np.random.default_rng(42).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(43).integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) at every place but the last ``gram - 1``."""
    hashes, width = _BYTE_HASH[data], 1
    while width < gram:
        hashes = hashes[:-width] * _STEPS[width.bit_length()] + hashes[width:]
        width *= 2
    hashes ^= hashes >> np.uint64(31)
    hashes *= _STEPS[0]
    return hashes ^ (hashes >> np.uint64(29))


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _segments(pieces: list[tuple[int, int, int, bytes]], length: int, gram: int) -> Iterator[tuple]:
    """Rows of ``SEGMENT`` of the windows in pieces of texts: the two numbers of the text, place, bytes.

    ``_left`` and ``_right`` are hashes of the ``(length - gram + 1) // 2`` bytes beside the named string, 0 where the
    segment has not so many. Copies next to each other, as in periodic text, are one row.
    """
    joined = b"".join(data for *_, data in pieces)
    hashes = _gram_hashes(np.frombuffer(joined, dtype=np.uint8), gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    named = _smallest((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1) & low
    named = named.astype(np.int64)
    view, beside = memoryview(joined), (length - gram + 1) // 2
    offset = 0
    for text, other, place, data in pieces:
        windows = len(data) - length + 1
        if windows > 0:
            own = named[offset:offset + windows]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            starts = [0, *cuts.tolist()]
            ends = [*cuts.tolist(), windows]
            at = own[starts]
            names = hashes[at].view(np.int64).tolist()
            held = None
            for name, anchor, start, end in zip(names, at.tolist(), starts, ends):
                size, first = end - start + length - 1, offset + start
                digest = xxhash.xxh3_64_intdigest(view[first:first + size]) - (1 << 63)
                if held is not None and held[2] == name and held[3] == digest:
                    held = (*held[:5], place + start, size, held[7] + 1, *held[8:])
                    continue
                if held is not None:
                    yield held
                right = anchor + gram
                held = (
                    text, other, name, digest, place + start, place + start, size, 1,
                    xxhash.xxh3_64_intdigest(view[anchor - beside:anchor]) - (1 << 63) if anchor - first >= beside else 0,
                    xxhash.xxh3_64_intdigest(view[right:right + beside]) - (1 << 63) if first + size - right >= beside else 0,
                )
            yield held
        offset += len(data)


SEGMENT = (
    "_text long, _other long, _name long, _digest long, _start long, _last long, _size int, _copies long, _left long, _right long"
)
TEXT = ["_text", "_other"]


def _named_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    names = [part.split()[0] for part in SEGMENT.split(", ")]
    types = [pa.int32() if part.endswith(" int") else pa.int64() for part in SEGMENT.split(", ")]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple[int, int, int, bytes]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*_segments(pieces, length, gram)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for one, other, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = data.as_py()
                for place in range(0, len(text) - length + 1, PIECE):
                    piece = text[place:place + PIECE + length - 1]
                    pieces.append((one, other, place, piece))
                    held += len(piece)
                    if held >= PIECE:
                        yield flush()
                        pieces, held = [], 0
        if pieces:
            yield flush()

    rows = docs.filter(F.octet_length("_data") >= length).select(*TEXT, "_data")
    return rows.mapInArrow(found, SEGMENT)


def _heads(symbols: np.ndarray, extra: int) -> np.ndarray:
    """The first seven symbols from every place on as one number; ``extra`` more places after the end."""
    padded = np.concatenate((symbols, np.zeros(SYMBOLS, dtype=np.int64)))
    n = len(symbols)
    heads = np.zeros(n + extra, dtype=np.int64)
    for k in range(SYMBOLS):
        heads[:n] |= padded[k:n + k] << (SYMBOL_BITS * (SYMBOLS - 1 - k))
    return heads


def suffix_array(heads: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` suffixes in order, by Larsson-Sadakane refinement of the order by ``heads``."""
    order = np.empty(n, dtype=np.int32)
    rank = np.zeros(n + 1, dtype=np.int32)  # the empty suffix comes first
    places = np.argsort(heads[:n]).astype(np.int32)
    slots = np.arange(n, dtype=np.int32)
    keys = heads[places]
    reach = SYMBOLS
    while True:
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((first, [len(keys)])))
        rank[places] = np.repeat(slots[first], sizes) + 1
        alone = np.repeat(sizes, sizes) == 1
        order[slots[alone]] = places[alone]
        if alone.all():
            return order
        places, slots = places[~alone], slots[~alone]
        keys = rank[places].astype(np.int64) << 32 | rank[np.minimum(places + reach, n)]
        sort = np.argsort(keys)
        places, keys = places[sort], keys[sort]
        reach *= 2


def common_prefixes(heads: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """For every place, the bytes that its suffix shares with the one before it in order, ``most`` at most.

    Kasai's scan, of all segments side by side: from one place to the next a common prefix loses one symbol at
    most, so each comparison goes on where the one before stopped.
    """
    n = len(order)
    before = np.empty(n, dtype=np.int32)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    shared = np.zeros(n, dtype=np.int32)
    limits = np.array([1 << (SYMBOL_BITS * k) for k in range(SYMBOLS)], dtype=np.int64)
    place, end, length = starts.copy(), starts + sizes, np.zeros(len(starts), dtype=np.int64)
    while len(place):
        other = before[place]
        differ = heads[place + length] ^ heads[np.maximum(other, 0) + length]
        equal = np.where(other >= 0, SYMBOLS - np.searchsorted(limits, differ, side="right"), 0)
        length = np.where(other >= 0, length + equal, 0)
        done = (equal < SYMBOLS) | (length >= most)
        shared[place[done]] = np.minimum(length[done], most)
        place = place + done
        length = np.where(done, np.maximum(np.minimum(length, most) - 1, 0), length)
        live = place < end
        place, end, length = place[live], end[live], length[live]
    return shared


def _runs(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of every run of consecutive numbers."""
    if len(places):
        cuts = np.flatnonzero(np.diff(places) != 1)
        yield from zip(places[[0, *(cuts + 1)]].tolist(), places[[*cuts, len(places) - 1]].tolist())


def _shard(rows: list[tuple], length: int) -> tuple[list[tuple], list[tuple]]:
    """Spans (text, other, start, end) of repeated windows, and runs of windows of names that have other shards.

    ``rows``: name, parts, slices, copies, text, other, start, data.
    """
    sizes = np.array([len(r[7]) for r in rows], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    joined = b"\0".join(r[7] for r in rows) + b"\0"
    symbols = np.frombuffer(joined, dtype=np.uint8).astype(np.int64) + 1
    symbols[starts + sizes] = 0
    heads = _heads(symbols, length + SYMBOLS)
    n = len(symbols)
    order = suffix_array(heads, n)
    shared = common_prefixes(heads, order, starts, sizes, length)
    twin = np.zeros(n, dtype=bool)  # has an equal window in this shard
    equal = np.flatnonzero(shared[order] >= length)
    twin[order[equal]] = True
    twin[order[equal - 1]] = True
    leader = np.ones(n, dtype=bool)  # the first of its equal windows
    leader[order[equal]] = False
    spans, runs = [], {}
    view = memoryview(joined)
    for k, (name, parts, slices, copies, text, other, start, data) in enumerate(rows):
        low, windows = int(starts[k]), int(sizes[k]) - length + 1
        own = twin[low:low + windows]
        if copies == 1:
            spans.extend((text, other, start + a, start + b + length) for a, b in _runs(np.flatnonzero(own)))
        if parts > 1:
            for p in np.flatnonzero(leader[low:low + windows]).tolist():
                digest = xxhash.xxh3_128_intdigest(view[low + p:low + p + length])
                single = copies == 1 and not own[p]
                runs.setdefault((name, digest % slices), []).append(
                    (digest >> 64, digest & (2**64 - 1), text, other, start + p if single else -1)
                )
    return spans, [(name, part, *_packed(sorted(found))) for (name, part), found in runs.items()]


RUN_TYPES = ("<u8", "<u8", "<i8", "<i8", "<i8")
RUN_PARTS = ("_high", "_low", "_texts", "_others", "_places")
FOUND = "_text long, _other long, _start long, _end long, _name long, _slice int, " + ", ".join(f"{p} binary" for p in RUN_PARTS)


def _packed(found: list[tuple[int, ...]]) -> tuple[bytes, ...]:
    """Digests in two halves, texts in two numbers, and places, -1 for windows that are settled."""
    return tuple(np.array(c, dtype=t).tobytes() for c, t in zip(zip(*found), RUN_TYPES))


def _in_shards(texts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Spans and runs of all shards; a row has either a span (``_text``) or a run (``_name``)."""
    types = [pa.int64()] * 5 + [pa.int32()] + [pa.binary()] * 5
    names = [part.split()[0] for part in FOUND.split(", ")]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None

        def flush() -> pa.RecordBatch:
            spans, runs = _shard(rows, length)
            both = [(*span, *[None] * 7) for span in spans] + [(*[None] * 4, *run) for run in runs]
            columns = list(zip(*both)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for name, salt, *row in zip(*columns):
                if held >= shard_bytes and (name, salt) != last:
                    yield flush()
                    rows, held = [], 0
                last = (name, salt)
                rows.append((name, *row))
                held += len(row[-1]) + 1
        if rows:
            yield flush()

    return texts.mapInArrow(found, FOUND)


def _merged_runs(runs: DataFrame, length: int) -> DataFrame:
    """Spans of windows that another shard of their name holds too."""

    def merged(table: pa.Table) -> pa.Table:
        high, low, text, other, place = (
            np.concatenate([np.frombuffer(b, dtype=t) for b in table.column(p).to_pylist()]) for p, t in zip(RUN_PARTS, RUN_TYPES)
        )
        order = np.argsort(high, kind="stable")
        all_high, all_low = high[order], low[order]
        asked = np.flatnonzero(place >= 0)
        left = np.searchsorted(all_high, high[asked], side="left")
        right = np.searchsorted(all_high, high[asked], side="right")
        hits = np.array([k for k, a, b in zip(asked.tolist(), left.tolist(), right.tolist())
                         if b - a > 1 and (all_low[a:b] == low[k]).sum() > 1], dtype=np.int64)
        hits = hits[np.lexsort((place[hits], other[hits], text[hits]))]
        new = np.ones(len(hits), dtype=bool)
        new[1:] = (np.diff(place[hits]) != 1) | (np.diff(text[hits]) != 0) | (np.diff(other[hits]) != 0)
        first = np.flatnonzero(new)
        final = np.concatenate((first[1:] - 1, [len(hits) - 1])).astype(np.int64)[:len(first)]
        columns = (text[hits[first]], other[hits[first]], place[hits[first]], place[hits[final]] + length)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip((*TEXT, "_start", "_end"), columns)})

    return runs.groupBy("_name", "_slice").applyInArrow(merged, "_text long, _other long, _start long, _end long")


def _may_be_in(keys: DataFrame, columns: list[str]) -> Column:
    """Whether a row's ``columns`` may be in ``keys`` (a written table), by a filter of fixed size."""
    hashed = keys.select(F.xxhash64(*columns).alias("_hash"))
    return may_contain(hashed, "_hash", bits_for(keys.count()), F.xxhash64(*columns))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
                   shard_bytes: int = SHARD_BYTES, slice_windows: int = SLICE) -> DataFrame:
    """``_text, _other, _start, _end``: spans that cover every window of ``length`` bytes met more than once.

    ``docs``: binary ``_data``, and two numbers that stand for it, equal for equal texts alone. Spans may
    overlap and repeat; each is some window or more.
    """
    segments = written_table(_named_segments(docs, length, gram), "suffix-segments")
    names = segments.groupBy("_name").agg(F.sum("_copies").alias("_total"))
    names = written_table(names.filter("_total > 1").select("_name"), "suffix-names")
    met = segments.filter(_may_be_in(names, ["_name"]))
    folded = met.groupBy("_name", "_digest").agg(
        F.sum("_copies").alias("_copies"), F.min(F.struct(*TEXT, "_start", "_size", "_left", "_right")).alias("_one")
    )
    texts = folded.groupBy("_name").agg(F.count(F.lit(1)).alias("_texts"), F.sum("_copies").alias("_total"))
    known = written_table(folded.join(texts.filter("_total > 1"), "_name"), "suffix-repeated")
    copied = written_table(known.filter("_copies > 1").select("_name", "_digest"), "suffix-copied")
    settled = segments.filter(_may_be_in(copied, ["_name", "_digest"])).join(copied, ["_name", "_digest"], "left_semi").select(
        *TEXT, "_start", (F.col("_last") + F.col("_size")).alias("_end")
    )
    several = known.filter("_texts > 1").select("_name", "_digest", "_copies", "_texts", "_one.*")
    sides = several.select("_name", F.explode(F.array(F.struct(F.lit(0).alias("_side"), F.col("_left").alias("_hash")),
                                                      F.struct(F.lit(1).alias("_side"), F.col("_right").alias("_hash")))).alias("_s"))
    shared = sides.select("_name", "_s.*").filter("_hash != 0").groupBy("_name", "_side", "_hash").count().filter("count > 1")
    for side, column in enumerate(("_left", "_right")):
        own = shared.filter(F.col("_side") == side).select("_name", F.col("_hash").alias(column), F.lit(True).alias(f"{column}_met"))
        several = several.join(own, ["_name", column], "left")
    parts = F.ceil(F.col("_texts") / hot).cast("int")
    wanted = several.filter("_left_met OR _right_met").select(
        *TEXT,
        F.struct(
            "_name", F.pmod(F.xxhash64("_digest"), parts).cast("int").alias("_salt"), parts.alias("_parts"),
            F.ceil(F.col("_texts") * (length // 2) / slice_windows).cast("int").alias("_slices"), "_copies", "_start", "_size",
        ).alias("_segment"),
    )
    wanted = written_table(wanted.groupBy(*TEXT).agg(F.collect_list("_segment").alias("_segments")), "suffix-wanted")
    # Rows of equal texts are folded to one, whichever it is, where they are read.
    holders = docs.filter(_may_be_in(wanted, TEXT)).groupBy(*TEXT).agg(F.first("_data").alias("_data"))
    fetched = holders.join(wanted, TEXT).select(*TEXT, "_data", F.explode("_segments").alias("_s")).select(
        "_s._name", "_s._salt", "_s._parts", "_s._slices", "_s._copies", *TEXT, "_s._start",
        F.expr("substring(_data, int(_s._start) + 1, _s._size)").alias("_piece"),
    )
    shards = fetched.repartition("_name", "_salt").sortWithinPartitions("_name", "_salt", *TEXT, "_start")
    found = written_table(_in_shards(shards, length, shard_bytes), "suffix-found")
    merged = _merged_runs(found.filter("_name IS NOT NULL").select("_name", "_slice", *RUN_PARTS), length)
    inside = found.filter("_text IS NOT NULL").select(*TEXT, "_start", "_end")
    return settled.unionByName(inside).unionByName(merged)


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH,
                   **options: int) -> DataFrame:
    """One row per row: id, ``n_bytes``, ``spans`` of removed bytes (``first``, ``end``) and the ``kept`` bytes.

    Texts are UTF-8 bytes; a missing text is empty. A byte goes if a string of ``length`` bytes that covers
    it begins somewhere else as well, in this or another row, overlaps included; whether it does is judged on
    the input, so every copy goes. What goes depends on texts alone, so missing and repeated ids are rows like
    any other, and rows that repeat are copies of each other. Texts shorter than ``length`` are kept whole; long
    texts are read in pieces that overlap. A cut may fall inside a character: ``kept`` is binary. An empty table
    gives an empty table. Other columns are not read. ``df`` is read three times.
    """
    use_utc(df.sparkSession)
    kind = dict(df.dtypes)[id_column]
    data = df.select(F.col(f"`{id_column}`").alias("_id"), F.encode(whole_text(text_column), "UTF-8").alias("_data"))
    docs = data.select("_id", "_data", F.xxhash64("_data").alias("_text"), F.xxhash64(F.lit(1), "_data").alias("_other"))
    spans = repeated_spans(docs.select(*TEXT, "_data"), length, **options).groupBy(*TEXT).agg(
        F.collect_set(F.struct("_start", "_end")).alias("_spans")
    )
    spans = written_table(spans, "suffix-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, kept, sizes = [], [], []
            for data, covered in zip(batch.column(1), batch.column(2)):
                text = data.as_py()
                sizes.append(len(text))
                if not covered.is_valid:
                    firsts.append([])
                    kept.append(text)
                    continue
                pairs = covered.values.flatten()
                starts, ends = pairs[0].to_numpy(), pairs[1].to_numpy()
                order = np.argsort(starts, kind="stable")
                starts, ends = starts[order], np.maximum.accumulate(ends[order])
                new = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1])))
                first, end = starts[new].tolist(), ends[[*(new[1:] - 1), len(ends) - 1]].tolist()
                firsts.append([{"first": a, "end": b} for a, b in zip(first, end)])
                kept.append(b"".join(text[a:b] for a, b in zip([0, *end], [*first, len(text)])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()),
                    pa.array(firsts, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
                ],
                [id_column, "n_bytes", "spans", "kept"],
            )

    schema = f"`{id_column}` {kind}, n_bytes long, spans array<struct<first:long,end:long>>, kept binary"
    touched = _may_be_in(spans, TEXT)
    removed = docs.filter(touched).join(spans, TEXT, "left").select("_id", "_data", "_spans").mapInArrow(cut, schema)
    whole = docs.filter(~touched).select(
        F.col("_id").alias(id_column), F.octet_length("_data").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<first:bigint,end:bigint>>").alias("spans"), F.col("_data").alias("kept"),
    )
    return removed.unionByName(whole)


def repeat_report(removed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Id, ``n_bytes``, ``n_removed``, ``n_spans`` and the SHA-256 of what is kept."""
    return removed.select(
        id_column, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
