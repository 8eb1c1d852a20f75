"""Token ids of a corpus in Arrow files of equal-length sequences.

Documents in ascending order of their id, each followed by an end id, make one long row of ids. It is
cut into files by ranges of document ids; a file is an Arrow IPC file (the stream format with a footer)
whose batches have two fixed-size-list columns: ``ids``, sequences of ``length`` ids, and ``mask``, true
where a sequence holds an id and false where the file's last one is filled up. Nothing is compressed, so
a memory map gives any sequence without copying. A second file beside it, ``.docs.arrow``, lists the
documents with their number of ids.

Tasks write under names of their own and return them; the manifest holds the names of the tasks that
succeeded, so retried tasks leave nothing that is read. Texts are encoded through the table of distinct
words of ``bpe``, with the blocks of that table being the ranges of ids, so texts are shuffled once.

Defined results: a missing or empty text has the end id only; documents without an id come first; rows
that repeat an id follow each other, by number of ids and the ids' checksum; an empty table makes no
file and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.bpe import encode_in_blocks, read_tokenizer
from colloquy.llm.common import whole_text
from colloquy.session import shared_folder, use_utc, written_table

BLOCK_BYTES = 24_000_000
LENGTH = 2048
BATCH_SEQUENCES = 512


def _checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_sequences(target: fs.FileSystem, path: str, ids: np.ndarray, length: int, wide: bool) -> None:
    """One file of sequences and masks; the last sequence is filled up with zeros."""
    ids = ids.astype(np.uint32 if wide else np.uint16)
    full = -(-len(ids) // length) * length
    filled = np.concatenate((ids, np.zeros(full - len(ids), dtype=ids.dtype)))
    mask = np.arange(full) < len(ids)
    kind = pa.uint32() if wide else pa.uint16()
    schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], {"tokens": str(len(ids))})
    with target.open_output_stream(path) as sink, pa.ipc.new_file(sink, schema) as writer:
        for start in range(0, full, length * BATCH_SEQUENCES):
            part = slice(start, min(start + length * BATCH_SEQUENCES, full))
            writer.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(filled[part]), length),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask[part]), length)], schema=schema,
            ))


def open_sequences(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """A reader with random access; files of a local or mounted folder are memory-mapped."""
    target, root = _filesystem(folder)
    if isinstance(target, fs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(f"{root}/{name}"))
    return pa.ipc.open_file(target.open_input_file(f"{root}/{name}"))


def block_bounds(df: DataFrame, ident: Column, text: Column, block_bytes: int) -> np.ndarray:
    """The least ids of all blocks but the first, where blocks are ranges of ids with ``block_bytes`` of text each.

    Ids are range-sorted beside their texts' sizes; running sums go on over partitions by one row of each.
    An id given several times is in one block. What reaches the driver is one number per block.
    """
    sized = df.select(ident.alias("_id"), (F.octet_length(text) + 1).alias("_bytes")).filter("_id IS NOT NULL")
    sized = sized.repartitionByRange("_id").sortWithinPartitions("_id").withColumn("_part", F.spark_partition_id())
    sized = written_table(sized, "token-sizes")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.groupBy("_part").agg(F.sum("_bytes").alias("_sum")).select(
        "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_part").orderBy("_id").rangeBetween(Window.unboundedPreceding, -1)
    running = sized.withColumn("_inside", F.coalesce(F.sum("_bytes").over(inside), F.lit(0))).join(F.broadcast(offsets), "_part")
    blocks = running.groupBy(F.floor((F.col("_inside") + F.col("_offset")) / block_bytes).alias("_block")).agg(F.min("_id").alias("_least"))
    return np.array(sorted(r["_least"] for r in blocks.filter("_block > 0").collect()), dtype=np.int64)


def write_tokens(df: DataFrame, tokenizer_path: str, folder: str, id_column: str = "doc_id", text_column: str = "text",
                 end_id: int = 0, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write the files and return the manifest: shard, ids_file, docs_file, n_docs, n_tokens.

    The ids must be whole numbers. Ranges of ids hold ``block_bytes`` of text each.
    """
    use_utc(df.sparkSession)
    ident = F.col(f"`{id_column}`").cast("long")
    bounds = block_bounds(df, ident, whole_text(text_column), block_bytes)
    n_blocks = len(bounds) + 1
    tokenizer = read_tokenizer(tokenizer_path)
    target, root = _filesystem(folder)
    target.create_dir(root, recursive=True)
    docs = df.select(ident.alias("_id"), whole_text(text_column).alias("_text"))

    def finish(block: int, rows: pa.Table, ids: np.ndarray, counts: np.ndarray) -> pa.Table:
        known = rows.column("_id").combine_chunks()
        missing = np.asarray(known.is_null())
        numbers = np.asarray(known.fill_null(0)).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(counts)))
        checks = np.zeros(len(counts), dtype=np.int64)
        values, places, repeats = np.unique(numbers, return_inverse=True, return_counts=True)
        for k in np.flatnonzero(repeats[places] > 1):
            checks[k] = _checksum(ids[starts[k]:starts[k + 1]])
        order = np.lexsort((checks, counts, numbers, ~missing))
        lengths = counts[order] + 1
        ends = np.cumsum(lengths)
        long_row = np.full(int(ends[-1]), end_id, dtype=np.uint32)
        at = np.arange(int(counts.sum())) + np.repeat(starts[:-1][order] - (ends - lengths - np.arange(len(order))), counts[order])
        keep = np.ones(len(long_row), dtype=bool)
        keep[ends - 1] = False
        long_row[keep] = ids[at]
        store, place = _filesystem(folder)
        name = f"{block:06d}-{uuid.uuid4().hex}"
        write_sequences(store, f"{place}/{name}.arrow", long_row, length, bool(len(long_row) and long_row.max() > 65_535))
        listed = pa.table({"doc_id": known.take(pa.array(order)), "n_tokens": pa.array(lengths, pa.int64())})
        with store.open_output_stream(f"{place}/{name}.docs.arrow") as sink, pa.ipc.new_file(sink, listed.schema) as writer:
            writer.write_table(listed)
        return pa.table({
            "shard": pa.array([block], pa.int32()), "ids_file": [f"{name}.arrow"], "docs_file": [f"{name}.docs.arrow"],
            "n_docs": pa.array([len(order)], pa.int64()), "n_tokens": pa.array([len(long_row)], pa.int64()),
        })

    schema = "shard int, ids_file string, docs_file string, n_docs long, n_tokens long"
    return written_table(encode_in_blocks(docs, tokenizer, n_blocks, finish, schema, bounds), "token-manifest")


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32. ``start`` counts all ids before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("_base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids_file, docs_file, base in zip(*(batch.column(k).to_pylist() for k in range(3))):
                listed = open_sequences(folder, docs_file).read_all()
                lengths = np.asarray(listed.column("n_tokens"))
                ends = np.cumsum(lengths)
                reader = open_sequences(folder, ids_file)
                held = [reader.get_batch(k).column(0).flatten().to_numpy() for k in range(reader.num_record_batches)]
                # The mask is false at the end of the last sequence alone, after the ids of all documents.
                data = memoryview(np.concatenate(held)[:int(ends[-1])].astype("<u4")).cast("B")
                checks = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [listed.column("doc_id").combine_chunks(), pa.array(base + ends - lengths, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(checks, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("ids_file", "docs_file", "_base").repartition(parts, "ids_file")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(df: DataFrame) -> str:
    """A new folder for token files under the folder that all executors share."""
    return f"{shared_folder(df.sparkSession)}/tokens-{uuid.uuid4().hex}"
