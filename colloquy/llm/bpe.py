"""Byte-level BPE over a table of distinct words.

Texts are split by a JVM expression into words, at places where the tokenizer's own splitting pattern
is certain to have a boundary whatever follows. Documents are dealt to blocks of about ``block_bytes``
of text, and their words travel there in compressed Arrow batches. Each block sends every word it holds once to the word's bucket; a bucket encodes each distinct
word once, whichever blocks have asked, and answers every block; blocks put the ids back by position.
So a word costs one encoding in all, and what is shuffled for it is one row entry per block, never one
per occurrence: the commonest word is as light as any other.

Decoding joins each id to its piece of bytes, by position in the piece table of the vocabulary, whose
size is fixed by the tokenizer.

Defined results: a missing or empty text has no ids and decodes to the empty text; rows that repeat an
id are encoded one by one; an id may be missing; an empty table gives an empty table; other columns are
not read. A word may be as long as the whole text.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import text_bytes, whole_text
from colloquy.session import use_utc

BLOCK_BYTES = 12_000_000
# A word starts at white space after a visible ASCII character or a letter, and at a mark after a
# letter. The tokenizer never joins across these: its words hold white space at their start only, and
# a run of letters ends at a mark. Marks that special tokens use stay with what is before them.
BOUNDARY = r"(?=[\x20\n])(?<=[!-~\p{L}])|(?=[.,!$%&*#])(?<=\p{L})"

# Between the words of a packed text; no UTF-8 holds this byte.
SEPARATOR = b"\xff"

# Packed parts of a block are looked up together, as each lookup hashes all of the block's distinct words.
PART_BYTES = 4_000_000

Finish = Callable[[int, pa.Table, np.ndarray, np.ndarray], pa.Table]


def read_tokenizer(path: str) -> str:
    """The tokenizer's JSON text, if it is one that ``BOUNDARY`` fits."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    spec = json.loads(text)
    splitter = spec.get("pre_tokenizer") or {}
    fits = (
        spec["model"]["type"] == "BPE" and not spec.get("normalizer") and splitter.get("type") == "ByteLevel"
        and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
    )
    tokens = [t["content"] for t in spec.get("added_tokens", [])]
    if not fits or any(set(t) & set(" \n.,!$%&*#") for t in tokens):
        raise ValueError(f"{path} is not a byte-level BPE tokenizer whose words can be split by pattern")
    return text


def vocabulary_size(tokenizer: str) -> int:
    spec = json.loads(tokenizer)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])


def load_tokenizer(text: str):
    """A tokenizer that uses one thread and neither truncates nor pads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _payload(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(payload: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all()


def _lists(values: pa.Array, lengths: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int64()), values)


def _encode_words(tokenizer, words: list[str], step: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and the number of ids of each."""
    lengths, ids = np.zeros(len(words), dtype=np.int64), []
    for start in range(0, len(words), step):
        found = [e.ids for e in tokenizer.encode_batch_fast(words[start:start + step], add_special_tokens=False)]
        lengths[start:start + len(found)] = [len(i) for i in found]
        ids.append(np.fromiter((i for part in found for i in part), dtype=np.uint32))
    return np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32), lengths


class DistinctWords:
    """The distinct words of many arrays; arrays wait until they are as many as the words known, so that all hashing is linear."""

    def __init__(self) -> None:
        self.known: pa.Array | None = None
        self.waiting: list[pa.Array] = []
        self.size = 0

    def add(self, words: pa.Array) -> None:
        words = pc.unique(words)
        self.waiting.append(words)
        self.size += len(words)
        if self.known is None or self.size > len(self.known):
            self.merged()

    def merged(self) -> pa.Array:
        held = [*([self.known] if self.known is not None else []), *self.waiting]
        self.known = pc.unique(pa.chunked_array(held)) if len(held) > 1 else held[0]
        self.waiting, self.size = [], 0
        return self.known


def _parts(payloads: pa.ChunkedArray) -> Iterator[list[pa.Scalar]]:
    """Runs of payloads of at most ``PART_BYTES`` together, packed as they are, or of one payload."""
    run, size = [], 0
    for payload in payloads:
        n = len(payload.as_buffer())
        if run and size + n > PART_BYTES // 2:  # words pack to half their size or less
            yield run
            run, size = [], 0
        run.append(payload)
        size += n
    if run:
        yield run


def encode_in_blocks(docs: DataFrame, tokenizer: str, n_blocks: int, finish: Finish, schema: str,
                     bounds: np.ndarray | None = None) -> DataFrame:
    """Encode ``_id, _text, _block`` and hand each block to ``finish``.

    With ``bounds``, the least whole-number ids of all blocks but the first, ids give the blocks and ``_block``
    is not read; a missing id is in the first.

    ``finish(block, rows, ids, counts)`` gets the block's rows (``_id``), all their ids in a row and
    the number of ids of each, and returns the block's result. ``tokenizer`` is the JSON text.
    """
    n_buckets = max(1, n_blocks // 2)
    width = np.uint16 if vocabulary_size(tokenizer) <= 1 << 16 else np.uint32
    block = F.col("_block") if bounds is None else F.lit(0)
    words = docs.select(block.alias("_block"), "_id", F.split("_text", BOUNDARY).alias("_words"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = pc.binary_join(batch.column(2).cast(pa.list_(pa.binary())), SEPARATOR)
            rows = pa.table({"_id": batch.column(1), "_joined": joined})
            places = np.asarray(batch.column(0))
            if bounds is not None:
                ids = batch.column(1)
                places = np.where(np.asarray(ids.is_null()), 0, np.searchsorted(bounds, np.asarray(ids.fill_null(0)), side="right"))
            order = np.argsort(places, kind="stable")
            blocks, starts = np.unique(places[order], return_index=True)
            payloads = [_payload(rows.take(pa.array(order[a:b]))) for a, b in zip(starts, [*starts[1:], len(order)])]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(payloads, pa.binary())], ["_block", "_packed"])

    # Both readers below share this shuffle.
    held = words.mapInArrow(packed, "_block int, _packed binary").repartition(n_blocks, "_block")

    def words_in(payloads: list[pa.Scalar]) -> tuple[pa.Table, pa.ListArray]:
        table = pa.concat_tables([_unpacked(p) for p in payloads]).combine_chunks()
        joined = table.column("_joined")
        return table, pc.split_pattern(joined.combine_chunks() if joined.num_chunks else pa.array([], joined.type), SEPARATOR)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, DistinctWords] = {}
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                known.setdefault(block, DistinctWords()).add(words_in([payload])[1].flatten())
        for block in list(known):
            distinct = known.pop(block).merged()
            places = np.fromiter(map(zlib.crc32, distinct.to_pylist()), dtype=np.int64, count=len(distinct)) % n_buckets
            order = np.argsort(places, kind="stable")
            buckets, starts = np.unique(places[order], return_index=True)
            ordered = distinct.take(pa.array(order))
            payloads = [_payload(pa.table({"word": ordered[a:b]})) for a, b in zip(starts, [*starts[1:], len(order)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets, pa.int32()), pa.array(np.full(len(buckets), block), pa.int32()), pa.array(payloads, pa.binary())],
                ["_bucket", "_block", "_payload"],
            )

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_tokenizer(tokenizer)
        asked: dict[int, list[tuple[int, pa.Array]]] = {}
        for batch in batches:
            for bucket, block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                asked.setdefault(bucket, []).append((block, _unpacked(payload).column(0).combine_chunks()))
        for requests in asked.values():
            coded = pa.concat_arrays([w for _, w in requests]).dictionary_encode()
            ids, lengths = _encode_words(coder, coded.dictionary.cast(pa.string()).to_pylist())
            table, at = _lists(pa.array(ids.astype(width)), lengths), 0
            for block, words_of_block in requests:
                found = table.take(coded.indices[at:at + len(words_of_block)])
                at += len(words_of_block)
                answer = _payload(pa.table({"word": words_of_block, "ids": found}))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([answer], pa.binary())], ["_block", "_answer"])

    def placed(rows: pa.Table, answers: pa.Table) -> pa.Table:
        table = pa.concat_tables([_unpacked(a) for a in answers.column("_answer")])
        dictionary, coded = table.column("word").combine_chunks(), table.column("ids").combine_chunks()
        starts, pieces = np.asarray(coded.offsets), np.asarray(coded.values)
        sizes = np.diff(starts)
        known, ids, counts = [], [], []
        for payloads in _parts(rows.column("_packed")):
            part, listed = words_in(payloads)
            at = np.asarray(pc.index_in(listed.flatten(), value_set=dictionary))
            lengths = sizes[at]
            before = np.concatenate(([0], np.cumsum(lengths)))
            ids.append(pieces[np.arange(before[-1]) + np.repeat(starts[:-1][at] - before[:-1], lengths)])
            ends = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(listed)))))
            counts.append(np.diff(before[ends]))
            known.append(part.select(["_id"]))
        return finish(rows.column("_block")[0].as_py(), pa.concat_tables(known), np.concatenate(ids), np.concatenate(counts))

    requests = held.mapInArrow(wanted, "_bucket int, _block int, _payload binary")
    answers = requests.repartitionById(n_buckets, F.col("_bucket")).mapInArrow(answered, "_block int, _answer binary")
    return held.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(placed, schema)


def count_blocks(df: DataFrame, text_column: str, block_bytes: int) -> int:
    return max(1, -(-text_bytes(df, text_column) // block_bytes))


def encode(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
           block_bytes: int = BLOCK_BYTES, decoded_column: str | None = None) -> DataFrame:
    """One row per row: id and ``ids``, the text's token ids without special tokens added.

    ``decoded_column`` names a further column with the text that the ids decode to. It is made where
    the ids are, so that they need not travel to a second Python worker as they do in :func:`decode`.
    """
    use_utc(df.sparkSession)
    blocks = count_blocks(df, text_column, block_bytes)
    kind = dict(df.dtypes)[id_column]
    tokenizer = read_tokenizer(tokenizer_path)
    pieces = piece_table(tokenizer) if decoded_column else None

    def finish(_: int, rows: pa.Table, ids: np.ndarray, counts: np.ndarray) -> pa.Table:
        ends = np.concatenate(([0], np.cumsum(counts)))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
        columns = {id_column: rows.column("_id"), "ids": lists}
        if pieces is not None:
            columns[decoded_column] = joined_pieces(pieces, lists)
        return pa.table(columns)

    text = whole_text(text_column)
    docs = df.select(
        F.col(f"`{id_column}`").alias("_id"), text.alias("_text"),
        F.pmod(F.xxhash64(F.col(f"`{id_column}`"), F.octet_length(text)), F.lit(blocks)).cast("int").alias("_block"),
    )
    schema = f"`{id_column}` {kind}, ids array<int>" + (f", `{decoded_column}` string" if decoded_column else "")
    return encode_in_blocks(docs, tokenizer, blocks, finish, schema)


def piece_table(tokenizer: str) -> pa.Array:
    """The bytes of every id, at the id's place; ids that stand for nothing are missing.

    Byte-level vocabularies write bytes as printable characters: visible Latin-1 ones as themselves,
    the others in order from code point 256 on.
    """
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    spec = json.loads(tokenizer)
    pieces: dict[int, bytes] = {}
    for token, number in spec["model"]["vocab"].items():
        pieces[number] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    for added in spec.get("added_tokens", []):
        pieces[added["id"]] = added["content"].encode()
    return pa.array([pieces.get(k) for k in range(max(pieces) + 1)], pa.large_binary())


def joined_pieces(pieces: pa.Array, lists: pa.ListArray, step: int = 256) -> pa.Array:
    """The text of each list of ids: ids are joined to their pieces by place, a few lists at a time."""
    texts: list[str] = []
    for start in range(0, len(lists), step):
        part = lists.slice(start, step)
        found = pieces.take(part.flatten()).fill_null(b"")
        ends = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(part)))))
        data, starts = memoryview(found.buffers()[2] or b""), parts_offsets(found)
        texts += [bytes(data[starts[a]:starts[b]]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
    return pa.array(texts, pa.string())


def decode(df: DataFrame, tokenizer_path: str, ids_column: str = "ids", decoded_column: str = "decoded") -> DataFrame:
    """The same rows with the decoded text of ``ids`` in a further column; no ids give the empty text.

    Bytes that are no UTF-8 become replacement characters, as in the tokenizer's own decoding.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    pieces = piece_table(read_tokenizer(tokenizer_path))
    schema = StructType([*df.schema.fields, StructField(decoded_column, StringType())])
    place = df.columns.index(ids_column)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = joined_pieces(pieces, batch.column(place).fill_null([]))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return df.mapInArrow(joined, schema)


def parts_offsets(parts: pa.LargeBinaryArray) -> np.ndarray:
    """The offsets of an array of byte strings into its data, one more than there are strings."""
    offsets = np.frombuffer(parts.buffers()[1], dtype=np.int64)
    return offsets[parts.offset:parts.offset + len(parts) + 1]


def digests(coded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 of encoded and decoded rows."""
    return coded.select(
        id_column, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
