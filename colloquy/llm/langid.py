"""Language identification by compression with one Zstandard dictionary per language.

Each language's dictionary is raw text of sample documents. A text goes to the language whose dictionary
compresses it to the fewest bytes; it is marked as rejected when the runner-up is too close. Texts are
lower-cased and reduced to their letters first, and compressed whole, in chunks, so that a long text
cannot become its own dictionary.

What is fitted is bounded: per language at most ``sample_docs`` documents, chosen by a hash of their id,
of which at most ``piece_chars`` characters each and ``dictionary_bytes`` in all make the dictionary.

Defined results: a missing text and one without a letter are ``und`` with score 0; ties go to the
language with more labelled documents, then by name; rows that repeat give the same result; with no
labelled document at all everything is ``und``; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import use_utc

UNKNOWN = "und"
LEVEL = 5
CHUNK_BYTES = 8192
SCORE_BYTES = 2.0


def letters_of(text: Column) -> Column:
    """The letters of a text in lower case, with one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def compressor(dictionary: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def train(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang",
          sample_docs: int = 256, piece_chars: int = 4096, dictionary_bytes: int = 192_000) -> list[tuple[str, bytes]]:
    """Languages with their dictionaries, the one with the most documents first."""
    named = labelled.select(
        F.col(f"`{id_column}`").alias("_id"), F.col(f"`{language_column}`").alias("_lang"),
        F.col(f"`{text_column}`").alias("_text"),
    ).filter("_lang IS NOT NULL AND _text IS NOT NULL")
    counts = {r["_lang"]: r["n"] for r in named.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = (
        named.select("_lang", "_id").withColumn("_place", F.row_number().over(by_hash))
        .filter(F.col("_place") <= sample_docs).groupBy("_lang", "_id").agg(F.min("_place").alias("_place"))
    )
    pieces = (
        named.join(chosen, ["_lang", "_id"])
        .select("_lang", "_place", F.substring(letters_of(F.col("_text")), 1, piece_chars).alias("_piece"))
        .filter("_piece != ''").groupBy("_lang", "_place").agg(F.min("_piece").alias("_piece")).collect()
    )
    dictionaries: dict[str, bytes] = {}
    held: dict[str, set[str]] = {}
    for row in sorted(pieces, key=lambda r: (r["_lang"], r["_place"])):
        seen = held.setdefault(row["_lang"], set())
        if row["_piece"] not in seen and len(dictionaries.get(row["_lang"], b"")) < dictionary_bytes:
            seen.add(row["_piece"])
            dictionaries[row["_lang"]] = dictionaries.get(row["_lang"], b"") + row["_piece"].encode() + b" "
    return [(lang, dictionaries[lang][:dictionary_bytes]) for lang in sorted(dictionaries, key=lambda g: (-counts[g], g))]


def costs(letters: str, compressors: list[zstandard.ZstdCompressor], chunk: int = CHUNK_BYTES) -> list[int]:
    data = letters.encode()
    parts = [data[i:i + chunk] for i in range(0, len(data), chunk)]
    return [sum(len(c.compress(p)) for p in parts) for c in compressors]


def decide(found: list[int], margin: float) -> tuple[int, float, bool]:
    """Place of the cheapest language, its share in (0, 1], and whether the margin is too narrow."""
    best = min(range(len(found)), key=lambda k: (found[k], k))
    score = 1 / sum(math.exp(-min((c - found[best]) / SCORE_BYTES, 700)) for c in found)
    others = [c for k, c in enumerate(found) if k != best]
    return best, score, bool(others) and min(others) - found[best] < margin * found[best]


def predict(df: DataFrame, model: list[tuple[str, bytes]], id_column: str = "doc_id", text_column: str = "text",
            margin: float = 0.01) -> DataFrame:
    """One row per row: id, ``lang_pred``, ``score``, ``rejected``."""
    use_utc(df.sparkSession)
    kind = dict(df.dtypes)[id_column]
    languages = [language for language, _ in model]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = [compressor(data) for _, data in model]
        for batch in batches:
            named, scores, rejected = [], [], []
            for letters in batch.column(1):
                text = letters.as_py()
                if not text or not compressors:
                    named.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                best, score, narrow = decide(costs(text, compressors), margin)
                named.append(languages[best]), scores.append(score), rejected.append(narrow)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(named, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                [id_column, "lang_pred", "score", "rejected"],
            )

    rows = df.select(F.col(f"`{id_column}`").alias(id_column), letters_of(F.col(f"`{text_column}`").cast("string")).alias("_letters"))
    return rows.mapInArrow(judged, f"`{id_column}` {kind}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """The quarter of the documents that nothing is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
