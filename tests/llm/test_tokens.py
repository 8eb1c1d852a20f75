"""Tokens, token files, languages, mixing and the pipeline."""

import random
import re
import zlib
from fractions import Fraction

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import bpe, langid, tokenfile
from colloquy.llm.mixing import apportion, mixed_documents, mixture

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
TEXTS = [
    None, "", " ", "  two  blanks ", "\n\n a\n b\t c \r\n", "don't we're it's.", "naïve café, ümlaut!! 😀😀 ok", "<|endoftext|> x<|endoftext|>.",
    "a  b  c   d", "x" * 5000, "word " * 3000, "1,234.50 $5%&* #tag​.", "中文，文本。 日本語", "trailing \n", "a.b,c!d$e%f&g*h#i",
    "́combining á.", "tab\tonly\n \n\n  x", "'s 'S don''t .' .. ,. a'.", "The river. The river.", "The river. The river.",
]


def frame(spark, texts):
    rows = list(enumerate(texts))
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "_block": F.lit("b"), "_id": F.lit(None).cast("int")})


def test_words_of_many_parts_are_hashed_a_few_times(monkeypatch):
    """A block gets a part from each batch of the input; its distinct words are not hashed again for each."""
    hashed, unique = [], bpe.pc.unique
    monkeypatch.setattr(bpe.pc, "unique", lambda a: hashed.append(len(a)) or unique(a))
    words, parts = bpe.DistinctWords(), [[b"w%d" % (k % 900), b"all", b"x%d" % k] for k in range(2_000)]
    for part in parts:
        words.add(pa.array(part))
    assert set(words.merged().to_pylist()) == {w for part in parts for w in part} and len(words.merged()) == 2_901
    assert sum(hashed) < 10 * 3 * len(parts)
    payloads = [bpe._payload(pa.table({"_joined": [b"a" * n]})) for n in range(300)]
    runs = list(bpe._parts(pa.chunked_array([pa.array(payloads, pa.binary())])))
    assert len(runs) == 1 and [p.as_py() for p in runs[0]] == payloads
    monkeypatch.setattr(bpe, "PART_BYTES", 3 * len(payloads[0]))
    assert [len(r) for r in bpe._parts(pa.chunked_array([pa.array(payloads[:4], pa.binary())]))] == [1] * 4



@pytest.mark.parametrize("block_bytes", [24_000_000, 500])
def test_encode_and_decode(spark, block_bytes):
    coded = bpe.decode(bpe.encode(frame(spark, TEXTS), PATH, block_bytes=block_bytes), PATH)
    rows = {r["doc_id"]: r for r in coded.collect()}
    assert len(rows) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        ids = PLAIN.encode(text or "", add_special_tokens=False).ids
        assert rows[k]["ids"] == ids, text
        assert rows[k]["decoded"] == PLAIN.decode(ids, skip_special_tokens=False)
    at_once = bpe.encode(frame(spark, TEXTS), PATH, block_bytes=block_bytes, decoded_column="decoded")
    assert {r["doc_id"]: r for r in at_once.collect()} == rows
    assert bpe.encode(frame(spark, ["x"]).limit(0), PATH).count() == 0


def test_decode_broken_bytes(spark):
    ids = [[], None, [int(PLAIN.token_to_id("Ã"))], PLAIN.encode("😀", add_special_tokens=False).ids[:2], [50256, 11]]
    rows = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "k int, ids array<int>")
    found = {r["k"]: r["decoded"] for r in bpe.decode(rows, PATH).collect()}
    assert found == {k: PLAIN.decode(i or [], skip_special_tokens=False) for k, i in enumerate(ids)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\r\x0b  .,!$%&*#'aZ9<|>\u00e9\u4e2d\u00a0", max_size=60))
def test_boundaries_are_the_tokenizers(text):
    """The boundaries, written for Python: encoding the parts must give the ids of the whole text."""
    cut = re.split(r"(?=[ \n])(?<=[!-~]|[^\W\d_])|(?=[.,!$%&*#])(?<=[^\W\d_])", text)
    parts = [i for p in cut for i in PLAIN.encode(p, add_special_tokens=False).ids]
    assert parts == PLAIN.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("block_bytes", [24_000_000, 500])
def test_token_files(spark, tmp_path, block_bytes):
    docs = frame(spark, TEXTS).withColumn("doc_id", F.when(F.col("doc_id") == 3, None).otherwise(100 - F.col("doc_id")))
    folder = str(tmp_path / "tokens")
    manifest = tokenfile.write_tokens(docs, PATH, folder, length=64, block_bytes=block_bytes)
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.read_documents(manifest, folder).collect()}
    start, wanted, stream = 0, {}, []
    for key, text in sorted(((None if k == 3 else 100 - k, t) for k, t in enumerate(TEXTS)), key=lambda r: -1 if r[0] is None else r[0]):
        ids = PLAIN.encode(text or "", add_special_tokens=False).ids + [0]
        wanted[key] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
        stream += ids
    assert found == wanted
    held = []
    for row in manifest.orderBy("shard").collect():
        reader = tokenfile.open_sequences(folder, row["ids_file"])
        table = reader.read_all()
        assert table.schema.field("ids").type == pa.list_(pa.uint16(), 64) and table.schema.field("mask").type == pa.list_(pa.bool_(), 64)
        ids, mask = (np.asarray(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)) for c in ("ids", "mask"))
        assert mask.sum() == row["n_tokens"] and len(ids) % 64 == 0
        held += ids[mask].tolist()
    assert held == stream
    empty = tokenfile.write_tokens(docs.limit(0), PATH, folder)
    assert empty.count() == 0 and tokenfile.read_documents(empty, folder).count() == 0


def test_sequences_are_mapped_without_copies(tmp_path):
    from pyarrow import fs

    tokenfile.write_sequences(fs.LocalFileSystem(), f"{tmp_path}/a.arrow", np.arange(10_000), 128, False)
    before = pa.total_allocated_bytes()
    batch = tokenfile.open_sequences(str(tmp_path), "a.arrow").get_batch(0)
    assert pa.total_allocated_bytes() - before < 4096
    assert batch.column(0)[7].values.to_numpy().tolist() == list(range(7 * 128, 8 * 128))


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.filter("NOT held"))
    assert all(len(data) <= 192_000 for _, data in model)
    found = langid.predict(docs, model).join(docs.filter("held"), "doc_id").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() >= 0.97 and found["score"].between(0, 1).all()
    odd = frame(spark, [None, "", "123 !!", "the the", "the the"])
    rows = sorted(langid.predict(odd, model).collect(), key=lambda r: r["doc_id"])
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and rows[0]["score"] == 0 and rows[3][1:] == rows[4][1:]
    assert langid.predict(odd.limit(0), model).count() == 0
    nothing = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert nothing == [] and langid.predict(odd, nothing).first()["lang_pred"] == "und"
    assert zlib.crc32(b"17") % 4 == 2 or not docs.filter("doc_id = 17").first()["held"]


def quotients(weights, seats):
    """Sainte-Laguë one seat at a time."""
    given_seats = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda k: (Fraction(weights[k], 2 * given_seats[k] + 1), -k))
        given_seats[best] += 1
    return given_seats


@pytest.mark.parametrize("weights, seats", [
    ([1], 5), ([10, 10, 10], 7), ([1000] + [4] * 30, 10), ([7, 11, 13, 1, 0, 500], 97), ([1] * 20, 3), ([3, 5], 0), ([100, 1, 1, 1, 1, 1, 1, 1], 50),
])
def test_apportionment(spark, weights, seats):
    rows = spark.createDataFrame([("g", k, w) for k, w in enumerate(weights)], "g string, k int, w long")
    found = {r["k"]: r["n"] for r in apportion(rows, F.lit(seats), F.col("w"), ["g"], ["k"], "n").collect()}
    assert [found[k] for k in range(len(weights))] == quotients(weights, seats)


def water(sizes):
    """Targets by sharing the excess again until none is left."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        level = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if level[s] > 3 * sizes[s]]
        if not over:
            return full | level
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


def test_mixture(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "a", "a", "a", "b", "Ö", None]), " ".join("w" * rng.randrange(1, 400))) for k in range(300)]
    rows += [(300, "z", "only four words here"), (301, "z", None), (302, "b", ""), (303, "empty", None), (303, "empty", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"size": F.lit("s"), "_id": F.lit(0)})
    first = mixture(docs, shard_words=5000).collect()
    assert sorted(map(str, first)) == sorted(map(str, mixture(docs.repartition(7), shard_words=5000).collect()))
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    wanted = water(sizes)
    taken = {}
    for r in first:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - wanted[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["whole_copies"] * r["size"] + sum(p["words"] for p in r["pieces"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 64 * 20
    assert mixture(docs.limit(0)).count() == 0
    unique = docs.filter("doc_id != 303").withColumn("n_chars", F.lit(0).cast("long"))
    mixed = mixed_documents(unique, mixture(unique))
    assert mixed.columns == unique.columns
    counts = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert counts == {r["doc_id"]: r["taken"] for r in mixture(unique).collect() if r["taken"]}


def test_pipeline(spark):
    """The stages, each on what the one before has kept, against their operators' promises."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "tokens"]
    final = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    step = {name: f for name, f in corpus_pipeline.STAGES}
    kept = step["quality"](spark, docs, "")
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    unique = step["exact"](spark, kept, "")
    texts = {}
    for r in kept.collect():
        texts[r["text"]] = max(texts.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in unique.collect()} == set(texts.values())
    apart = step["near"](spark, unique, "")
    assert apart.columns == docs.columns and {r["doc_id"] for r in apart.collect()} <= set(texts.values())
    mixed = step["mix"](spark, apart, "")
    assert mixed.columns == docs.columns
    wanted = sorted((r["doc_id"], PLAIN.encode(r["text"], add_special_tokens=False).ids) for r in mixed.collect())
    assert sorted((r["doc_id"], r["ids"]) for r in final) == wanted


def test_blocks_hold_equal_bytes(spark):
    from colloquy.llm.tokenfile import block_bounds

    docs = spark.range(30_000).select((F.col("id") * 7 - 500).alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text")).repartition(9)
    bounds = block_bounds(docs, F.col("doc_id"), F.col("text"), 60)
    assert len(bounds) > 12_000 and (np.diff(bounds) > 0).all()
    sizes = np.zeros(len(bounds) + 1, dtype=int)
    for r in docs.collect():
        sizes[np.searchsorted(bounds, r.doc_id, side="right")] += len(r.text) + 1
    assert sizes.max() < 60 + 50 and len(block_bounds(docs.limit(0), F.col("doc_id"), F.col("text"), 60)) == 0
