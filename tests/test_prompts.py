"""Extraction, normalization, filters, splits, sources."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import hashing, text
from colloquy.operators import canonical
from colloquy.operators.sequences import count_adjacent_states, top_n_per_group, with_row_number
from colloquy.operators.splits import assign_splits
from colloquy.plans.prompts import canonical_prompts, regenerate_splits, run_prompts
from colloquy.schema import CANONICAL_COLUMNS, first_existing, require_one_of
from colloquy.settings import CanonicalSettings, LanguageFilter, SplitSettings
from colloquy.sources.conversations import extract_long_prompts, extract_user_prompts
from colloquy.sources.files import read_dataset, write_dataset, write_json_lines
from colloquy.streaming.acquire import stream_classified, stream_conversations, stream_prompts, write_stream

RECORD = {
    "conversation_id": "abc", "timestamp": "2024-01-01T00:00:00Z", "language": "English", "model": "m",
    "conversation": [
        {"role": "user", "content": " Hello   there "}, {"role": "assistant", "content": "Hi"},
        {"role": "user", "content": "Can you help me study?"},
    ],
}


def test_user_prompts_of_nested_records(spark):
    df = spark.createDataFrame([RECORD], "conversation_id string, timestamp string, language string, model string, "
                               "conversation array<struct<role:string,content:string>>")
    rows = extract_user_prompts(df, "set").orderBy("turn_index").collect()
    assert [r.prompt for r in rows] == ["Hello there", "Can you help me study?"]
    assert [(r.turn_index, r.message_index) for r in rows] == [(0, 0), (1, 2)]
    assert rows[0].source_dataset == "set" and rows[0].language == "English"


def test_wrapped_json_and_alternative_fields(spark):
    listed = json.dumps([{"from": "user", "value": "one"}, {"from": "gpt", "value": "x"}])
    wrapped = json.dumps({"messages": [{"role": "user", "content": "two"}, None, {"role": "user", "content": " "}]})
    df = spark.createDataFrame([(listed,), (wrapped,), ("broken [",), (None,)], "conversation string")
    rows = {(r.conversation_id, r.prompt) for r in extract_user_prompts(df, "s", fallback_prefix="c").collect()}
    assert {p for _, p in rows} == {"one", "two"}
    assert all(re.fullmatch(r"c_\d", c) for c, _ in rows)


def test_limits(spark):
    rows = [("a", [("user", "one"), ("user", "two")]), ("b", [("user", "three")])]
    df = spark.createDataFrame(rows, "conversation_id string, conversation array<struct<role:string,content:string>>").coalesce(1)
    assert [r.prompt for r in extract_user_prompts(df, "s", sample_size=2).collect()] == ["one", "two"]
    assert extract_user_prompts(df, "s", max_conversations=1).count() == 2
    assert extract_user_prompts(df, "s", sample_size=0).count() == 3


def test_nested_columns_through_csv(spark, tmp_path):
    schema = "k int, m map<string,double>, l array<string>, s struct<a:int,b:string>, t string"
    rows = [(1, {"joy": 0.5}, ["a", 'b "q"'], (3, "x,y"), ""), (2, None, None, None, None), (3, {}, [], (None, None), "two\nlines")]
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "nested.csv")
    write_dataset(df, path)
    wanted = df.withColumn("t", F.nullif("t", F.lit(""))).orderBy("k").collect()
    assert read_dataset(spark, path, schema).orderBy("k").collect() == wanted
    flat = df.filter("k < 3")
    write_dataset(flat, path)
    assert read_dataset(spark, path, schema, multi_line=False).orderBy("k").collect() == wanted[:2]


def test_long_conversations_are_numbered_over_blocks(spark):
    messages = spark.range(100).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("text").alias("text"),
    )
    rows = extract_long_prompts(messages, turns_per_block=7).orderBy("message_index").collect()
    assert [r.turn_index for r in rows] == list(range(34))
    assert [r.message_index for r in rows] == list(range(0, 100, 3))


def test_normalize_small_frame(spark):
    raw = spark.createDataFrame(
        [(" How can I write a Python function? ", "2024-01-01T12:00:00Z", "a", 1), ("print('hello')", "not-a-date", "a", 2)],
        "prompt string, created_at string, conversation_id string, turn long",
    )
    out = canonical.normalize_records(raw, "unit")
    assert tuple(out.columns) == CANONICAL_COLUMNS
    first, second = out.orderBy("turn_index").collect()
    assert first.prompt_text == "How can I write a Python function?"
    assert first.has_question and not first.is_short_prompt and first.year_month == "2024-01"
    assert first.raw_text_hash == hashlib.sha256(first.prompt_text.encode()).hexdigest()
    assert first.record_id == "prompt_" + first.raw_text_hash[:16]
    assert second.contains_code and second.timestamp is None and second.is_short_prompt


def test_missing_optional_columns(spark):
    out = canonical.normalize_records(spark.createDataFrame([("hello you",), (None,)], "text string").coalesce(1), "x")
    rows = out.orderBy("turn_index").collect()
    assert [r.turn_index for r in rows] == [0, 1] and rows[1].prompt_text == ""
    assert rows[0].conversation_id == "conversation_" + rows[0].raw_text_hash[:16]
    assert rows[0].language == "en" and rows[0].language_original is None
    with pytest.raises(ValueError, match="prompt text"):
        canonical.normalize_records(spark.createDataFrame([(1,)], "x int"), "x")


def test_column_resolution():
    assert first_existing(["b", "a"], ["a", "b"]) == "a"
    assert first_existing(["c"], ["a"]) is None
    with pytest.raises(ValueError, match="a, b"):
        require_one_of(["c"], ["a", "b"], "text")


TEXTS = [
    "", "tab\tand nbsp　wide", "What is this", "whatever", "shésad is", "say éis", "no stop.",
    "class Foo", "classy", "SELECT a FROM b", "from x import y", "FUNCTION f(", "print (1)", "console.log", "consoleXlog",
    "```", "define it", "def f(x)", "Act as a tutor; you are", "do not do not include", "again again, AGAIN!", "Stop. Go! Why?!",
    "ich bin ein Haus", "un deux", "éèêë the", "don't you", "café code", "importx", "import  os",
]


def test_text_flags_agree_with_python(spark):
    words = "a an and are can do for how i in is it me my of on please the to what with you".split()
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("n", text.normalize_whitespace(F.col("t")))
    n = F.col("n")
    rows = df.select(
        "t", "n", text.has_question(n).alias("q"), text.contains_code(n).alias("c"), text.detect_language(n).alias("l"),
        text.word_count(n).alias("w"), text.sentence_count(n).alias("s"),
        text.phrase_count(n, text.INSTRUCTION_PHRASES).alias("i"), text.phrase_count(n, text.RECURSION_PHRASES).alias("r"),
        text.has_phrase(n, text.ROLE_PHRASES).alias("role"),
    ).collect()
    for row in rows:
        plain = re.sub(r"\s+", " ", row.t).strip()
        assert row.n == plain
        question = "?" in plain or re.search(r"\b(?:" + "|".join(text.QUESTION_WORDS) + r")\b", plain, re.I)
        assert row.q == bool(question), plain
        assert row.c == bool(re.search("|".join(text.CODE_ALTERNATIVES), plain, re.I | re.S)), plain
        assert row.w == len(plain.split()) and row.s == max(1, len(re.findall(r"[.!?]+", plain)))
        for got, phrases in ((row.i, text.INSTRUCTION_PHRASES), (row.r, text.RECURSION_PHRASES)):
            assert got == len(re.findall(r"\b(?:" + "|".join(phrases) + r")\b", plain, re.I)), plain
        assert row.role == bool(re.search(r"\b(?:" + "|".join(text.ROLE_PHRASES) + r")\b", plain, re.I))
        found = set(re.findall(r"[a-zA-Z']+", plain.lower()))
        ratio = sum(ord(c) < 128 for c in plain) / max(1, len(plain))
        english = plain and ratio >= 0.85 and (found & set(words) or len(found) <= 3)
        assert row.l == ("en" if english else "unknown"), plain


def test_language_labels(spark):
    df = spark.createDataFrame([(" English ",), ("ENG",), (" ",), (None,), ("De",)], "x string")
    assert [r[0] for r in df.select(text.normalize_language_label(F.col("x"))).collect()] == ["en", "en", "unknown", "unknown", "de"]


def test_filters_and_deduplication(spark):
    rows = [("same text here", "b", 0, "en"), ("same  text here", "a", 5, "fr"), ("ok", "c", 0, "en"), ("word", "d", 0, "en"),
            ("two words", "e", 1, "English")]
    raw = spark.createDataFrame(rows, "prompt string, conversation_id string, turn long, language string")
    kept = canonical.filter_records(canonical.normalize_records(raw, "x")).collect()
    assert {(r.prompt_text, r.conversation_id) for r in kept} == {("same text here", "a"), ("two words", "e")}
    english = CanonicalSettings(language_filter=LanguageFilter(True, ("English",)))
    kept = canonical.filter_records(canonical.normalize_records(raw, "x"), english).collect()
    assert {r.conversation_id for r in kept} == {"b", "e"}


def test_length_outliers(spark):
    raw = spark.range(1, 101).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), "id"), lambda i: i.cast("string"))).alias("prompt"),
                                     F.col("id").alias("turn"))
    settings = CanonicalSettings(min_prompt_words=1, min_prompt_chars=1)
    flagged = canonical.filter_records(canonical.normalize_records(raw, "x", settings), settings)
    assert [r.prompt_word_count for r in flagged.filter("is_length_outlier").collect()] == [100]
    removed = CanonicalSettings(min_prompt_words=1, min_prompt_chars=1, remove_long_prompts=True)
    assert canonical.filter_records(canonical.normalize_records(raw, "x", removed), removed).count() == 99


def test_splits_are_deterministic_and_keep_conversations(spark):
    df = spark.range(500).select((F.col("id") % 100).cast("string").alias("conversation_id"), F.col("id").cast("string").alias("record_id"))
    placed = assign_splits(df)
    assert placed.groupBy("conversation_id").agg(F.count_distinct("data_split").alias("n")).filter("n > 1").count() == 0
    for key, split in {(r.conversation_id, r.data_split) for r in placed.collect()}:
        u = int(hashlib.sha256(key.encode()).hexdigest()[:16], 16) / 16**16
        assert split == ("train" if u < 0.7 else "validation" if u < 0.85 else "test")
    assert assign_splits(df, SplitSettings(enabled=False)).filter("data_split is not null").count() == 0
    with pytest.raises(ValueError):
        assign_splits(df, SplitSettings(train=0.5))


def test_unit_interval(spark):
    value = spark.range(1).select(hashing.unit_interval(F.lit("abc"))).first()[0]
    assert value == int(hashlib.sha256(b"abc").hexdigest()[:16], 16) / 16**16


@pytest.mark.parametrize("suffix", ["csv", "json", "jsonl", "ndjson", "parquet"])
def test_formats_round_trip(spark, tmp_path, suffix):
    df = spark.createDataFrame([(1, 'a "quoted", line\nbreak'), (2, "plain")], "id long, t string")
    path = str(tmp_path / f"data.{suffix}")
    write_dataset(df, path)
    back = read_dataset(spark, path, "id long, t string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        read_dataset(spark, str(tmp_path / "data.txt"))


def test_json_lines_keep_iso_times(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP '2024-01-02 03:04:05' AS ts, CAST(NULL AS STRING) AS x")
    write_json_lines(df, str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    assert json.loads(line) == {"id": 1, "ts": "2024-01-02T03:04:05Z", "x": None}


def test_run_from_csv(spark, tmp_path):
    source = tmp_path / "prompts.csv"
    source.write_text("prompt,created_at,conversation_id,turn\n"
                      "How do I learn Spark?,2024-01-01T00:00:00Z,a,1\n"
                      "How do I learn Spark?,2024-01-02T00:00:00Z,b,1\n"
                      "Explain this code please,2024-01-03T00:00:00Z,c,1\n")
    record = run_prompts(spark, str(source), str(tmp_path / "out.parquet"), split_folder=str(tmp_path / "splits"),
                         record_path=str(tmp_path / "runs")).first()
    details = json.loads(record.details)
    assert (details["raw_rows"], details["processed_rows"], details["dropped_rows"]) == (3, 2, 1)
    assert set(details["split_counts"]) <= {"train", "validation", "test"}
    assert spark.read.json(str(tmp_path / "runs")).count() == 1
    counts = regenerate_splits(spark, str(tmp_path / "out.parquet"), str(tmp_path / "again"))
    assert sum(counts.values()) == 2


def test_threshold_reuses_the_deduplication_shuffle(spark):
    raw = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "source", "doc_id", "lang")
    df = canonical_prompts(raw.withColumnRenamed("doc_id", "turn"), "x")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final or "ReusedSubquery" in final


def test_row_numbers(spark):
    df = spark.range(0, 1000, 1, 7)
    rows = with_row_number(df, "n").collect()
    assert all(r.id == r.n for r in rows)


def test_top_n_per_group_matches_brute_force(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("g"),
                                  (F.col("id") * 7919 % 1009).alias("v"), "id")
    got = {(r.g, r.id, r._rank) for r in top_n_per_group(df, ["g"], [F.desc("v"), F.col("id")], 4, ["id"], salts=8).collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r.g, []).append((-r.v, r.id))
    assert got == {(g, i, k + 1) for g, rows in by.items() for k, (_, i) in enumerate(sorted(rows)[:4])}


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_adjacent_states_match_brute_force(spark, partitions):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("k"),
        (F.col("id") * 31 % 97).alias("o"), "id",
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise((F.col("id") * 17 % 5).cast("string")).alias("s"),
    )
    by = {}
    for r in df.collect():
        if r.s is not None:
            by.setdefault(r.k, []).append((r.o, r.id, r.s))
    want = {}
    for rows in by.values():
        rows.sort()
        for a, b in zip(rows, rows[1:]):
            want[(a[2], b[2])] = want.get((a[2], b[2]), 0) + 1
    got = {(r.from_state, r.to_state): r.n for r in count_adjacent_states(df, "k", [F.col("o"), F.col("id")], "s", partitions).collect()}
    assert got == want


def test_stream_matches_batch_and_picks_up_new_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(RECORD) + "\n")
    prompts = stream_prompts(stream_conversations(spark, str(folder)), "set")
    classified = stream_classified(prompts, "set").drop("emotion_scores")
    for expected in (2, 4):
        write_stream(classified, str(tmp_path / "out"), str(tmp_path / "state"), "parquet").awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out"))
        assert rows.count() == expected
        (folder / "b.json").write_text(json.dumps({**RECORD, "conversation_id": "z"}) + "\n")
    assert {"interaction_mode", "prompt_sophistication_score"} <= set(rows.columns)


def test_transitions_across_partitions_without_states(spark):
    rows = [("a", k, "first" if k == 0 else "last" if k == 999 else None) for k in range(1000)] + [(None, 5, "lost"), ("b", 1, "alone")]
    df = spark.createDataFrame(rows, "k string, o long, s string")
    got = [tuple(r) for r in count_adjacent_states(df, "k", [F.col("o")], "s", 8).collect()]
    assert got == [("first", "last", 1)]
