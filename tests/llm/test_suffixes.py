"""Repeated passages against brute force over every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import suffixes
from colloquy.llm.suffixes import common_prefixes, remove_repeats, repeat_report, suffix_array


def brute(texts, length):
    windows = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for k in range(len(t) - length + 1):
            if windows[t[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    def prose(words):
        return " ".join(rng.choice(["red", "grün", "blue", "wind", "stone", "río"]) + str(rng.randrange(90)) for _ in range(words))

    passage, line = prose(30), prose(9)
    texts = [prose(rng.randrange(1, 80)) for _ in range(40)]
    texts += [prose(rng.randrange(0, 30)) + " " + passage + " " + prose(rng.randrange(0, 30)) for _ in range(25)]
    texts += [texts[3]] * 6 + [texts[4] + "!", texts[4].replace("e", "a", 1)]
    texts += ["\n".join([line] * 20), "a" * 700, "a" * 45, "abc" * 200, "", None, " ", "\x00" * 90, "é" * 130]
    long = prose(6000)
    return [*texts, long, prose(40) + long[9000:22000] + prose(40), long[:-1] + "?"]


@pytest.mark.parametrize("options", [
    {"length": 40, "gram": 8}, {"length": 40, "gram": 8, "hot": 3, "shard_bytes": 2000, "slice_windows": 60},
    {"length": 33, "gram": 16, "hot": 5},
])
def test_repeats(spark, options, monkeypatch):
    if "hot" in options:
        monkeypatch.setattr(suffixes, "PIECE", 5000)  # long texts in many pieces
    texts = corpus(random.Random(5))
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns(
        {"_uid": F.lit("x"), "_data": F.lit(1), "spans": F.lit(0), "_start": F.lit(0), "kept": F.lit(2)}
    )
    found = sorted(tuple(r) for r in repeat_report(remove_repeats(frame, **options)).select(
        F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    wanted = brute([(t or "").encode() for t in texts], options["length"])
    assert found == sorted((-1 if i is None else i, *w) for (i, _), w in zip(rows, wanted))


def test_spans_and_bytes(spark):
    frame = spark.createDataFrame([(1, "x" * 10 + "0123456789abcdefghij" + "y"), (2, "0123456789abcdefghij"), (3, "other")], "doc_id long, text string")
    rows = {r.doc_id: r for r in remove_repeats(frame, length=20, gram=4).collect()}
    assert [tuple(s) for s in rows[1].spans] == [(10, 30)] and bytes(rows[1].kept) == b"x" * 10 + b"y"
    assert [tuple(s) for s in rows[2].spans] == [(0, 20)] and bytes(rows[2].kept) == b"" and rows[3].spans == []


def test_empty_table(spark):
    assert repeat_report(remove_repeats(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for _ in range(60):
        parts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(8, 40))) for _ in range(rng.randrange(1, 12))]
        sizes = np.array([len(x) for x in parts])
        starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        symbols = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8).astype(np.int64) + 1
        symbols[starts + sizes] = 0
        text, heads = symbols.tolist(), suffixes._heads(symbols, 30)
        order = suffix_array(heads, len(text))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = common_prefixes(heads, order, starts, sizes, 12)
        for a, b in zip(order.tolist(), order[1:].tolist()):
            end = min(len(text) - a, len(text) - b)
            same = next((k for k in range(end) if text[a + k] != text[b + k]), end)
            if text[b] and same < end:
                assert shared[b] == min(same, 12)
