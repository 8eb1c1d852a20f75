"""Collocations against a plain count; bursts, spills, chunks and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import collocations as module
from colloquy.llm.collocations import HatTrie, collocations


def plain(rows, min_count, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for n in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(words[k:k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        inside = Counter()
        for p, a in chosen.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    inside[part] = max(inside[part], a)
        scored = []
        for p, a in chosen.items():
            if len(p) == 2 and inside[p] and 100 * inside[p] >= 50 * a:
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(rng):
    words = [f"{rng.choice('ABCdéfgh')}{k}" for k in range(30)] + ["the", "The", "of", " x", "ß"]
    weights = [1] * 30 + [40, 20, 30, 2, 1]

    def text(n):
        return "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; "]) for w in rng.choices(words, weights, k=n))

    rows = [(text(rng.randrange(0, 60)), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    rows += [rows[0]] * 12 + [(None, "en"), ("", "en"), (" \t .,", None), ("a", "one"), (text(5000), "en"), ("same " * 500, "fr"), ("x.y", "fr")]
    return rows


@pytest.mark.parametrize("entries, burst, words, chunk", [(10**6, 8192, 600_000, 1 << 20), (300, 8, 500, 64), (40, 1, 7, 3)])
def test_counts(spark, monkeypatch, entries, burst, words, chunk):
    monkeypatch.setattr(module, "CHUNK_WORDS", words)
    monkeypatch.setattr(module.tokens, "__defaults__", (chunk,))
    rows = rows_of(random.Random(2))
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumns(
        {"phrase": F.lit(1), "_prefix": F.lit(2), "a": F.lit(3), "n": F.lit(4), "doc_id": F.lit(5)}
    )
    found = collocations(frame, min_count=3, top=40, max_entries=entries, burst=burst).collect()
    assert sorted(tuple(r) for r in found) == plain(rows, 3, 40)


def test_products_over_64_bits(spark):
    counts = spark.createDataFrame([(10**13 + 7, 3 * 10**13 + 1, 2 * 10**13 + 9), (10, 10, 10), (10**15, 10**15, 10**15)], "a long, l long, r long")
    for row in counts.withColumn("s", module._exact_score(F.col("a"), F.col("l"), F.col("r"))).collect():
        assert row.s == 1000000 * row.a * row.a // (row.l * row.r)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_trie_bursts_and_spills_whole_subtrees():
    rng = np.random.default_rng(0)
    trie, wanted = HatTrie(burst=30), Counter()
    for _ in range(20):
        one, two, three = rng.integers(1, 6, 200), rng.integers(0, 9, 200), rng.integers(0, 9, 200)
        keys, counts = np.unique(one << 42 | two << 21 | three * (two > 0), return_counts=True)
        trie.add(keys, counts)
        wanted.update(dict(zip(keys.tolist(), counts.tolist())))
    assert trie.entries == len(wanted) and len(trie.containers) > 5 and trie.bounds == sorted(trie.bounds)
    assert max(c.size for c in trie.containers) <= 30
    edges = [b & ((1 << 42) - 1) for b in trie.bounds]
    assert edges.count(0) >= 4  # containers begin at a first word, but below a word that fills several
    first = trie.take(100)
    assert 0 < trie.entries <= 100
    rest = trie.take(0)
    found = Counter(dict(zip(first[0].tolist(), first[1].tolist())))
    assert not set(first[0].tolist()) & set(rest[0].tolist())
    found.update(dict(zip(rest[0].tolist(), rest[1].tolist())))
    assert found == wanted and trie.entries == 0
