"""The pipeline's stages on odd rows: missing and repeated ids, clashing columns, empty tables."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from colloquy.llm.simhash import fingerprint

STEP = dict(corpus_pipeline.STAGES)
CLASHES = ("_dropped", "_pieces", "_copies", "_mix_id", "_mixed", "_id", "_node", "_row", "_key", "_doc", "key", "keep_id")


def prose(rng, words):
    return " ".join(rng.choice(["red", "green", "blue", "wind", "stone", "river", "house"]) + str(rng.randrange(300)) for _ in range(words))


def table(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return frame.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})


def rows_of(pairs):
    return [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(pairs)]


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(4)
    base = [prose(rng, 90) for _ in range(30)]
    pairs = [(k, t) for k, t in enumerate(base)]
    pairs += [(3, base[9]), (3, "a text of its own"), (40, base[9]), (41, "gamma"), (41, "gamma"), (None, "delta"), (None, "delta"), (None, base[1])]
    changed = base[5].split()
    changed[44] = "other"
    return pairs + [(50, " ".join(changed)), (None, None), (51, ""), (None, prose(rng, 4000))]


def test_exact_stage_loses_no_text(spark, pairs):
    docs = table(spark, rows_of(pairs))
    kept = STEP["exact"](spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in kept.collect())
    wanted = {}
    for i, t in pairs:
        wanted[t or ""] = max(wanted.get(t or "", -1), -1 if i is None else i)
    assert found == sorted(wanted.items())


def test_near_stage_keeps_one_of_each_group(spark, pairs):
    kept = STEP["near"](spark, table(spark, rows_of(pairs)), "").collect()
    prints = [fingerprint(t, corpus_pipeline.SHINGLE_WORDS) for _, t in pairs]
    root = list(range(len(pairs)))
    for a in range(len(pairs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= corpus_pipeline.MAX_BITS:
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    ids = {}
    for k, r in enumerate(root):
        ids.setdefault(r, []).append(pairs[k][0])
    wanted = [min((i for i in group if i is not None), default=None) for group in ids.values()]
    assert sorted(map(str, (r.doc_id for r in kept))) == sorted(map(str, wanted))


def test_mix_stage_reruns_agree(spark, pairs):
    docs = table(spark, rows_of(pairs))
    mixed = STEP["mix"](spark, docs, "")
    assert mixed.columns == docs.columns
    first = sorted((str(r.doc_id), r.text) for r in mixed.collect())
    assert first == sorted((str(r.doc_id), r.text) for r in STEP["mix"](spark, docs.repartition(5), "").collect())
    originals = {}
    for i, t in pairs:
        originals.setdefault(str(i), []).append((t or "").split())
    for i, t in first:
        words = t.split()
        assert any(words == o or set(words) <= set(o) for o in originals[i])
    assert all(r.n_chars == len(r.text) for r in mixed.collect())


@pytest.mark.parametrize("name", list(STEP))
def test_empty_table(spark, name):
    docs = table(spark, rows_of([(1, "x")])).limit(0)
    out = STEP[name](spark, docs, "")
    assert out.count() == 0 and (name == "tokens" or out.columns == docs.columns)


def test_all_stages_on_odd_rows(spark, pairs):
    docs = table(spark, rows_of(pairs))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() > 0
