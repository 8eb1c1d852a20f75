"""Exact and near duplicates against brute force, with nulls, ties, repeats and clashing columns."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import simhash
from colloquy.llm.exact import exact_duplicates
from colloquy.llm.simhash import components, near_duplicates, near_links


def prose(rng, words):
    return " ".join(rng.choice(["red", "green", "blue", "wind", "stone", "river"]) + str(rng.randrange(50)) for _ in range(words))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    long = prose(rng, 4000)
    base = [prose(rng, rng.randrange(1, 60)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[k % 7]) for k in range(30)]
    rows += [(200, long), (201, long), (202, long + " end"), (203, long[:-1] + "!"), (204, None), (205, ""), (206, " "), (207, "é"), (208, "é")]
    changed = long.split()
    changed[2000] = "other"
    rows += [(209, " ".join(changed)), (210, long.upper())]
    return rows


def frame(spark, rows):
    # Columns named like the operators' own must not matter.
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"keep_id": F.lit(1), "_id": F.lit("x"), "_rest": F.lit(0), "kept": F.lit(None).cast("string"), "_print": F.lit(5)}
    )


@pytest.mark.parametrize("digits", [{}, {"first_digit": 1, "growth": 2}])
def test_exact(spark, texts, digits):
    wanted = {}
    for i, t in texts:
        same = [j for j, u in texts if (u or "") == (t or "")]
        wanted[i] = (max(same), len(same), i == max(same))
    found = exact_duplicates(frame(spark, texts), **digits).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in found} == wanted
    assert len(found) == len(texts)


def test_exact_edges(spark):
    empty = exact_duplicates(frame(spark, []))
    assert empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and empty.count() == 0
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, None), (3, "b"), (3, "c")]
    found = sorted(exact_duplicates(frame(spark, rows)).collect(), key=str)
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in found)
    assert got == [(0, 0, 1, True), (0, 0, 1, True), (1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (3, 3, 1, True), (3, 3, 1, True)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(numbers, errors):
    """Smallest place reachable, by comparing all pairs."""
    root = list(range(len(numbers)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(numbers)):
        for b in range(a):
            if bin(numbers[a] ^ numbers[b]).count("1") <= errors:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(numbers))]


def test_near(spark, texts):
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(frame(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for _, t in texts]
    ids = [i for i, _ in texts]
    root = classes(prints, 4)
    members = {}
    for i, r in zip(ids, root):
        members.setdefault(r, []).append(i)
    assert found == {i: (f"{p:016x}", min(members[r])) for i, p, r in zip(ids, prints, root)}
    assert found[200][1] == found[201][1] == found[210][1] == 200


def test_near_edges(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (7, None), (8, ""), (9, "\t\n"), (None, "alone in here")]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in near_duplicates(frame(spark, rows)).collect() if r["component_id"])
    assert got == [(0, 1), (1, 1), (1, 1), (7, 7), (8, 7), (9, 7)]


@pytest.mark.parametrize("max_group", [1_000_000, 7])
def test_links_lose_nothing(spark, max_group):
    """A large group of near prints, chains, and strangers; also when groups are cut into parts."""
    rng = random.Random(3)
    numbers = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    for _ in range(80):
        numbers.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))))
    chain = rng.getrandbits(64)
    for _ in range(20):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        numbers.add(chain)
    numbers = sorted(numbers)
    signed = [int(np.uint64(n).astype(np.int64)) for n in numbers]
    nodes = spark.createDataFrame([(k, n) for k, n in enumerate(signed)], "_node long, _print long")
    member = {r["_node"]: r["_component"] for r in components(near_links(nodes, 4, max_group)).collect()}
    assert [member.get(k, k) for k in range(len(numbers))] == classes(numbers, 4)


def test_components_of_a_hub_and_a_path(spark):
    hub = [(0, k) for k in range(1, 200)]
    path = [(1000 + k, 1001 + k) for k in range(60)]
    links = spark.createDataFrame([(b, a) for a, b in hub] + path + [(5, 5)], "_a long, _b long")
    member = {r["_node"]: r["_component"] for r in components(links).collect()}
    assert all(member[k] == 0 for k in range(1, 200)) and all(member[1001 + k] == 1000 for k in range(60))
    assert components(links.limit(0)).count() == 0


def test_trie_prunes_by_error_budget():
    order = simhash._views(4)[0]
    assert sorted(order) == list(range(64)) and len(simhash._views(4)) == 15
    keys = np.sort(np.array([0, 0b1111, 0b11111, 1 << 40], dtype=np.uint64))
    root = simhash._trie_join(keys, np.zeros(4, dtype=np.int64), np.full(4, -1), 0, 4)
    assert len(set(root)) == 1
    root = simhash._trie_join(keys, np.zeros(4, dtype=np.int64), np.full(4, -1), 0, 0)
    assert len(set(root)) == 4
