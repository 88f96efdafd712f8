"""Fingerprints and components against brute force."""
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkgauge.llm import simhash
from tests.llm.conftest import ODD_ROWS


def roots(codes, most):
    label = list(range(len(codes)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(codes):
        for j in range(i):
            if bin(a ^ codes[j]).count("1") <= most:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(codes))]


def cloud(n, seed):
    """Codes in clusters around few centres, so that segments and nodes are full."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(5)]
    out = set()
    while len(out) < n:
        c = rnd.choice(centres) if rnd.random() < 0.8 else rnd.getrandbits(64)
        for _ in range(rnd.randint(0, 6)):
            c ^= 1 << rnd.randrange(64)
        out.add(c)
    return sorted(out)


@pytest.mark.parametrize("most", [1, 3, 6])
def test_index_finds_what_brute_force_finds(most):
    codes = cloud(700, most)
    rank = lambda c: [c := c ^ c >> s for s in (1, 2, 4, 8, 16, 32)][-1]
    ordered = np.array(sorted(codes, key=rank), np.uint64)
    index = simhash.GrayIndex(np.zeros(len(ordered), np.int64), ordered, most)
    index.link(np.arange(len(ordered)))
    want = roots(ordered.tolist(), most)
    pairs = set(zip(want, index.label.tolist()))
    assert len(pairs) == len(set(want)) == len(set(index.label.tolist()))


@pytest.mark.parametrize("split", [10**6, 40])
def test_links_connect_as_all_pairs(spark, split):
    codes = cloud(600, 9)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(c,) for c in signed * 2] + [(None,)], "fp long").repartition(4)
    edges = simhash.links(frame, 3, split_rows=split)
    named = {r["node"]: r["root"] for r in simhash.components(edges, "a", "b").collect()}
    want = roots(codes, 3)
    got = [named.get(c, c) for c in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_fingerprint_rule():
    text = "A b\tc D\x0be  a b c"
    words = "a b c d e a b c".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(6)]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > 6)
    assert simhash.simhash(text) == want
    assert simhash.simhash("Two  words") == xxhash.xxh64_intdigest("two words", 42)
    assert simhash.simhash(None) == simhash.simhash(" \n") == 0
    assert simhash.simhash("É\u00a0x") == xxhash.xxh64_intdigest("É\u00a0x", 42)


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD_ROWS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["component_id"] == by_id[7]["component_id"] == 1
    assert by_id[2]["component_id"] == by_id[3]["component_id"] == by_id[5]["component_id"] == 2
    assert sum(r["doc_id"] == 8 and r["component_id"] == 8 for r in got) == 2
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {2, None}
    assert simhash.near_duplicates(empty).collect() == []


def test_segments_are_bounded_and_miss_no_pair(spark):
    """Codes that share a long common part: segments are cut again until they are small or nothing is left to cut."""
    rnd = random.Random(12)
    codes = sorted({0xABCD << 48 | rnd.getrandbits(20) << 20 for _ in range(3000)} | set(cloud(200, 3)))
    frame = spark.createDataFrame([(c,) for c in np.array(codes, np.uint64).view(np.int64).tolist()], "fp long")
    rows = simhash.segments(frame, 3, 500).collect()
    members = {}
    for r in rows:
        members.setdefault(r["key"], set()).add(r["code"] & (1 << 64) - 1)
    assert max(map(len, members.values())) <= 500
    pairs = {(a, b) for m in members.values() for a in m for b in m if a < b and bin(a ^ b).count("1") <= 3}
    assert pairs == {(a, b) for i, a in enumerate(codes) for b in codes[i + 1:] if bin(a ^ b).count("1") <= 3}


def test_first_of_each(spark, odd, empty):
    rnd = random.Random(4)
    say = lambda: " ".join(f"w{rnd.randrange(5000)}" for _ in range(50))
    a, b, c, d = say(), say(), say(), say()
    rows = [(1, a), (2, b), (2, a), (5, c), (5, d), (6, c), (6, d), (7, d), (None, a), (None, say()), (None, "x y"), (9, "X  y")]
    rows += [(i, t) for i, t in ODD_ROWS]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("mine")).repartition(3)
    kept = simhash.first_of_each(frame, ["doc_id"])
    assert kept.columns == ["doc_id", "text", "fp"]
    label = roots([simhash.simhash(t) for _, t in rows], 3)
    want = {}
    for (i, _), g in zip(rows, label):
        want[g] = min(want.get(g, 1 << 62), 1 << 62 if i is None else i)
    assert sorted(1 << 62 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted(want.values())
    assert simhash.first_of_each(empty, ["doc_id"]).collect() == []
    assert set(simhash.first_of_each(odd, ["doc_id"]).columns) == set(odd.columns)
