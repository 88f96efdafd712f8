"""Inner product search against brute force."""
import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.llm import ann


def brute(vectors, own, query, k):
    rows = [(-float(np.dot(v, query)), i) for i, v in vectors if i != own]
    return [(i, -s) for s, i in sorted(rows)[:k]]


def test_one_list_is_exact_with_ties_and_bad_vectors(spark):
    rnd = np.random.default_rng(3)
    good = [(i, rnd.standard_normal(20).round(1).tolist()) for i in range(120)]
    good += [(i, good[7][1]) for i in range(200, 240)]
    bad = [(300, None), (301, [0.0] * 20), (302, [float("nan")] * 20), (303, [float("inf")] + [1.0] * 19), (304, [None] + [1.0] * 19), (305, [1.0]), (None, [1.0] * 20)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<double>, list int").repartition(3)
    got = collections.defaultdict(list)
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, strictness=100.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    queries = [i for i, _ in good if i % 20 == 0]
    assert sorted(got) == queries
    for i in queries:
        want = brute(good, i, dict(good)[i], 20)
        assert [g[0] for g in got[i]] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got[i]], [w[1] for w in want], atol=1e-12)
    few = frame.filter("vec_id in (1, 2, 20)")
    assert ann.search(few, F.col("vec_id") == 20).count() == 2
    assert ann.search(frame.limit(0), F.col("vec_id") == 20).collect() == []


def test_rows_that_repeat_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.5, 0.5]), (3, [0.0, 2.0]), (3, [0.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = ann.search(frame, F.col("vec_id").isin(1, 3), strictness=100.0).collect()
    lists = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        lists[r["query_id"], r["rank"]].append((r["vec_id"], round(r["score"], 6)))
    assert sorted(lists[1, 1]) == [(1, 0.9), (1, 0.9)] and sorted(lists[1, 2]) == [(2, 0.5), (2, 0.5)]
    assert lists[3, 1] == [(3, 4.0), (3, 4.0)] and len(got) == 4 * 4


def test_queries_dealt_over_tasks(spark, sf, monkeypatch):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    whole = sorted(map(tuple, ann.search(frame, F.col("vec_id") % 20 == 0, list_rows=50).collect()))
    monkeypatch.setattr(ann, "QUERY_ROWS", 3)
    assert sorted(map(tuple, ann.search(frame, F.col("vec_id") % 20 == 0, list_rows=50).collect())) == whole


@pytest.mark.parametrize("block", [64, ann.BLOCK_ROWS])
def test_recall_over_many_lists(spark, sf, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = [(r["vec_id"], np.array(r["embedding"])) for r in frame.collect()]
    found = ann.search(frame, F.col("vec_id") % 20 == 0, list_rows=25).collect()
    got = collections.defaultdict(set)
    for r in found:
        got[r["query_id"]].add(r["vec_id"])
    hits = [len(got[i] & {w[0] for w in brute(vectors, i, v, 20)}) / 20 for i, v in vectors if i % 20 == 0]
    assert np.mean(hits) >= 0.9 and all(len(g) == 20 for g in got.values())


def test_abandoning_saves_work_and_keeps_the_best():
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    block = ann.Block(np.arange(2000), np.arange(2000), x, 1.5)
    hits = [len(set(block.search(q, x[q], 10, -np.inf)[0]) & {i for i, _ in brute(list(enumerate(x)), q, x[q], 10)}) for q in range(30)]
    assert np.mean(hits) >= 9.5


def test_queries_at_once_find_what_each_finds_alone():
    random = np.random.default_rng(3)
    vectors, queries = random.standard_normal((300, 40)), random.standard_normal((25, 40))
    ids = random.permutation(np.repeat(np.arange(150), 2))
    block = ann.Block(np.arange(300), ids, vectors, 1.5)
    owns, floors = np.arange(25), np.sort(vectors @ queries.T, axis=0)[-12]
    floors[3] = 1e9
    place, found, scores = block.search_many(owns, queries, 5, floors)
    for i in range(25):
        alone = block.search(owns[i], queries[i], 5, floors[i])
        assert found[place == i].tolist() == alone[0].tolist() and scores[place == i].tolist() == alone[1].tolist()
