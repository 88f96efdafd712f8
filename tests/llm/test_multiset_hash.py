"""Multiset fingerprints: order, insertion and deletion, and the edited texts."""
import collections
import hashlib

from pyspark.sql import functions as F

from sparkgauge.llm import multiset_hash as mh
from tests.llm.conftest import ODD_ROWS


def test_order_insertion_and_deletion(spark):
    texts = {"ab": "one line.\ntwo lines!", "ba": "two lines!\none line.", "a": "one line.", "b": "two lines!", "aab": "one line.\none line.\n\ntwo lines!", "": None}
    frame = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(3)
    v = {r["doc_id"]: r["vector"] for r in mh.fingerprints(frame).collect()}
    assert v["ab"] == v["ba"] != v["aab"] and v[""] == [0] * mh.LANES
    pair = spark.createDataFrame([(v["a"], v["b"], v["ab"], v["aab"])], "a array<long>, b array<long>, ab array<long>, aab array<long>")
    put, again, out = pair.select(mh.insert_paragraphs(F.col("a"), F.col("b")), mh.insert_paragraphs(F.col("ab"), F.col("a")),
                                  mh.delete_paragraphs(F.col("a"), F.col("ab"))).first()
    assert put == v["ab"] and again == v["aab"]
    back = spark.createDataFrame([(out, v["ab"])], "a array<long>, b array<long>").select(mh.insert_paragraphs(F.col("a"), F.col("b"))).first()[0]
    assert back == v["a"]


def test_likeness_follows_shared_sentences(spark):
    lines = [f"sentence number {i} stands here." for i in range(200)]
    other = [f"another one {i} is there." for i in range(200)]
    rows = [(k, "\n".join(lines[:200 - k] + other[:k])) for k in (0, 50, 100, 200)]
    v = mh.fingerprints(spark.createDataFrame(rows, "doc_id int, text string"))
    base = v.filter("doc_id = 0").select(F.col("vector").alias("base"))
    near = {r[0]: r[1] for r in v.crossJoin(F.broadcast(base)).select("doc_id", mh.likeness(F.col("vector"), F.col("base"))).collect()}
    assert near[0] == 1.0 and near[50] > near[100] > near[200] and abs(near[100] - 0.5) < 0.3


def expected(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1] or ""
        text = text or ""
        half = len(text) // 2
        yield i, len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()


def test_edited_texts_over_many_ranges(spark, monkeypatch, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = set(expected([tuple(r) for r in docs.collect()]))
    for size in (1 << 14, mh.RANGE_BYTES):
        monkeypatch.setattr(mh, "RANGE_BYTES", size)
        rows = mh.edited_fingerprints(docs).collect()
        assert {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows} == want and len(rows) == len(want)
    by_id = {r["doc_id"]: r for r in rows}
    ids = sorted(by_id, reverse=True)
    assert all(by_id[a]["next_vector"] == by_id[b]["vector"] for a, b in zip(ids, [*ids[1:], ids[0]]))


def test_rows_without_ids_and_equal_rows_over_many_ranges(spark, monkeypatch):
    """No range holds a large share of the rows; the chain of next texts goes once round all of them."""
    rows = [(None, f"no id {i % 700}") for i in range(2000)] + [(5, "the same row")] * 2000 + [(i, f"text {i}") for i in range(2000)] + [(9, f"of nine {i}") for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    monkeypatch.setattr(mh, "RANGE_BYTES", 500)
    keyed = frame.withColumn("tie", F.xxhash64("text"))
    ranged = mh._in_ranges(keyed)
    assert ranged.groupBy("range").count().agg(F.max("count")).first()[0] <= len(rows) / 20
    edges = ranged.groupBy("range").agg(F.max(F.coalesce(-F.col("doc_id"), F.lit(1 << 40))).alias("last"), F.min(F.coalesce(-F.col("doc_id"), F.lit(1 << 40))).alias("first")).orderBy("range").collect()
    assert all(a["last"] <= b["first"] for a, b in zip(edges, edges[1:]))
    found = mh.edited_fingerprints(frame).collect()
    assert len(found) == len(rows)
    texts, nexts = collections.Counter(), collections.Counter()
    for r in found:
        texts[tuple(r["vector"])] += 1
        nexts[tuple(r["next_vector"])] += 1
    assert texts == nexts
    # Of 2000 equal rows all but the last are followed by an equal one.
    same = next(tuple(r["vector"]) for r in found if r["doc_id"] == 5 and texts[tuple(r["vector"])] == 2000)
    assert sum(tuple(r["vector"]) == same == tuple(r["next_vector"]) for r in found) >= 1998


def test_more_tasks_for_more_text(spark, monkeypatch):
    monkeypatch.setattr(mh, "RANGE_BYTES", 1000)
    monkeypatch.setattr(mh, "TASK_BYTES", 4000)
    frame = spark.createDataFrame([(i, f"line {i % 50} of it.\nand more " * 10) for i in range(600)], "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    assert mh._in_ranges(frame).rdd.getNumPartitions() > 20
    rows = mh.edited_fingerprints(frame).collect()
    assert {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows} == set(expected([(r["doc_id"], r["text"]) for r in frame.collect()]))


def test_cuts_are_counted_in_two_steps(spark):
    for cuts in ([3], [1, 5], list(range(0, 300, 3)), list(range(17))):
        frame = spark.range(-5, 310).select("id", mh._below(cuts, F.col("id")).alias("n"))
        assert all(r["n"] == sum(c < r["id"] for c in cuts) for r in frame.collect())


def test_odd_rows(odd, empty, monkeypatch):
    rows = mh.edited_fingerprints(odd).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in rows) == sorted((str(i), len(t or "")) for i, t in ODD_ROWS)
    assert all(r["next_vector"] is not None for r in rows)
    assert mh.edited_fingerprints(empty).collect() == []
    monkeypatch.setattr(mh, "RANGE_BYTES", 1000)
    many = mh.edited_fingerprints(odd).collect()
    assert len(many) == len(rows)
    by_text = {r["doc_id"]: r["vector"] for r in many}
    assert by_text[1] == by_text[7] and by_text[2] == by_text[3]
