"""Shards: bytes near equal, slots gapless, copies together."""
import collections

import pytest
from pyspark.sql import functions as F

from sparkgauge.llm import shards
from tests.llm.conftest import ODD_ROWS


def dealt(frame, n=8, **kw):
    return shards.histogram_shards(frame, n, **kw).select("doc_id", "text", "size", "shard", "slot").collect()


def check(rows, n):
    for s in range(n):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_near_equal_and_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = dealt(docs)
    check(rows, 8)
    assert len(rows) == docs.count() and {r["shard"] for r in rows} == set(range(8))
    sizes = collections.Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    slack = max(r["size"] for r in rows) + 0.01 * sum(sizes.values()) / 8
    assert max(sizes.values()) - min(sizes.values()) <= 2 * slack


def test_hot_text_is_split_by_id(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "copy").otherwise(F.concat(F.lit("t"), F.lpad("id", 4, "0"))).alias("text"))
    rows = dealt(docs, 8)
    check(rows, 8)
    sizes = collections.Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 8
    again = dealt(docs.repartition(7), 8)
    assert {r["doc_id"]: r["shard"] for r in rows} == {r["doc_id"]: r["shard"] for r in again}


def test_small_groups_stay_together(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), (F.col("id") % 1000).cast("string")).alias("text"))
    rows = dealt(docs, 4)
    where = collections.defaultdict(set)
    for r in rows:
        where[r["text"]].add(r["shard"])
    assert all(len(w) == 1 for w in where.values())


def spread(rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    return max(sizes.values()) - min(sizes.values()), sum(sizes.values()) / 8


@pytest.mark.parametrize("rows", [
    [(7, "the same row ten thousand times")] * 10_000,
    [(None, "one text and no id")] * 1000,
    [(None, None)] * 900 + [(i, "x") for i in range(100)],
    [(1, "a text")] * 3000 + [(i, f"text {i}") for i in range(3000)],
])
def test_equal_rows_are_cut_apart(spark, rows):
    found = dealt(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8)
    check(found, 8)
    apart, mean = spread(found)
    assert len(found) == len(rows) and apart <= 0.02 * mean + 2 * max(r["size"] for r in found)


def test_cells_follow_the_size(spark, monkeypatch):
    """With small cells no task of the last exchange holds many rows, though a third of them are one row."""
    monkeypatch.setattr(shards, "CELL_BYTES", 64)
    docs = spark.createDataFrame([(None, "again and again")] * 3000 + [(i, f"some text {i}") for i in range(6000)], "doc_id long, text string")
    names = []
    plain = shards.stored
    monkeypatch.setattr(shards, "stored", lambda df, name: names.append((name, plain(df, name))) or names[-1][1])
    check(dealt(docs, 8), 8)
    assert dict(names)["hot-texts"].first()["__parts"] > 300 and dict(names)["shard-cells"].count() > 2000


def test_order_of_cuts():
    top = -shards.LEAST - 1
    assert shards._after((3, top, top)) == (4, shards.LEAST, shards.LEAST) and shards._after((top,)) is None and shards._after((1, 2)) == (1, 3, shards.LEAST)


def test_odd_rows(odd, empty):
    rows = dealt(odd, 3)
    check(rows, 3)
    assert len(rows) == len(ODD_ROWS)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    assert dealt(empty) == []
    one = dealt(odd.filter("doc_id = 8"), 8)
    check(one, 8)
    assert len(one) == 2
