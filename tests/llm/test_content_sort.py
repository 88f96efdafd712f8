"""Exact duplicates against brute force, over small partitions, hot groups and odd rows."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkgauge.llm import content_sort
from sparkgauge.llm.content_sort import exact_duplicates
from tests.llm.conftest import ODD_ROWS


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for body, members in groups.items():
        members.sort()
        keep = None if members[0][1] else members[0][2]
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(None if none else i, keep, len(members), k == 0, sha) for k, (_, none, i) in enumerate(members)]
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in frame.collect()), key=repr)


def many():
    rnd = random.Random(5)
    rows = [(i, "one text that a third of all rows hold" + " " * rnd.randrange(3)) for i in range(2000)]
    rows += [(10_000 + i, rnd.choice(["a b", "ab", "a\tb", "a\x0bb", "a\xa0b", "ab ", "", "  ", None])) for i in range(300)]
    rows += [(20_000 + i, "shared head of more than thirty two bytes " + str(i // 2)) for i in range(2000)]
    return rows


@pytest.mark.parametrize("partitions", [3, 97])
def test_brute_force(spark, monkeypatch, partitions):
    rows = many() + ODD_ROWS
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    size = sum(len((t or "").encode()) for _, t in rows)
    monkeypatch.setattr(content_sort, "PART_BYTES", size // partitions)
    assert found(exact_duplicates(frame)) == brute(rows)


def test_hot_group_is_spread(spark, monkeypatch):
    rows = many()
    monkeypatch.setattr(content_sort, "PART_BYTES", 4000)
    seen = []
    plain = content_sort.stored
    monkeypatch.setattr(content_sort, "stored", lambda df, name: seen.append((name, plain(df, name))) or seen[-1][1])
    exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    runs = dict(seen)["runs"].groupBy("part").count().agg(F.count("*"), F.max("count")).first()
    assert runs[0] > 20 and runs[1] < len(rows) / 8


def test_odd_rows_and_clashing_columns(odd, empty):
    got = exact_duplicates(odd.withColumn("kept", F.lit("x")).withColumn("k0", F.lit(1)).withColumn("root", F.lit(1)))
    assert found(got) == brute(ODD_ROWS)
    assert got.columns.count("kept") == 1 and {"ids", "k0", "root", "score"} <= set(got.columns) and "text" not in got.columns
    assert exact_duplicates(empty).collect() == []
    assert found(exact_duplicates(odd, keep=["doc_id", "text"])) == brute(ODD_ROWS)


def test_long_text(spark):
    long = "x y" * 3_000_000
    rows = [(2, long), (1, long.replace(" ", "")), (3, long + "z")]
    assert found(exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
