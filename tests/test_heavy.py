"""The most frequent values against direct counts: exact, proven, counted by hashes, crowded with ties."""
import collections
import random

import pyarrow as pa
import pytest

from sparkgauge.operators import heavy
from sparkgauge.operators.frequencies import top_values, value_facts

LONG = "a text of more than sixty four characters, which all of these have in common: "


def columns(seed, n=3000):
    rnd = random.Random(seed)
    return {
        "few": [rnd.choice(["x", "y", "é", "", None]) for _ in range(n)],
        "skewed": [str(int(rnd.paretovariate(0.8)) % 5000) for _ in range(n)],
        "even": [str(i % 700) for i in range(n)],
        "distinct": [f"v{i:05d}" for i in rnd.sample(range(n), n)],
        "long": [LONG + str(i) for i in rnd.sample(range(n), n)],
        "twice": [LONG + str(i // 2) for i in rnd.sample(range(n), n)],
        "head": [LONG + str(i) if i % 3 else "often" + "n" * (i % 2) for i in rnd.sample(range(n), n)],
        "gone": [None] * n,
    }


def direct(values, k):
    counts = collections.Counter(v for v in values if v is not None)
    ordered = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:k]
    return [(i + 1, v, c, round(c * 100 / len(values), 2)) for i, (v, c) in enumerate(ordered)]


@pytest.mark.parametrize("held, sent, candidates, fetched", [(1 << 15, 1 << 11, 20_000, 200), (100, 40, 20_000, 200), (100, 40, 30, 5), (8, 2, 0, 0)])
def test_first_k_of_every_kind(spark, monkeypatch, held, sent, candidates, fetched):
    for name, value in (("HELD", held), ("SENT", sent), ("MOST_CANDIDATES", candidates), ("MOST_FETCHED", fetched)):
        monkeypatch.setattr(heavy, name, value)
    data = columns(held)
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"`{c}` string" for c in data)).repartition(3)
    got = collections.defaultdict(list)
    for r in top_values(df, k=7).orderBy("column_name", "rank").collect():
        got[r["column_name"]].append((r["rank"], r["value"], r["count"], r["percentage"]))
    assert dict(got) == {c: direct(v, 7) for c, v in data.items() if c != "gone"}


def test_hashes_that_two_values_share(spark, monkeypatch):
    """Values are chosen by what their hash counts, so the limit must fall when that was of several values."""
    monkeypatch.setattr(heavy, "HELD", 4)
    whole = heavy.F.xxhash64
    monkeypatch.setattr(heavy.F, "xxhash64", lambda *c: heavy.F.char_length(c[0]).cast("long") if len(c) == 1 else whole(*c))
    values = ["aa"] * 5 + ["bb"] * 4 + ["cc"] * 4 + ["ddd"] * 8 + ["eeee"] * 7 + ["ffffff"] * 3 + [f"x{i:08d}" for i in range(9)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(2)
    for candidates in (20_000, 0):
        monkeypatch.setattr(heavy, "MOST_CANDIDATES", candidates)
        rows = [(r["rank"], r["value"], r["count"], r["percentage"]) for r in top_values(df, k=4).orderBy("rank").collect()]
        assert rows == direct(values, 4)


def test_sketch_never_misses_more_than_it_says():
    rnd = random.Random(1)
    stream = [str(int(rnd.paretovariate(0.7)) % 900) for _ in range(20_000)]
    sketch = heavy.Sketch(50, 20)
    for at in range(0, len(stream), 640):
        sketch.add(pa.array(stream[at:at + 640], pa.string()))
    counts, missed = sketch.sent()
    truth, told = collections.Counter(stream), dict(counts)
    assert all(told.get(v, 0) <= n <= told.get(v, 0) + missed for v, n in truth.items()) and missed > 0 and len(counts) <= 20


def test_distinct_texts_do_not_cross_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(heavy, "HELD", 100)
    df = spark.range(5000).selectExpr(f"'{LONG}' || id AS t").repartition(2)
    sent = heavy.sketched(df.select(heavy.value_key(df["t"]).alias("c0")), 1).filter("key is not null").count()
    assert sent <= 2 * 100


def test_value_facts_by_sketch_and_by_hashes(spark, monkeypatch):
    data = columns(3) | {"day": [f"2024-01-{1 + i % 28:02d}" for i in range(3000)], "days": [f"{1500 + i % 2000}-05-07" for i in range(3000)],
                         "yes": [" " * 80 + "Yes" if i % 2 else "no" for i in range(3000)], "mixed": ["2024-01-01" if i % 9 else f"x{i}" for i in range(3000)]}
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"`{c}` string" for c in data)).repartition(3)
    for held in (1 << 15, 100):
        monkeypatch.setattr(heavy, "HELD", held)
        facts = {r["column_name"]: r for r in value_facts(df).collect()}
        assert set(facts) == set(data)
        for c, values in data.items():
            there = [v for v in values if v is not None]
            r = facts[c]
            assert (r["row_count"], r["null_count"], r["distinct_count"]) == (3000, 3000 - len(there), len(set(there)))
            assert r["avg_length"] == (pytest.approx(sum(map(len, there)) / len(there)) if there else None)
            assert r["all_dates"] == (c in ("day", "days")) and r["boolean_pair"] == (c == "yes")


def test_empty(spark):
    assert top_values(spark.createDataFrame([], "a string, b string")).collect() == []
