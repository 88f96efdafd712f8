"""Joint counts and sums against direct ones, with blocks, dictionaries and dense tables of every size."""
import collections
import itertools
import math
import random
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import grouped, joint

NAMES = ["a", "b", "c", "d", "many"]


def rows(seed, n=600):
    rnd = random.Random(seed)
    pick = lambda k: None if rnd.random() < 0.15 else "é|" * (rnd.random() < 0.1) + str(int(rnd.random() ** 2 * k))
    number = lambda: rnd.choice([None, float("nan"), 1e9 + rnd.random(), -3.5, 0.0])
    return [(pick(2), pick(3), pick(9), pick(40), f"v{rnd.randrange(10 * n)}", number(), rnd.gauss(5, 2), 7.0) for _ in range(n)]


@pytest.fixture(params=[(128, 1 << 16, 100_000), (10, 50, 100_000), (128, 30, 60), (1, 1, 5)])
def limits(request, monkeypatch):
    for name, value in zip(("BLOCK_CELLS", "DENSE_CELLS", "HELD_VALUES"), request.param):
        monkeypatch.setattr(joint, name, value)


def frame(spark, data):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    return spark.createDataFrame(data, "a string, b string, c string, d string, many string, x double, y double, same double").repartition(3)


def pairs_of(counter_class, data, pairs):
    counter, found = counter_class(5, pairs), collections.Counter()
    for at in range(0, len(data), 37):
        part = data[at:at + 37]
        for batch in [*counter.add([pa.array([r[i] for r in part], pa.string()) for i in range(5)])]:
            for r in batch.to_pylist():
                found[r["pair_ix"], r["value1"], r["value2"]] += r["n"]
    for batch in counter.flush():
        for r in batch.to_pylist():
            found[r["pair_ix"], r["value1"], r["value2"]] += r["n"]
    return found


def test_pairs_for_any_limits(limits):
    data = rows(1)
    pairs = [*itertools.combinations(range(5), 2), (3, 1), (2, 2)]
    want = collections.Counter((p, r[a], r[b]) for r in data for p, (a, b) in enumerate(pairs) if r[a] is not None and r[b] is not None)
    assert pairs_of(joint.PairCounter, data, pairs) == want


def test_moments_for_any_limits(limits):
    data = rows(2)
    summer, states = joint.GroupSummer(5, 3), collections.defaultdict(list)
    batches = []
    for at in range(0, len(data), 37):
        part = data[at:at + 37]
        batches += summer.add([pa.array([r[i] for r in part], pa.string()) for i in range(5)], [pa.array([r[i] for r in part], pa.float64()) for i in (5, 6, 7)])
    for batch in [*batches, *summer.flush()]:
        for r in batch.to_pylist():
            states[r["category_ix"], r["category_value"], r["column_ix"]].append(r)
    want = collections.defaultdict(list)
    for r in data:
        for c in range(5):
            for k, x in enumerate(r[5:]):
                if r[c] is not None and x is not None and not math.isnan(x):
                    want[c, r[c], k].append(x)
    assert set(states) == set(want)
    for key, parts in states.items():
        assert sum(p["n"] for p in parts) == len(want[key])
        assert min(p["lo"] for p in parts) == min(want[key]) and max(p["hi"] for p in parts) == max(want[key])
        mean = sum(p["n"] * p["mean"] for p in parts) / len(want[key])
        assert mean == pytest.approx(statistics.fmean(want[key]), abs=1e-6)


def test_operators_on_a_frame(spark):
    data = rows(3)
    df = frame(spark, data)
    pairs = list(itertools.combinations(NAMES, 2))
    got = {(r["var1"], r["var2"], r["value1"], r["value2"]): r["n"] for r in grouped.crosstab(df, pairs).collect()}
    want = collections.Counter((a, b, r[NAMES.index(a)], r[NAMES.index(b)]) for r in data for a, b in pairs if r[NAMES.index(a)] is not None and r[NAMES.index(b)] is not None)
    assert got == want
    told = {(r["category"], r["category_value"], r["column_name"]): r for r in grouped.group_summaries(df, NAMES[:4], ["x", "y", "same"]).collect()}
    groups = collections.defaultdict(list)
    for r in data:
        for i, c in enumerate(NAMES[:4]):
            for name, x in zip(("x", "y", "same"), r[5:]):
                if r[i] is not None and x is not None and not math.isnan(x):
                    groups[c, r[i], name].append(x)
    assert set(told) == set(groups)
    for key, values in groups.items():
        assert told[key]["n"] == len(values) and told[key]["mean"] == pytest.approx(statistics.fmean(values), abs=1e-6)
        want_variance = None if len(values) == 1 else 0.0 if min(values) == max(values) else statistics.variance(values)
        got_variance = told[key]["variance"]
        assert got_variance == want_variance if want_variance in (None, 0.0) else got_variance == pytest.approx(want_variance, rel=1e-6)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_far_from_each_other_keep_their_digits(spark):
    df = spark.range(2000).select((F.col("id") % 4).cast("string").alias("g"), (F.col("id") % 4 * 1e12 + F.col("id") % 8).alias("x")).repartition(5)
    variance = {r["category_value"]: r["variance"] for r in grouped.group_summaries(df, ["g"], ["x"]).collect()}
    assert all(v == pytest.approx(4 * 500 / 499, rel=1e-4) for v in variance.values())


def test_no_row_is_multiplied(spark):
    df = spark.range(100).select(*[(F.col("id") % k).cast("string").alias(f"c{k}") for k in range(2, 9)], F.col("id").cast("double").alias("x"))
    for made in (grouped.crosstab(df, grouped.category_pairs(df.columns[:-1])), grouped.group_summaries(df, df.columns[:-1], ["x"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Expand" not in plan and plan.count("Range (") == 1


def test_empty_and_infinite(spark):
    empty = spark.createDataFrame([], "a string, b string, x double")
    assert grouped.crosstab(empty, [("a", "b")]).collect() == [] and grouped.group_summaries(empty, ["a"], ["x"]).collect() == []
    assert grouped.crosstab(empty, []).collect() == [] and grouped.group_summaries(empty, [], ["x"]).collect() == []
    df = spark.createDataFrame([("g", 1.0), ("g", float("inf")), ("h", float("inf")), ("h", float("inf")), ("i", None)], "a string, x double")
    got = {r["category_value"]: (r["n"], r["mean"], r["variance"]) for r in grouped.group_summaries(df, ["a"], ["x"]).collect()}
    assert set(got) == {"g", "h"} and got["g"][:2] == (2, math.inf) and math.isnan(got["g"][2]) and got["h"] == (2, math.inf, 0.0)
