"""Merged states of parts against the profile of the whole, and the store's latest state of each part."""
import collections
import random

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators.moments import column_moments
from sparkgauge.plans import states
from sparkgauge.sources import sinks


def table(spark, seed, n=900):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, rnd.gauss(1e7, 3), rnd.expovariate(0.1)]), 5, rnd.choice(["a", "b", None]), f"v{rnd.randrange(400)}", None, i % 9) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, same int, c string, many string, none string, part int")


@pytest.fixture(scope="module")
def whole(spark):
    return table(spark, 1).cache()


def test_parts_merge_to_the_whole(spark, whole, monkeypatch):
    monkeypatch.setattr(states, "TOP_HELD", 50)
    parts = [states.profile_state(whole.filter(F.col("part").isin(*p)), str(p)) for p in ((0,), (1, 2, 3), (4,), (5, 6, 7, 8), (99,))]
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    got = {r["column_name"]: r for r in states.merged_profile(together, (0.0, 0.5, 1.0)).collect()}
    for r in column_moments(whole).collect():
        g = got[r["column_name"]]
        assert g["row_count"] == 900 and g["row_count"] - g["null_count"] == r["n"] and (g["min"], g["max"]) == (r["min"], r["max"])
        for c in ("mean", "variance", "skewness", "kurtosis"):
            assert g[c] == pytest.approx(r[c], rel=1e-6, abs=1e-9)
    assert got["none"]["null_count"] == 900 and got["none"]["distinct_estimate"] == 0 and got["none"]["mean"] is None
    assert abs(got["many"]["distinct_estimate"] - whole.select("many").distinct().count()) <= 8
    ends = whole.agg(F.min("id"), F.max("id")).first()
    assert (got["id"]["quantile_estimates"][0], got["id"]["quantile_estimates"][2]) == tuple(ends) and abs(got["id"]["quantile_estimates"][1] - 450) < 20
    truth = collections.Counter((c, r[c]) for r in whole.collect() for c in ("c", "many") if r[c] is not None)
    top = states.merged_top(together, 5).collect()
    assert all(r["count"] <= truth[r["column_name"], r["key"]] <= r["count_at_most"] for r in top)
    assert sum(r["column_name"] == "c" and r["count"] == r["count_at_most"] for r in top) == 2
    assert any(r["count"] < r["count_at_most"] for r in top if r["column_name"] == "many")


def test_latest_state_of_each_part_counts(spark, whole, tmp_path):
    path = str(tmp_path / "states")
    for rows, part in ((whole.filter("part < 2"), "a"), (whole.filter("part = 8"), "b"), (whole.filter("part < 8"), "a")):
        states.append_state(states.profile_state(rows, part), path)
    merged = states.merged_profile(states.current_states(spark, path)).filter("column_name = 'id'").first()
    assert merged["row_count"] == 900 and merged["mean"] == pytest.approx(449.5)
    # A part with a column more
    states.append_state(states.profile_state(whole.filter("part = 8").withColumn("new", F.lit(1.5)), "b"), path)
    both = {r["column_name"]: r["row_count"] for r in states.merged_profile(states.current_states(spark, path)).collect()}
    assert both["id"] == 900 and both["new"] == 100


def test_empty_part(spark, whole):
    got = states.merged_profile(states.profile_state(whole.limit(0), "none")).collect()
    assert len(got) == 7 and all(r["row_count"] == 0 and r["mean"] is None and r["min"] is None for r in got)


def test_numbers_of_a_write(spark, whole, tmp_path):
    rows = whole.select("x", "c", "none")
    told = sinks.write_observed(rows, str(tmp_path / "out"))
    want = rows.agg(F.count(F.lit(1)), F.count("x") + F.count("c") + F.count("none"), F.count_if(F.coalesce(F.col("x").cast("string"), "c", "none").isNull())).first()
    assert told == {"rows": want[0], "missing_cells": 3 * want[0] - want[1], "empty_rows": want[2]} and spark.read.parquet(str(tmp_path / "out")).count() == 900
    assert sinks.write_observed(rows.limit(0), str(tmp_path / "none")) == {"rows": 0, "missing_cells": 0, "empty_rows": 0}
