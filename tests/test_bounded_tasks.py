"""No task holds, sorts or reads a whole table."""

import glob

import pyarrow as pa
from pyspark.sql import functions as F

from gaugechecks import sources
from sparkgauge.sources import readers


def parts(tmp_path, name):
    return [p for p in glob.glob(f"{tmp_path}/{name}*/part-*")]


def in_tmp(monkeypatch, tmp_path):
    monkeypatch.setattr(sources, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")


def test_split_scan_writes_files_of_a_few_splits(spark, tmp_path, monkeypatch):
    in_tmp(monkeypatch, tmp_path)
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    rows.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    found = sources.csv_split_scan(spark, str(tmp_path)).collect()
    assert len(parts(tmp_path, "quoted-csv")) == 3
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in found) == [(i, f'a" b" {i}\nx,"y"', "en") for i in range(60)]


def test_first_records_are_kept_without_the_others():
    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows]), pa.array([[x] for _, x in rows])], ["file", "header"])

    given = [batch(("a", 1), ("a", 2), ("b", 3)), batch(("b", 4), ("b", 5)), batch(("c", 6), ("c", 7), ("d", 8))]
    kept = [r["header"][0] for b in readers._first_of_files(iter(given)) for r in b.to_pylist()]
    assert kept == [1, 3, 6, 8]


def test_file_headers_sorts_first_records_only(spark, tmp_path):
    for name, head in (("a", "x,y"), ("b", "x,y"), ("c", '"x\n1",z')):
        (tmp_path / f"{name}.csv").write_text(f"{head}\n" + "1,2\n" * 30_000)
    found = readers.file_headers(spark, str(tmp_path))
    assert {(tuple(r["header"]), r["files"]) for r in found.collect()} == {(("x", "y"), 2), (("x\n1", "z"), 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_surplus_records_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    in_tmp(monkeypatch, tmp_path)
    spark.range(70).select(F.col("id").alias("o_orderkey")).repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    found = sources.record_violations(spark, str(tmp_path)).collect()
    assert len(parts(tmp_path, "surplus-csv")) == 5
    assert [tuple(r) for r in found] == [("CORRUPTED_FILE", "Corrupted CSV structure: 10 record(s) with more cells than the header has.")]


def test_broken_bytes_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    in_tmp(monkeypatch, tmp_path)
    spark.range(50).select(F.col("id").alias("o_orderkey")).repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    found = sources.encoding_violations(spark, str(tmp_path)).collect()
    assert len(parts(tmp_path, "bytes-csv")) == 5
    assert [tuple(r) for r in found] == [("INVALID_ENCODING", 50, 10)]


def test_scores_and_first_findings_run_no_hypothesis_tests(spark, monkeypatch):
    from sparkgauge.plans import findings, profile, score

    def fail(*_):
        raise AssertionError("tests were run")

    monkeypatch.setattr(profile, "hypothesis_tests", fail)
    rows = spark.range(100).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("a"), F.when(F.col("id") % 3 == 0, F.col("id") * 2).alias("b"), F.when(F.col("id") % 5 > 0, "x").otherwise("y").alias("c"))
    told = profile.profile_table(rows)
    assert score.quality_score(score.score_facts(told)).first()["missing_cells"] == 116
    assert [r["rule_order"] for r in findings.findings(told, most=2).collect()] == [1, 1]


def test_value_facts_meet_by_counts(spark):
    from sparkgauge.operators.frequencies import numeric_value_facts

    rows = [(1, 0.5, None), (1, 0.5, None), (0, 2.5, None), (0, 2.5, None), (None, float("nan"), None), (1, 7.0, None)]
    df = spark.createDataFrame(rows, "a long, b double, c long")
    found = {r["column_name"]: tuple(r)[1:] for r in numeric_value_facts(df).collect()}
    assert found == {"a": (6, 1, 2, True, 1.0, "1", 3), "b": (6, 1, 3, False, 0.5, "0.5", 2), "c": (6, 6, 0, False, None, None, None)}
    plan = numeric_value_facts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "times" in plan


def test_fences_are_counted_in_batches(spark):
    from sparkgauge.operators.outliers import beyond_fences

    df = spark.createDataFrame([(float(x), None) for x in (1, 2, 3, 4, 100, -90)] + [(None, None), (float("nan"), None)], "a double, b double")
    frame = beyond_fences(df)
    assert [(r["column_name"], r["n"], r["below_count"], r["above_count"]) for r in frame.collect()] == [("a", 6, 1, 1)]
    assert "MapInArrow" in frame._jdf.queryExecution().optimizedPlan().toString()
    assert beyond_fences(df.select("b")).collect() == []
