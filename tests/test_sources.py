import json

import pytest
from pyspark.sql import functions as F

from sparkgauge.functions import cells
from sparkgauge.plans import report, validation
from sparkgauge.plans.profile import profile_table
from sparkgauge.sources import files, readers, records, sinks, store


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_csv_markers_types_and_headers(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,x,flag,s\n1,NA,True,a\n2,2.5,False,\n3,null,,NaN\n")
    df = readers.read_csv(spark, path)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "boolean", "string"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, None, True, "a"), (2, 2.5, False, None), (3, None, None, None)]
    kept = readers.read_csv(spark, path, null_values=("",))
    assert dict(kept.dtypes)["x"] == "string"
    typed = readers.read_csv(spark, path, "id int, x double, flag boolean, s string")
    assert dict(typed.dtypes)["id"] == "int" and typed.filter("x IS NULL").count() == 2


@pytest.mark.parametrize("line, code", [("a,a", "DUPLICATE_HEADERS"), ("a,,b", "BLANK_HEADERS"), ("a,!!!", "INVALID_HEADER_CHARACTERS"), ("a,b", None)])
def test_raw_headers_feed_the_checks(spark, tmp_path, line, code):
    path = write(tmp_path / "h.csv", f"{line}\n1,2,3\n")
    headers = readers.raw_headers(spark, path)
    assert [h or "" for h in headers] == line.split(",")
    row = validation.critical_checks(readers.read_csv(spark, path), headers).first()
    assert (row["code"] if row else None) == code


def test_encoding(spark, tmp_path):
    good = write(tmp_path / "good.csv", "a\nä\n")
    bad = write(tmp_path / "bad.csv", b"a\n\xc3\x28\nb\n")
    assert files.encoding_violations(spark, good).count() == 0
    row = files.encoding_violations(spark, bad).first()
    assert row["code"] == "INVALID_ENCODING" and row["path"].endswith("bad.csv")
    assert files.encoding_check(spark, bad).first()["invalid_lines"] == 1


def test_file_checks(spark, tmp_path):
    found = lambda path, **more: [r["code"] for r in files.file_checks(spark, path, **more).collect()]
    assert found(write(tmp_path / "ok.csv", "a\n1\n")) == []
    assert found(write(tmp_path / "empty.csv", "")) == ["EMPTY_FILE"]
    assert found(write(tmp_path / "a.xlsx", "x")) == ["UNSUPPORTED_FILE"]
    assert found(str(tmp_path / "missing.csv")) == ["CORRUPTED_FILE"]
    assert found(str(tmp_path / "ok.csv"), size_limit=1) == ["CORRUPTED_FILE"]


def test_connectors(spark, sf, tmp_path):
    source = readers.Source(spark, "parquet")
    assert source.validate(f"{sf}/nation.parquet") and not source.validate(str(tmp_path / "none"))
    assert [r["column_name"] for r in source.metadata(f"{sf}/nation.parquet").orderBy("column_ix").collect()][0] == "n_nationkey"
    csv = readers.CsvSource(spark)
    path = write(tmp_path / "a.csv", "a,b\n1,x\n")
    assert csv.validate(path) and csv.read(path).first()["a"] == 1


def test_preview(spark):
    df = spark.createDataFrame([(i, float("nan") if i == 0 else 1.0) for i in range(150)], "id int, x double")
    rows = readers.preview(df, ["id"]).collect()
    assert len(rows) == 100 and rows[0]["x"] is None and rows[0]["total_rows"] == 150


def test_store_and_history(spark, tmp_path):
    path = str(tmp_path / "runs")
    for ts, status in ((1, "processing"), (2, "completed")):
        store.append_runs(spark.createDataFrame([("d1", ts, status), ("d2", ts, status)], "dataset_id string, run_ts int, status string"), path)
    latest = store.latest_run(store.all_runs(spark, path))
    assert {(r["dataset_id"], r["status"]) for r in latest.collect()} == {("d1", "completed"), ("d2", "completed")}
    assert store.get_run(store.all_runs(spark, path), "d1").count() == 1
    history = str(tmp_path / "history")
    store.append_history(spark, history, "d1", [{"type": "impute_missing", "column": "x", "strategy": "value", "fill_value": 0}])
    store.append_history(spark, history, "d1", [{"type": "drop_columns", "column": "y", "columns": ["y"]}])
    ops = spark.read.parquet(history).orderBy("run_ts").select(F.inline("operations")).collect()
    assert [(o["type"], o["fill_value"], o["columns"]) for o in ops] == [("impute_missing", "0", None), ("drop_columns", None, ["y"])]


def test_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2]) for i in range(60)], "id int, total double, kind string")
    path = sinks.write_json_report(report.json_report(profile_table(df), "t.csv"), str(tmp_path / "report"))
    body = json.loads(spark.read.text(path, wholetext=True).first()[0])
    assert body["metadata"]["rows"] == 60 and body["metadata"]["filename"] == "t.csv"
    assert [c["column_name"] for c in body["column_profiles"]] == ["id", "total", "kind"]
    assert {t["test_type"] for t in body["hypothesis_tests"]} == {"T-Test", "Normality Test"}
    assert body["model_recommendations"][0]["task"] == "Regression"


FULL = {"title": "t", "summary": "s {x}", "key_takeaway": "k", "evidence": [{"label": "l", "value": 3}, "loose", {"source": "me"}], "limitations": "none"}


@pytest.mark.parametrize("raw, reason", [
    (json.dumps(FULL), None),
    ("```json\n" + json.dumps(FULL, indent=1) + "\n```", None),
    ("Sure! " + json.dumps(FULL) + " Bye {now}", None),
    (json.dumps({"title": "t"}), "missing_fields"),
    ("{ broken", "not_json"), ("no json", "not_json"), ("[1, 2]", "not_json"), ("  ", "empty"), (None, "empty"),
    (json.dumps(FULL | {"evidence": "text"}), None),
])
def test_response_records(spark, raw, reason):
    df = spark.createDataFrame([(raw,)], "raw string")
    row = records.response_records(df, "raw").first()
    assert row["reject_reason"] == reason
    if reason is None:
        assert (row["out_title"], row["out_summary"], row["out_limitations"]) == ("t", "s {x}", "none")
        expected = [] if '"evidence": "text"' in raw else [("l", "3", "Python Statistical Engine"), ("", "", "me")]
        assert [tuple(e) for e in row["out_evidence"]] == expected
    if reason == "missing_fields":
        assert row["missing_fields"] == ["summary", "key_takeaway", "evidence", "limitations"]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("Missing (12.5%) and (3%)", "My file, v2")], "m string, f string")
    row = df.select(
        cells.percent_from_text(F.col("m")).alias("p"), cells.plain(F.lit(15.3), 2).alias("a"), cells.plain(F.lit(3.0), 2).alias("b"),
        cells.report_filename(F.col("f"), "executive", F.timestamp_seconds(F.lit(0)), "html").alias("n"),
    ).first()
    assert (row["p"], row["a"], row["b"]) == (12.5, "15.3", "3.0")
    assert row["n"] == "My_file_v2_Executive_Report_1970-01-01_00-00.html"


def test_quotes_line_breaks_and_surplus_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,n\n"x ""y"", z",1\n"two\nlines",2\nplain,3\n')
    rows = readers.read_csv(spark, str(tmp_path / "a.csv")).orderBy("n").collect()
    assert [tuple(r) for r in rows] == [('x "y", z', 1), ("two\nlines", 2), ("plain", 3)]
    assert readers.corrupt_rows(spark, str(tmp_path / "a.csv")).count() == 0
    lines = readers.corrupt_rows(spark, str(tmp_path / "a.csv"), multi_line=False).filter("reason = 'open_quote'").collect()
    assert {r["record"] for r in lines} == {'"two', 'lines",2'}
    (tmp_path / "b.csv").write_text("a,b\n1,2\n3,4,5\n6\n7,8,\n")
    bad = readers.corrupt_rows(spark, str(tmp_path / "b.csv")).collect()
    assert {r["record"] for r in bad} == {"3,4,5", "7,8,"} and {r["reason"] for r in bad} == {"surplus_cells"}
    headers = readers.file_headers(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    assert sorted((r["header"][0], r["files"]) for r in headers) == [("a", 1), ("name", 1)]
