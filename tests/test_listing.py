"""Files listed by tasks against the file system, and violations of files, bytes and records."""
import json
import os

import pytest

from sparkgauge.sources import listing, readers, records


def write(path, data=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data, newline="")
    return path


def test_all_levels_empty_files_and_odd_names(spark, tmp_path, monkeypatch):
    names = ["a.csv", "empty.csv", "d/b c.csv", "d/e/%41.csv", "d/_k=1/x.csv", "ü/é.csv", *[f"many/{i}.csv" for i in range(150)], *[f"wide/{i}/y.csv" for i in range(30)]]
    for n in names:
        write(tmp_path / n, "" if "empty" in n else n)
    for n in ("_SUCCESS", ".hidden", "d/_temporary/z.csv", "x._COPYING_"):
        write(tmp_path / n, "z")
    monkeypatch.setattr(listing, "ROWS", 7)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        got = {r["path"]: r["length"] for r in listing.list_files(spark, path).collect()}
        assert got == {f"file:{tmp_path}/{n}": os.path.getsize(tmp_path / n) for n in names}
    assert [tuple(r) for r in listing.list_files(spark, str(tmp_path / "a.csv")).collect()] == [(f"file:{tmp_path}/a.csv", 5)]
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, str(tmp_path / "none"))
    (tmp_path / "bare").mkdir()
    assert listing.list_files(spark, str(tmp_path / "bare")).collect() == []


def test_violations_of_a_csv_source(spark, tmp_path):
    source = readers.CsvSource(spark)
    codes = lambda p: [r["code"] for r in source.violations(str(p)).collect()]
    good = write(tmp_path / "good.csv", 'a,b\n1,"x\ny"\n2\n')
    assert codes(good) == [] and source.validate(str(good))
    assert codes(write(tmp_path / "empty.csv")) == ["EMPTY_FILE"]
    assert codes(tmp_path / "none.csv") == ["CORRUPTED_FILE"]
    surplus = write(tmp_path / "surplus.csv", "a,b\n1,2,3\n4,5\n6,7,8\n")
    row = source.violations(str(surplus)).first()
    assert row["code"] == "CORRUPTED_FILE" and row["message"] == "Corrupted CSV structure: 2 record(s) with more cells than the header has."
    assert not source.validate(str(surplus)) and not source.validate(str(tmp_path / "none.csv"))
    (tmp_path / "bytes.csv").write_bytes(b"a,b\n\xc3\x28,1\n")
    assert codes(tmp_path / "bytes.csv") == ["INVALID_ENCODING"]


def test_surplus_cells_in_large_files(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n" + "".join(f'{i},"x\ny"\n' + (f"{i},2,3\n" if i % 9 == 0 else "") for i in range(300)))
    whole = sorted(r["record"] for r in readers.corrupt_rows(spark, str(path)).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert readers.has_large_files(spark, str(path))
        assert sorted(r["record"] for r in readers.corrupt_rows(spark, str(path)).collect()) == whole and len(whole) == 34
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", ["{0}", "```json\n{0}\n```", "```\n{0}\n```", "  ```JSON\n{0}```  ", "```json {0}```", "```{0}\n```", "{0}\n```"])
def test_fences(spark, text):
    body = json.dumps({"a": "`x` ``", "b": [1]})
    df = spark.createDataFrame([(text.replace("{0}", body),)], "t string")
    assert df.select(records.strip_fences(df["t"])).first()[0] == body
