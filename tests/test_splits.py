"""Files read by many tasks against Spark's reader of whole files."""
import csv
import io
import random

import pytest
from hypothesis import given, settings, strategies as st

from sparkgauge.sources import readers, splits


def text_of(rows, end="\r\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def random_rows(seed, n):
    rnd = random.Random(seed)
    cell = lambda: rnd.choice(["x", "é", "", "a,b", 'say ""', '"', "two\nlines", "\n", "\r\n", 'q"\n"q', "line\n" * 40, "12", " lead", 'mid"dle'])
    return [["id", "a", "b"], *[[str(i), cell(), cell()] for i in range(n)]]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end, seed", [("\n", 1), ("\r\n", 2), ("\n", 3)])
def test_equal_rows_by_several_tasks(spark, tmp_path, small_splits, end, seed):
    for part in range(2):
        (tmp_path / f"p{part}.csv").write_text(text_of(random_rows(seed + part, 200), end), newline="")
    path = str(tmp_path)
    whole = spark.read.options(header="true", multiLine="true", inferSchema="false", **readers.QUOTING).csv(path)
    assert whole.count() == 400
    assert readers.has_large_files(spark, path)
    parts = readers.split_rows(spark, path, ["id", "a", "b"])
    key = lambda r: tuple(x or "" for x in r)
    assert sorted(map(tuple, parts.collect()), key=key) == sorted(map(tuple, whole.collect()), key=key)
    assert splits._lines(spark, path).rdd.getNumPartitions() > 10
    typed = readers.read_csv(spark, path, null_values=())
    assert dict(typed.dtypes)["id"] == "bigint" and typed.count() == 400


def test_cell_longer_than_many_splits(spark, tmp_path, small_splits):
    rows = [["id", "a"], ["1", "x" * 100 + "\n" * 3000 + '"'], ["2", "y"], ["3", "line\n" * 500]]
    (tmp_path / "a.csv").write_text(text_of(rows, "\n"), newline="")
    got = readers.read_csv(spark, str(tmp_path), "id int, a string", null_values=())
    assert sorted(map(tuple, got.collect())) == [(1, rows[1][1]), (2, "y"), (3, rows[3][1])]


def test_header_over_several_splits_and_blank_lines(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('id,"a\n' + "h\n" * 600 + '"\n\n1,x\n\n\n2,y\n' + "3,z\n" * 300, newline="")
    got = readers.read_csv(spark, str(tmp_path), "id int, a string")
    assert got.count() == 302 and got.filter("a = 'z'").count() == 300


def test_small_files_stay_with_one_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a\n1,x\n")
    assert not readers.has_large_files(spark, str(tmp_path)) and readers.read_csv(spark, str(tmp_path)).count() == 1


def states(text):
    """The state at each line's start, by one pass over the characters."""
    out, is_open, at_start, i = [False], False, True, 0
    while i < len(text):
        c = text[i]
        if is_open and c == '"' and text[i + 1:i + 2] == '"':
            i += 1
        elif is_open and c == '"':
            is_open = False
        elif not is_open and at_start and c == '"':
            is_open = True
            i, at_start = i + 1, False
            continue
        if c == "\n":
            out.append(is_open)
        at_start = not is_open and c in ",\n"
        i += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a",\n', max_size=40))
def test_lines_follow_the_characters(text):
    now, got = False, [False]
    for line in text.split("\n")[:-1]:
        now = splits.ends_open(line, now)
        got.append(now)
    assert got == states(text)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), min_size=1, max_size=12))
def test_states_along_a_file(spark, ends):
    frame = spark.createDataFrame([("f", i * 10, a, b) for i, (a, b) in enumerate(ends)], "file string, start bigint, if_closed boolean, if_open boolean")
    state, want = False, []
    for i, (a, b) in enumerate(ends):
        want += [i * 10] if state else []
        state = b if state else a
    assert sorted(r["start"] for r in splits.open_starts(frame).collect()) == want
