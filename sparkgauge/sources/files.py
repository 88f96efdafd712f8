"""Checks of the files behind a table."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkgauge.plans.validation import recovery
from sparkgauge.session import small_frame
from sparkgauge.sources.listing import list_files
from sparkgauge.sources.readers import corrupt_rows

EXTENSIONS = (".csv",)


def _violations(frame: DataFrame, order: int, code: str, message) -> DataFrame:
    return frame.select(
        "path", F.lit(order).alias("rule_order"), F.lit(code).alias("code"), message.alias("message"),
        F.lit("critical").alias("severity"), F.lit(True).alias("recoverable"), recovery(F.lit(code)).alias("recovery"),
    )


def _sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files, listed by tasks; by Spark's own listing, which leaves out empty files, for storage unknown to that."""
    try:
        return list_files(spark, path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        scanned = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return scanned.select(F.regexp_replace("path", r"^(\w+:)/+", "$1/").alias("path"), "length")


def file_checks(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS, size_limit: int | None = None) -> DataFrame:
    """One row per file and violation, from path and length alone; contents are not read."""
    files = None
    try:
        files = _sizes(spark, path)
    except (PySparkException, FileNotFoundError):
        pass
    if files is None:
        missing = small_frame(spark, [(path,)], "path string")
        return _violations(missing, 2, "CORRUPTED_FILE", F.format_string("File path does not exist: %s", "path")).withColumn("recoverable", F.lit(False))
    name = F.lower("path")
    known = F.lit(False)
    for extension in extensions:
        known = known | name.endswith(extension)
    result = _violations(files.filter(~known), 1, "UNSUPPORTED_FILE", F.lit("Unsupported file format. Please upload a CSV file.")).unionByName(
        _violations(files.filter(known & (F.col("length") == 0)), 3, "EMPTY_FILE", F.lit("The uploaded file is empty (0 bytes)."))
    )
    if size_limit is not None:
        result = result.unionByName(
            _violations(files.filter(F.col("length") > size_limit), 4, "CORRUPTED_FILE", F.lit("File size exceeds the limit for analysis."))
        )
    return result


def encoding_check(spark: SparkSession, path: str) -> DataFrame:
    """(path, lines, invalid_lines) per file.

    Lines keep their raw bytes in the text source, so files of any size are
    split over tasks and no file is loaded as one value.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return (
        lines.select(F.col("_metadata.file_path").alias("path"), F.is_valid_utf8(F.col("value")).alias("ok"))
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("ok")).alias("invalid_lines"))
    )


def encoding_violations(spark: SparkSession, path: str) -> DataFrame:
    message = F.lit("The file could not be read with the detected encoding. Please save the file with UTF-8 encoding and re-upload.")
    return _violations(encoding_check(spark, path).filter("invalid_lines > 0"), 5, "INVALID_ENCODING", message)


def record_violations(spark: SparkSession, path: str) -> DataFrame:
    """One row for each reason why records of the path don't fit its header."""
    found = corrupt_rows(spark, path).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).withColumn("path", F.lit(path))
    what = F.when(F.col("reason") == "surplus_cells", "more cells than the header has").otherwise("an open quote")
    return _violations(found, 6, "CORRUPTED_FILE", F.format_string("Corrupted CSV structure: %d record(s) with %s.", "n", what))


def csv_violations(spark: SparkSession, path: str, size_limit: int | None = None) -> DataFrame:
    """All critical violations of the files behind a CSV table: of the files themselves or, if there are none, of their bytes and records."""
    outer = file_checks(spark, path, size_limit=size_limit)
    if not outer.isEmpty():
        return outer
    return encoding_violations(spark, path).unionByName(record_violations(spark, path))
