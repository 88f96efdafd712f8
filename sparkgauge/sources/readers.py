"""Tables in: CSV with missing-value markers, any other Spark source, headers and previews."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkgauge.functions.cells import col_of, to_number
from sparkgauge.operators.shape import column_list, nans_to_nulls
from sparkgauge.sources import splits

# Texts that stand for a missing value in a CSV cell.
NULL_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
#: Cells are quoted with ", and a quote inside one is doubled.
QUOTING = {"quote": '"', "escape": '"'}
BOOLEAN_TEXTS = ("True", "TRUE", "true", "False", "FALSE", "false")
PREVIEW_ROWS = 100


def raw_headers(spark: SparkSession, path: str, **options: str) -> list[str | None]:
    """The first record as it stands; Spark's header option would rename duplicate and blank names."""
    first = spark.read.options(**{"header": "false", "multiLine": "true", **QUOTING, **options}).csv(path).first()
    return list(first) if first is not None else []


def file_headers(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """(header, files): the different first records of all files; more than one row means that the files don't fit together.

    Records pass by in the order of their file; a task sends on those that begin another file, and no more.
    """
    rows = spark.read.options(**{"header": "false", "multiLine": "true", **QUOTING, **options}).csv(path)
    cells = F.array(*[col_of(c) for c in rows.columns])
    numbered = rows.select(F.col("_metadata.file_path").alias("file"), cells.alias("header"), F.monotonically_increasing_id().alias("nth"))
    first = numbered.mapInArrow(_first_of_files, numbered.schema).groupBy("file").agg(F.min_by("header", "nth").alias("header"))
    return first.groupBy("header").agg(F.count(F.lit(1)).alias("files"))


def _first_of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each stretch of rows of one file; names are in the first column."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files = batch.column(0).dictionary_encode()
        codes = files.indices.to_numpy()
        starts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()]
        if files.dictionary[int(codes[0])].as_py() == last:
            starts = starts[1:]
        last = files.dictionary[int(codes[-1])].as_py()
        if starts:
            yield batch.take(pa.array(starts, pa.int64()))


def corrupt_rows(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, multi_line: bool = True, **options: str) -> DataFrame:
    """(reason, record): records that don't fit the header, which a reader would shorten or shift.

    ``surplus_cells``: more cells than columns. ``open_quote``, only without
    ``multi_line``: a line with an odd number of quotes, which is part of a cell with a
    line break. Records with fewer cells are filled with nulls and no violation.
    ``columns`` names the columns of files without a header.
    """
    named = list(columns) if columns is not None else [f"c{i}" for i in range(len(raw_headers(spark, path, **options)))]
    given = {"header": "false" if columns is not None else "true", "multiLine": str(multi_line).lower(), **QUOTING, **options}
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(named) + 1)] + [T.StructField("_corrupt", T.StringType())])
    if multi_line and columns is None and not options and has_large_files(spark, path):
        parsed = F.from_csv("record", F.lit(_ddl(schema)), {"multiLine": "true", "columnNameOfCorruptRecord": "_corrupt", **QUOTING})
        rows = splits.records(spark, path).select(parsed.alias("r")).select("r.*")
    else:
        rows = spark.read.options(**given).option("columnNameOfCorruptRecord", "_corrupt").schema(schema).csv(path)
    cells = [F.coalesce(f"c{i}", F.lit("")) for i in range(len(named) + 1)]
    # With one column too many in the schema, a record that fits is "short"; one that isn't has surplus cells.
    surplus = rows.filter(F.col(f"c{len(named)}").isNotNull() | F.col("_corrupt").isNull())
    found = surplus.select(F.lit("surplus_cells").alias("reason"), F.coalesce("_corrupt", F.concat_ws(",", *cells)).alias("record"))
    if multi_line:
        return found
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return found.unionByName(lines.filter(quotes % 2 == 1).select(F.lit("open_quote").alias("reason"), F.col("value").alias("record")))


def _typed(df: DataFrame) -> DataFrame:
    """Text columns to bigint, double or boolean where every present value fits, by one aggregate."""
    checks = []
    for i, c in enumerate(df.columns):
        cell = col_of(c)
        checks += [
            F.count(cell).alias(f"n{i}"),
            F.count(F.when(cell.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(cell).try_cast("bigint"))).alias(f"l{i}"),
            F.count(to_number(cell)).alias(f"d{i}"),
            F.count_if(cell.isin(*BOOLEAN_TEXTS)).alias(f"b{i}"),
        ]
    seen = df.agg(*checks).first()
    chosen: list[Column] = []
    for i, c in enumerate(df.columns):
        cell, n = col_of(c), seen[f"n{i}"]
        if n and seen[f"l{i}"] == n:
            cell = F.trim(cell).try_cast("bigint")
        elif n and seen[f"d{i}"] == n:
            cell = to_number(cell)
        elif n and seen[f"b{i}"] == n:
            cell = F.lower(cell).cast("boolean")
        chosen.append(cell.alias(c))
    return df.select(*chosen)


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, null_values: Sequence[str] = NULL_VALUES,
    multi_line: bool = True, **options: str
) -> DataFrame:
    """A CSV with header. Missing-value markers become null before types are decided.

    Cells may hold doubled quotes and, with ``multi_line``, line breaks; files larger than a
    file split are then read by many tasks all the same (see ``splits``), unless there are
    other options. With a schema no pass over the data is needed to find the types.
    """
    reader = spark.read.options(**{"header": "true", "multiLine": str(multi_line).lower(), **QUOTING, **options})
    names = None
    if schema is not None:
        target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        names = [f.name for f in target.fields]
        reader = reader.schema(_texts(names))
    else:
        reader = reader.option("inferSchema", "false")
    if multi_line and not options and has_large_files(spark, path):
        rows = split_rows(spark, path, names or reader.csv(path).columns)
    else:
        rows = reader.csv(path)
    rows = _marked(rows, null_values)
    return _typed(rows) if schema is None else rows.select(*[col_of(f.name).try_cast(f.dataType).alias(f.name) for f in target.fields])


def _texts(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def has_large_files(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a file is larger than a file split; contents are not read."""
    limit = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    sizes = spark.read.format("binaryFile").load(path).select("length")
    return not sizes.filter(F.col("length") > limit).isEmpty()


def split_rows(spark: SparkSession, path: str | list[str], names: Sequence[str]) -> DataFrame:
    """All cells as texts, from records that many tasks of one file have put together."""
    schema = _texts([f"c{i}" for i in range(len(names))])
    cells = F.from_csv("record", F.lit(_ddl(schema)), {"multiLine": "true", **QUOTING})
    parsed = splits.records(spark, path).select(cells.alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def _marked(df: DataFrame, null_values: Sequence[str]) -> DataFrame:
    return df.select(*[F.when(~col_of(c).isin(*null_values), col_of(c)).alias(c) for c in df.columns])


def table_metadata(df: DataFrame) -> DataFrame:
    return column_list(df).select("column_ix", "column_name", "data_type")


def preview(df: DataFrame, order_by: Sequence[str] = (), rows: int = PREVIEW_ROWS) -> DataFrame:
    """First rows in key order with NaN as null, and the number of all rows beside them."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    clean = nans_to_nulls(df)
    first = clean.orderBy(*[col_of(c) for c in order_by]).limit(rows) if order_by else clean.limit(rows)
    return first.withColumn("total_rows", total)


class Source:
    """A plug-in source: any format Spark reads."""

    def __init__(self, spark: SparkSession, format: str, **options: str):
        self.spark, self.format, self.options = spark, format, options

    def read(self, path: str) -> DataFrame:
        return self.spark.read.format(self.format).options(**self.options).load(path)

    def validate(self, path: str) -> bool:
        """Whether the path exists and has a readable schema; data rows are not read."""
        from pyspark.errors import PySparkException

        try:
            return len(self.read(path).columns) > 0
        except PySparkException:
            return False

    def metadata(self, path: str) -> DataFrame:
        return table_metadata(self.read(path))


class CsvSource(Source):
    def __init__(self, spark: SparkSession, **options: str):
        super().__init__(spark, "csv", **options)

    def read(self, path: str) -> DataFrame:
        return read_csv(self.spark, path, **self.options)

    def validate(self, path: str) -> bool:
        """Whether files, bytes and records are as a CSV table's should be; all of them are read."""
        return self.violations(path).isEmpty()

    def violations(self, path: str) -> DataFrame:
        from sparkgauge.sources.files import csv_violations

        return csv_violations(self.spark, path)
