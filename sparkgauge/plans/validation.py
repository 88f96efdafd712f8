"""Critical checks and quality warnings as violation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkgauge.functions.cells import LONG_NAME_LIMIT, col_of, has_letter_or_digit, is_blank_header, plain, to_number
from sparkgauge.operators.counts import all_null_table, extremes, infinite_counts, text_facts, validation_copy
from sparkgauge.operators.duplicates import duplicate_count
from sparkgauge.operators.frequencies import top_per_group, value_facts
from sparkgauge.operators.outliers import iqr_outliers
from sparkgauge.operators.shape import column_list, numeric_columns, string_columns, text_long
from sparkgauge.plans.reliability import reliability
from sparkgauge.plans.texts import RECOVERY, WARNING_EXPLANATIONS
from sparkgauge.session import at_once, pin, small_frame

MIXED_SHARE = 0.60
HIGH_MISSING = 90.0
HIGH_OUTLIERS = 15.0
OUTLIER_SAMPLE = 5
SMALL_ROWS = 5
BAD_SAMPLES = 5

CRITICAL_SCHEMA = "rule_order int, code string, message string, severity string, recoverable boolean, recovery string"
HEADER_SCHEMA = "position int, header string"


def header_frame(df_or_session, headers: Sequence[str | None]) -> DataFrame:
    spark = getattr(df_or_session, "sparkSession", df_or_session)
    return small_frame(spark, list(enumerate(headers)), HEADER_SCHEMA)


def blank_headers(headers: DataFrame) -> DataFrame:
    return headers.filter(is_blank_header(F.col("header")))


def duplicate_headers(headers: DataFrame) -> DataFrame:
    seen = headers.groupBy("header").agg(F.count(F.lit(1)).alias("times"))
    return seen.filter(F.col("times") > 1)


def unreadable_headers(headers: DataFrame) -> DataFrame:
    return headers.filter(~has_letter_or_digit(F.col("header")))


def long_names(headers: DataFrame, limit: int = LONG_NAME_LIMIT) -> DataFrame:
    return headers.filter(F.char_length("header") > limit)


def _joined(frame: DataFrame, quoted: bool = False) -> Column:
    """Names of a small header frame as one text."""
    shown = F.concat(F.lit("'"), "name", F.lit("'")) if quoted else F.col("name")
    names = F.sort_array(F.collect_list(F.struct("place", shown.alias("text")))).getField("text")
    return F.concat_ws(", ", names)


def critical_checks(df: DataFrame, raw_headers: Sequence[str | None] | None = None) -> DataFrame:
    """The first failed critical check, or no row."""
    headers = header_frame(df, raw_headers if raw_headers is not None else df.columns)
    size = headers.agg(F.count(F.lit(1)).alias("n"))
    blank = blank_headers(headers).agg(F.count(F.lit(1)).alias("n"))
    twice = duplicate_headers(headers).select(F.col("header").alias("place"), F.col("header").alias("name"))
    odd = unreadable_headers(headers).select(F.col("position").alias("place"), F.col("header").alias("name"))
    checks = [
        size.filter("n = 0").select(F.lit(1).alias("rule_order"), F.lit("NO_COLUMNS").alias("code"), F.lit("The uploaded dataset has no columns.").alias("message")),
        blank.filter("n > 0").select(F.lit(2).alias("rule_order"), F.lit("BLANK_HEADERS").alias("code"), F.lit("The dataset contains blank or unnamed column headers.").alias("message")),
        twice.agg(F.count(F.lit(1)).alias("n"), _joined(twice).alias("names")).filter("n > 0").select(
            F.lit(3).alias("rule_order"), F.lit("DUPLICATE_HEADERS").alias("code"),
            F.format_string("The dataset contains duplicate column headers: %s.", "names").alias("message"),
        ),
        odd.agg(F.count(F.lit(1)).alias("n"), _joined(odd, quoted=True).alias("names")).filter("n > 0").select(
            F.lit(4).alias("rule_order"), F.lit("INVALID_HEADER_CHARACTERS").alias("code"),
            F.format_string("The dataset contains column headers with no readable alphanumeric characters (emoji-only or symbol-only): %s.", "names").alias("message"),
        ),
    ]
    if df.columns:
        cells = all_null_table(df)
        checks += [
            cells.filter(F.coalesce("row_count", F.lit(0)) == 0).select(
                F.lit(5).alias("rule_order"), F.lit("EMPTY_DATASET").alias("code"),
                F.lit("The uploaded dataset contains column headers but no data rows.").alias("message"),
            ),
            cells.filter("all_null").select(
                F.lit(6).alias("rule_order"), F.lit("ALL_NULL_DATASET").alias("code"),
                F.lit("The uploaded dataset is entirely empty (all cells are null/NaN).").alias("message"),
            ),
        ]
    failed = checks[0]
    for check in checks[1:]:
        failed = failed.unionByName(check)
    first = failed.orderBy("rule_order").limit(1)
    return first.select("rule_order", "code", "message", F.lit("critical").alias("severity"), F.lit(True).alias("recoverable"), recovery(F.col("code")).alias("recovery"))


def recovery(code: Column) -> Column:
    """Advice per code by lookup in a fixed map."""
    entries = [F.lit(x) for pair in RECOVERY.items() for x in pair]
    fallback = F.lit("Review the dataset and re-upload after making the necessary corrections.")
    return F.coalesce(F.try_element_at(F.create_map(*entries), code), fallback)


def bad_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n): every distinct value of these string columns that is no number."""
    bad = text_long(df, columns).filter(F.col("value").isNotNull() & to_number(F.col("value")).isNull())
    return bad.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def mixed_type(df: DataFrame, facts: DataFrame | None = None, samples: int = BAD_SAMPLES) -> DataFrame:
    """String columns that are mostly numbers but not all, with the first ``samples`` distinct bad values.

    The counts cover all values; ``bad_values`` lists every one. The samples are ranked by value inside each column; Spark keeps that many per
    map task before the shuffle, so no task collects them all.
    """
    facts = facts if facts is not None else text_facts(df)
    share = F.col("numeric_count") / F.col("present")
    mixed = facts.filter((F.col("present") > 0) & (share >= MIXED_SHARE) & (F.col("numeric_count") < F.col("present")))
    names = [r["column_name"] for r in mixed.select("column_name").collect()]
    invalid = F.col("present") - F.col("numeric_count")
    rows = mixed.select(
        "column_name", F.round(share * 100, 2).alias("numeric_percentage"), (share * 100).alias("numeric_share"),
        invalid.alias("invalid_count"), F.round(invalid / F.col("present") * 100, 2).alias("invalid_percentage"),
    )
    if not names:
        return rows.withColumn("invalid_values", F.array().cast("array<string>"))
    first = top_per_group(bad_values(df, names), ["column_name"], [F.asc("value")], samples)
    shown = first.groupBy("column_name").agg(F.sort_array(F.collect_list("value")).alias("invalid_values"))
    return rows.join(shown, "column_name", "left")


WARNING_SCHEMA = (
    "rule_order int, column_ix int, code string, column_name string, severity string, message string, "
    "metric double, invalid_values array<string>, recovery string, explanation string, affected_columns array<string>, "
    "metadata map<string,string>, expected_type string, detected_type string, invalid_count bigint, invalid_percentage double"
)


def _details(**values: Column | str | float) -> Column:
    """Facts of a warning by name, as text."""
    entries = [x for k, v in values.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))]
    return F.create_map(*entries)


def _warn(frame: DataFrame, order: int, code: str, message: Column, metric: Column, **more: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    named = more.get("column_name", none)
    return frame.select(
        F.lit(order).alias("rule_order"),
        more.get("column_ix", F.lit(None).cast("int")).alias("column_ix"),
        F.lit(code).alias("code"),
        named.alias("column_name"),
        more.get("severity", F.lit("warning")).alias("severity"),
        message.alias("message"),
        metric.cast("double").alias("metric"),
        more.get("invalid_values", F.lit(None).cast("array<string>")).alias("invalid_values"),
        more.get("recovery", recovery(F.lit(code))).alias("recovery"),
        more.get("explanation", F.lit(WARNING_EXPLANATIONS.get(order)).cast("string")).alias("explanation"),
        F.when(named.isNotNull(), F.array(named)).alias("affected_columns"),
        more.get("metadata", F.lit(None).cast("map<string,string>")).alias("metadata"),
        more.get("expected_type", none).alias("expected_type"), more.get("detected_type", none).alias("detected_type"),
        more.get("invalid_count", F.lit(None)).cast("bigint").alias("invalid_count"),
        more.get("invalid_percentage", F.lit(None)).cast("double").alias("invalid_percentage"),
    )


def quality_warnings(df: DataFrame) -> DataFrame:
    """All quality warnings of a valid table, one row each, in rule and column order.

    Measures run on a copy where NaN and infinities are missing; infinities and
    blank strings themselves are counted on the table as it is.
    """
    copy = validation_copy(df)
    texts, numbers = string_columns(df), numeric_columns(df)
    facts_of, repeated, infinite, facts, fenced = at_once(
        lambda: pin(value_facts(copy).select("column_name", "row_count", "null_count", "distinct_count")),
        lambda: pin(duplicate_count(copy)),
        lambda: pin(infinite_counts(df)),
        lambda: pin(text_facts(df, texts)) if texts else None,
        lambda: pin(iqr_outliers(copy)) if numbers else None,
    )
    nulls = facts_of.withColumn("null_percentage", F.col("null_count") / F.col("row_count") * 100)
    head = facts_of.first()
    rows = head["row_count"] if head else 0
    if not rows:
        return small_frame(df.sparkSession, [], WARNING_SCHEMA)
    order = column_list(df).select("column_ix", "column_name")
    columns = F.broadcast(order)
    tier = reliability(small_frame(df.sparkSession, [(rows,)], "row_count bigint"))
    name, n = F.col("column_name"), F.lit(rows)
    place = {"column_ix": F.col("column_ix"), "column_name": name}
    share = lambda c: F.round(F.col(c) / n * 100, 2)
    level = _details(rows=n, reliability_level=F.col("level"), confidence=F.col("confidence"), can_infer=F.col("can_infer"),
                     can_model=F.col("can_model"), can_hypothesis_test=F.col("can_hypothesis_test"), can_visualize=F.col("can_visualize"),
                     warnings=F.array_join("warnings", " "), recommended_actions=F.array_join("recommended_actions", " "))
    parts = [
        _warn(tier.filter(F.col("row_count") < SMALL_ROWS), 1, "VERY_SMALL_DATASET",
              F.format_string("The dataset is very small, containing only %d row(s). Statistical reliability will be limited.", "row_count"), F.col("row_count"), explanation=F.col("explanation"), metadata=level),
        _warn(tier.filter("requires_caution"), 2, "LOW_STATISTICAL_RELIABILITY", F.col("explanation"), F.col("row_count"), severity=F.col("severity"), metadata=level),
        _warn(tier.filter(F.col("row_count") == 1), 3, "ONE_ROW_DATASET", F.lit("The dataset contains exactly one row of data."), F.col("row_count"), explanation=F.col("explanation"), metadata=level),
        _warn(tier.filter(F.lit(len(df.columns)) == 1), 4, "ONE_COLUMN_DATASET", F.lit("The dataset contains exactly one column of data."), F.lit(1), metadata=_details(columns=1)),
        _warn(order.filter(F.char_length(name) > LONG_NAME_LIMIT), 5, "LONG_COLUMN_NAME",
              F.format_string("Column name is excessively long (%d characters). Very long names can reduce readability and cause compatibility issues with downstream analytical tools.", F.char_length(name)),
              F.char_length(name), metadata=_details(length=F.char_length(name), threshold=LONG_NAME_LIMIT), **place),
    ]
    if rows > 1:
        parts.append(_warn(repeated.filter("duplicate_count > 0"), 6, "DUPLICATE_ROWS",
              F.format_string("The dataset contains %d duplicate row(s) (%s%% of records). Duplicate records can distort statistical estimates and model training.", "duplicate_count", plain(F.col("duplicate_percentage"), 1)),
              F.col("duplicate_count"), metadata=_details(duplicate_rows=F.col("duplicate_count"), duplicate_percentage=F.col("duplicate_percentage"), total_rows=n)))
    parts.append(_warn(infinite.filter("infinity_count > 0").join(columns, "column_name"), 7, "INFINITY_VALUES",
          F.format_string("Column '%s' contains %d infinite value(s). These values were treated as missing for validation metrics.", name, "infinity_count"), F.col("infinity_count"),
          metadata=_details(infinity_count=F.col("infinity_count"), total_rows=n, infinity_percentage=share("infinity_count")), **place))
    if facts is not None:
        parts.append(_warn(facts.filter("blank_count > 0").join(columns, "column_name"), 8, "EMPTY_STRING_VALUES",
              F.format_string("Column '%s' contains %d empty string value(s).", name, "blank_count"), F.col("blank_count"),
              metadata=_details(empty_string_count=F.col("blank_count"), total_rows=n, empty_string_percentage=share("blank_count")), **place))
    missing = nulls.join(columns, "column_name")
    empty, filled = missing.filter(F.col("null_count") == n), missing.filter(F.col("null_count") < n)
    parts.append(_warn(empty, 9, "CONSTANT_COLUMN",
          F.format_string("Column '%s' is entirely empty (all values are null), which means it has zero variance. Empty columns can be retained for descriptive review, but they add no analytical value and are generally not useful for predictive modeling.", name),
          F.col("null_count"), recovery=recovery(F.lit("EMPTY_COLUMN")), metadata=_details(missing_count=F.col("null_count"), missing_percentage=100.0), **place))
    parts.append(_warn(filled.filter(F.col("null_percentage") > HIGH_MISSING), 10, "HIGH_MISSINGNESS",
          F.format_string("Column '%s' has a very high missingness ratio (%s%% of values are missing).", name, plain(F.col("null_percentage"), 1)), F.round("null_percentage", 2),
          metadata=_details(missing_count=F.col("null_count"), missing_percentage=F.round("null_percentage", 2), threshold_percentage=HIGH_MISSING), **place))
    constants = [r["column_name"] for r in facts_of.filter("distinct_count = 1").select("column_name").collect()]
    single = extremes(copy, constants).join(columns, "column_name") if constants else nulls.limit(0).withColumn("value", F.lit("")).join(columns, "column_name")
    parts.append(_warn(single, 11, "CONSTANT_COLUMN",
          F.format_string("Column '%s' has a single constant value ('%s') across all records, which means it has zero variance. Constant columns are useful for descriptive analysis and data auditing, but they generally do not improve statistical inference or predictive modeling because they add no discriminative signal.", name, "value"),
          F.lit(1), metadata=_details(unique_non_null_values=1, constant_value=F.col("value")), **place))
    if fenced is not None:
        wild = fenced.filter((F.col("n") >= OUTLIER_SAMPLE) & (F.col("outliers_share") > HIGH_OUTLIERS)).join(columns, "column_name")
        parts.append(_warn(wild, 12, "HIGH_OUTLIERS",
              F.format_string("Column '%s' has a high percentage of statistical outliers (%s%% of non-null values lie outside the 1.5×IQR boundary).", name, plain(F.col("outliers_share"), 1)), F.col("outliers_pct"),
              metadata=_details(outlier_count=F.col("outliers_count"), outlier_percentage=F.round("outliers_share", 2), q1=F.col("q1"), q3=F.col("q3"),
                                iqr=F.col("q3") - F.col("q1"), lower_bound=F.col("lower_bound"), upper_bound=F.col("upper_bound")), **place))
    if facts is not None:
        mixed = mixed_type(df, facts).join(columns, "column_name")
        parts.append(_warn(mixed, 13, "MIXED_DATATYPE_COLUMN",
              F.format_string("Column '%s' appears to be predominantly numeric (%s%% of values coerce to a number) but contains %d non-numeric value(s) (%s%%). This is a quality warning, not a validation failure.",
                              name, plain(F.col("numeric_share"), 1), "invalid_count", plain(F.col("invalid_percentage"), 2)),
              F.col("invalid_count"), invalid_values=F.col("invalid_values"), invalid_count=F.col("invalid_count"), invalid_percentage=F.col("invalid_percentage"),
              expected_type=F.lit("numeric"), detected_type=F.lit("mixed (numeric + text)"),
              metadata=_details(numeric_percentage=F.col("numeric_percentage"), sample_invalid_values=F.array_join("invalid_values", ", ")), **place))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
