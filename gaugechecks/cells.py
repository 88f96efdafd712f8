"""Cell rewrites, casts, cleaning operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugechecks.tables import DIRTY, LINE_NUMBERS, SPECIAL, dirty, quartiles_sql, rounded, special, table
from sparkgauge.functions import cells
from sparkgauge.operators import cleaning, shape
from sparkgauge.plans.recommendations import as_operations, cleaning_recommendations, select_recommended_ops
from sparkgauge.plans.profile import profile_table

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


@register("select_by_type", f"SELECT {', '.join(LINE_NUMBERS)} FROM lineitem")
def select_by_type(spark, sf):
    return shape.select_by_type(table(spark, sf, "lineitem"), numeric=True)


@register("select_other_types", "SELECT l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem")
def select_other_types(spark, sf):
    return shape.select_by_type(table(spark, sf, "lineitem"), numeric=False).withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@register("nan_to_null", f"""WITH {SPECIAL} SELECT event_type, count(*) AS n, count(CASE WHEN NOT isnan(value) THEN 1 END) AS present,
max(CASE WHEN isfinite(value) THEN value END) AS highest FROM special GROUP BY event_type""")
def nan_to_null(spark, sf):
    clean = shape.nans_to_nulls(special(spark, sf))
    highest = F.max(cells.finite_or_null(F.col("value")))
    return clean.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("present"), highest.alias("highest"))


@register("inf_to_null", f"""WITH {SPECIAL} SELECT event_id, CASE WHEN isfinite(value) THEN value END AS value FROM special""")
def inf_to_null(spark, sf):
    return shape.infinities_to_nulls(shape.nans_to_nulls(special(spark, sf))).select("event_id", "value")


@register("finite_filter", f"WITH {SPECIAL} SELECT event_id, value FROM special WHERE isfinite(value)")
def finite_filter(spark, sf):
    return special(spark, sf).select("event_id", "value").filter(cells.finite_or_null(F.col("value")).isNotNull())


@register("drop_nulls", f"WITH {DIRTY} SELECT k, qty, price FROM dirty WHERE qty IS NOT NULL AND price IS NOT NULL")
def drop_nulls(spark, sf):
    return cleaning.drop_nulls(dirty(spark, sf).select("k", "qty", "price"), ["qty", "price"])


@register("drop_columns", f"WITH {DIRTY} SELECT k, qty, price, flag, mixed, day FROM dirty")
def drop_columns(spark, sf):
    return cleaning.drop_columns(dirty(spark, sf), ["const", "empty", "no_such_column"])


def imputed(value):
    return f"WITH {DIRTY} SELECT k, price, round(coalesce(qty, ({value})), 6) AS qty FROM dirty"


def impute(spark, sf, strategy, **more):
    filled = cleaning.impute(dirty(spark, sf).select("k", "price", "qty"), "qty", strategy, **more)
    return rounded(filled, 6, "qty")


@register("impute_mean", f"WITH {DIRTY} SELECT k, price, round(coalesce(qty, avg(qty) OVER ()), 6) AS qty FROM dirty")
def impute_mean(spark, sf):
    return impute(spark, sf, "mean")


@register("impute_median", imputed("SELECT quantile_cont(qty, 0.5) FROM dirty"))
def impute_median(spark, sf):
    return impute(spark, sf, "median")


@register("impute_mode", imputed("SELECT qty FROM dirty WHERE qty IS NOT NULL GROUP BY qty ORDER BY count(*) DESC, qty LIMIT 1"))
def impute_mode(spark, sf):
    return impute(spark, sf, "mode")


@register("impute_value", imputed("SELECT CAST(-1 AS DOUBLE)"))
def impute_value(spark, sf):
    return impute(spark, sf, "value", fill_value=-1.0)


@register("clip_outliers", f"""WITH {DIRTY}, q AS ({quartiles_sql('dirty', ['price'])})
SELECT k, round(least(greatest(price, lo), hi), 6) AS price FROM dirty, q""")
def clip_outliers(spark, sf):
    return rounded(cleaning.clip_outliers(dirty(spark, sf).select("k", "price"), "price"), 6, "price")


@register("cast_numeric", f"WITH {DIRTY} SELECT k, TRY_CAST(mixed AS DOUBLE) AS mixed FROM dirty")
def cast_numeric(spark, sf):
    return cleaning.cast_types(dirty(spark, sf).select("k", "mixed"), "mixed", "numeric")


@register("cast_categorical", f"WITH {DIRTY} SELECT CAST(k AS VARCHAR) AS k, flag FROM dirty")
def cast_categorical(spark, sf):
    return cleaning.cast_types(dirty(spark, sf).select("k", "flag"), "k", "categorical")


@register("cast_datetime", f"WITH {DIRTY} SELECT k, TRY_CAST(day AS TIMESTAMP) AS day, TRY_CAST(mixed AS TIMESTAMP) AS mixed FROM dirty")
def cast_datetime(spark, sf):
    d = dirty(spark, sf).select("k", "day", "mixed")
    cast = cleaning.cast_types(cleaning.cast_types(d, "day", "datetime"), "mixed", "datetime")
    return cast.select("k", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("day", "mixed")])


OPERATIONS = [
    {"type": "drop_duplicates", "column": None},
    {"type": "drop_columns", "column": "empty", "columns": ["empty", "const"]},
    {"type": "impute_missing", "column": "qty", "strategy": "median"},
    {"type": "handle_outliers", "column": "price"},
    {"type": "cast_types", "column": "mixed", "target_type": "numeric"},
    {"type": "impute_missing", "column": "mixed", "strategy": "mean"},
]


@register("apply_operations", f"""WITH {DIRTY}, u AS (SELECT DISTINCT * FROM dirty), q AS ({quartiles_sql('u', ['price'])})
SELECT k, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM u)) AS qty, round(least(greatest(price, lo), hi), 6) AS price, flag,
round(coalesce(TRY_CAST(mixed AS DOUBLE), (SELECT avg(TRY_CAST(mixed AS DOUBLE)) FROM u)), 6) AS mixed, day FROM u, q""")
def apply_operations(spark, sf):
    return rounded(cleaning.apply_operations(dirty(spark, sf), OPERATIONS), 6, "price", "mixed")


@register("select_recommended_ops", f"""WITH {DIRTY} SELECT type, "column", strategy FROM (VALUES ('drop_duplicates', NULL, NULL, (SELECT count(*) FROM dirty) > (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))),
('drop_columns', 'empty', NULL, (SELECT count(empty) FROM dirty) = 0), ('drop_columns', 'const', NULL, (SELECT count(DISTINCT const) FROM dirty) = 1),
('impute_missing', 'qty', 'median', (SELECT count(*) - count(qty) FROM dirty) > 0)) AS v(type, "column", strategy, fires) WHERE fires""")
def select_recommended_ops_query(spark, sf):
    recommended = cleaning_recommendations(profile_table(dirty(spark, sf)))
    ids = ["drop_duplicates", "drop_empty_empty", "drop_constant_const", "impute_qty"]
    return select_recommended_ops(recommended, ids).select("type", "column", "strategy")


@register("norm_text", "SELECT p_partkey, lower(trim(p_brand)) AS brand, lower(trim(p_type)) AS type FROM part")
def norm_text(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", cells.norm_text(F.col("p_brand")).alias("brand"), cells.norm_text(F.col("p_type")).alias("type"))


@register("is_boolean_set", """SELECT 'quality' AS column_name, count(DISTINCT quality) = 2 AND min(quality) = 0 AND max(quality) = 1 AS boolean_pair FROM labels UNION ALL
SELECT 'toxic', count(DISTINCT toxic) = 2 AND min(toxic) = 0 AND max(toxic) = 1 FROM labels UNION ALL
SELECT 'doc_id', count(DISTINCT doc_id) = 2 AND min(doc_id) = 0 AND max(doc_id) = 1 FROM labels""")
def is_boolean_set(spark, sf):
    long = shape.text_long(table(spark, sf, "labels"), ["doc_id", "quality", "toxic"])
    v = cells.norm_text(F.col("value"))
    ends = long.groupBy("column_name").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_distinct("value").alias("n"))
    return ends.select("column_name", ((F.col("n") == 2) & cells.in_boolean_set(F.col("lo"), F.col("hi"))).alias("boolean_pair"))


@register("has_letter_or_digit", r"""SELECT conv_id, turn, part, regexp_matches(part, '[\p{L}\p{N}]') AS readable FROM (
SELECT conv_id, turn, unnest(string_split(text, ' ')) AS part FROM conversations)""")
def has_letter_or_digit(spark, sf):
    words = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("part"))
    return words.withColumn("readable", cells.has_letter_or_digit(F.col("part")))


@register("blank_header", f"WITH {DIRTY} SELECT flag, mixed, count(*) AS n FROM dirty WHERE trim(flag) = '' OR lower(mixed) = 'nan' OR starts_with(mixed, 'Unnamed:') GROUP BY flag, mixed")
def blank_header(spark, sf):
    d = dirty(spark, sf)
    return d.filter(cells.is_blank_header(F.col("flag")) | cells.is_blank_header(F.col("mixed"))).groupBy("flag", "mixed").agg(F.count(F.lit(1)).alias("n"))


@register("name_contains_any", "SELECT p_partkey, regexp_matches(lower(p_name || ' ' || p_type), 'red|blue|steel|brass') AS hit FROM part")
def name_contains_any(spark, sf):
    text = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf, "part").select("p_partkey", cells.contains_any(text, ("red", "blue", "steel", "brass")).alias("hit"))


@register("long_name", "SELECT doc_id, length(text) > 100 AS too_long FROM documents")
def long_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cells.is_long_name(F.col("text")).alias("too_long"))


@register("percent_from_text", """SELECT l_orderkey, l_linenumber, CAST(CAST(l_discount * 100 AS INTEGER) AS DOUBLE) AS percent, l_quantity FROM lineitem""")
def percent_from_text(spark, sf):
    line = table(spark, sf, "lineitem")
    message = F.format_string("Order %d gives a discount (%d%%) on %s pieces (9.9%%).", "l_orderkey", F.round(F.col("l_discount") * 100).cast("int"), F.col("l_quantity"))
    return line.select("l_orderkey", "l_linenumber", cells.percent_from_text(message).alias("percent"), "l_quantity")


@register("report_filename", """SELECT o_orderkey, replace(replace(o_orderpriority, ' ', '_'), ',', '') || '_Technical_Report_' || strftime(o_orderdate, '%Y-%m-%d_%H-%M') || '.md' AS technical,
replace(replace(o_orderpriority, ' ', '_'), ',', '') || '_Report_' || strftime(o_orderdate, '%Y-%m-%d_%H-%M') || '.json' AS plain FROM orders""")
def report_filename(spark, sf):
    base, stamp = F.col("o_orderpriority"), F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", cells.report_filename(base, "technical", stamp, "markdown").alias("technical"),
        cells.report_filename(base, "technical", stamp, "json").alias("plain"),
    )


@register("is_datetime_text", f"""WITH {DIRTY} SELECT count(day) > 0 AND count(TRY_CAST(day AS TIMESTAMP)) = count(day) AS day,
count(TRY_CAST(mixed AS TIMESTAMP)) = count(mixed) AS mixed, false AS empty FROM dirty""")
def is_datetime_text(spark, sf):
    return dirty(spark, sf).agg(*[cells.is_datetime_text(F.col(c)).alias(c) for c in ("day", "mixed", "empty")])


@register("period_label", """SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
strftime(ts, '%Y-%m-%d') AS day FROM events""")
def period_label(spark, sf):
    return table(spark, sf, "events").select("event_id", *[cells.period_label(F.col("ts"), u).alias(u) for u in ("month", "week", "day")])


@register("day_span", "SELECT o_custkey, CAST(floor(epoch(max(o_orderdate) - min(o_orderdate)) / 86400) AS BIGINT) AS days FROM orders GROUP BY o_custkey")
def day_span(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(cells.day_span(F.col("o_orderdate")).alias("days"))


@register("rounding", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 0) AS r0, round(l_extendedprice / 7, 2) AS r2, round(l_extendedprice / 7, 4) AS r4 FROM lineitem")
def rounding(spark, sf):
    share = F.col("l_extendedprice") / 7
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(share, d).alias(f"r{d}") for d in (0, 2, 4)])


@register("sqrt_bins", "SELECT o_custkey, CAST(greatest(1, least(least(15, greatest(5, floor(sqrt(count(*))))), count(DISTINCT o_totalprice))) AS INTEGER) AS bins FROM orders GROUP BY o_custkey")
def sqrt_bins(spark, sf):
    groups = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_totalprice").alias("d"))
    return groups.select("o_custkey", cells.sqrt_bins(F.col("n"), F.col("d")).alias("bins"))


def recommended_operations(spark, sf):
    return as_operations(select_recommended_ops(cleaning_recommendations(profile_table(dirty(spark, sf)))))
