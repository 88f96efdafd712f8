"""Column and table aggregates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from gaugechecks.tables import (
    CHARGED, DIRTY, DIRTY_COLUMNS, DIRTY_NUMBERS, DIRTY_TEXTS, LINE_NUMBERS, SPECIAL,
    charged, dirty, long_sql, quartiles_sql, rounded, special, table,
)
from sparkgauge.operators import charts, correlation, counts, duplicates, frequencies, grouped, moments, outliers, quantiles
from sparkgauge.plans import validation
from sparkgauge.plans.profile import numeric_profile

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


LINES = long_sql("lineitem", LINE_NUMBERS)
QUARTILES = quartiles_sql("lineitem", LINE_NUMBERS)


@register("row_count", "SELECT count(*) AS row_count, 11 AS column_count FROM lineitem")
def row_count(spark, sf):
    return counts.row_count(table(spark, sf, "lineitem"))


@register("null_counts", f"""WITH {DIRTY}, l AS ({long_sql('dirty', DIRTY_COLUMNS, 'VARCHAR')})
SELECT column_name, count(*) AS row_count, count(*) - count(value) AS null_count,
round((count(*) - count(value)) * 100.0 / count(*), 6) AS null_percentage FROM l GROUP BY column_name""")
def null_counts(spark, sf):
    return rounded(counts.null_counts(dirty(spark, sf)), 6, "null_percentage")


@register("duplicate_count", f"""WITH {DIRTY}, d AS (SELECT DISTINCT * FROM dirty), n AS (SELECT (SELECT count(*) FROM dirty) AS a, (SELECT count(*) FROM d) AS b)
SELECT a AS row_count, a - b AS duplicate_count, round((a - b) * 100.0 / a, 1) AS duplicate_percentage FROM n""")
def duplicate_count(spark, sf):
    return duplicates.duplicate_count(dirty(spark, sf)).drop("duplicate_share")


@register("distinct_counts", f"""WITH {DIRTY}, l AS ({long_sql('dirty', DIRTY_COLUMNS, 'VARCHAR')})
SELECT column_name, count(*) AS row_count, count(DISTINCT value) AS distinct_count FROM l GROUP BY column_name""")
def distinct_counts(spark, sf):
    return frequencies.distinct_counts(dirty(spark, sf))


@register("unique_ratio", """WITH l AS (SELECT 'o_custkey' AS column_name, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT 'o_orderkey', CAST(o_orderkey AS VARCHAR) FROM orders
UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM orders
UNION ALL SELECT 'o_orderdate', CAST(o_orderdate AS VARCHAR) FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)
SELECT column_name, count(DISTINCT value) AS distinct_count, count(*) AS row_count, round(count(DISTINCT value) * 100.0 / count(*), 1) AS unique_percentage FROM l GROUP BY column_name""")
def unique_ratio(spark, sf):
    return frequencies.unique_ratio(table(spark, sf, "orders")).drop("unique_ratio")


@register("distinct_long_text", "SELECT 'text' AS column_name, count(*) AS row_count, count(DISTINCT text) AS distinct_count FROM documents")
def distinct_long_text(spark, sf):
    return frequencies.distinct_counts(table(spark, sf, "documents"), ["text"])


@register("empty_columns", f"""WITH {DIRTY}, l AS ({long_sql('dirty', DIRTY_COLUMNS, 'VARCHAR')})
SELECT column_name FROM l GROUP BY column_name HAVING count(value) = 0""")
def empty_columns(spark, sf):
    return counts.empty_columns(dirty(spark, sf))


@register("constant_columns", f"""WITH {DIRTY}, l AS ({long_sql('dirty', DIRTY_COLUMNS, 'VARCHAR')})
SELECT column_name, min(value) AS constant_value FROM l GROUP BY column_name HAVING count(DISTINCT value) = 1""")
def constant_columns(spark, sf):
    return counts.constant_columns(dirty(spark, sf))


NOT_EMPTY = f"""WITH {DIRTY}, l AS ({long_sql('dirty', DIRTY_COLUMNS, 'VARCHAR')})
SELECT column_name, min(value) AS constant_value FROM l GROUP BY column_name HAVING count(DISTINCT value) = 1 AND count(value) > 0"""


@register("constant_not_empty", NOT_EMPTY)
def constant_not_empty(spark, sf):
    return counts.constant_not_empty(dirty(spark, sf))


@register("except_columns", f"""WITH {DIRTY}, l AS ({long_sql('dirty', DIRTY_COLUMNS, 'VARCHAR')})
SELECT column_name FROM (SELECT column_name FROM l GROUP BY column_name HAVING count(DISTINCT value) <= 1) EXCEPT
SELECT column_name FROM (SELECT column_name FROM l GROUP BY column_name HAVING count(value) = 0)""")
def except_columns(spark, sf):
    d = dirty(spark, sf)
    flat = counts.constant_columns(d).select("column_name").unionByName(counts.empty_columns(d))
    return flat.exceptAll(counts.empty_columns(d))


@register("mean_std_var", f"""WITH l AS ({LINES}) SELECT column_name, count(value) AS n, round(avg(value), 4) AS mean,
round(stddev_samp(value), 4) AS std, round(var_samp(value), 2) AS variance FROM l GROUP BY column_name""")
def mean_std_var(spark, sf):
    m = moments.column_moments(table(spark, sf, "lineitem"))
    return rounded(rounded(m.select("column_name", "n", "mean", "std", "variance"), 4, "mean", "std"), 2, "variance")


@register("min_max", f"WITH l AS ({LINES}) SELECT column_name, min(value) AS min, max(value) AS max FROM l GROUP BY column_name")
def min_max(spark, sf):
    return moments.column_moments(table(spark, sf, "lineitem")).select("column_name", "min", "max")


@register("median", f"WITH q AS ({QUARTILES}) SELECT column_name, round(q2, 4) AS p50 FROM q")
def median(spark, sf):
    return rounded(quantiles.percentiles(table(spark, sf, "lineitem"), None, (0.5,)), 4, "p50")


PART_MODES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value, count(*) AS n FROM part GROUP BY {c}" for c in ("p_partkey", "p_size", "p_retailprice")
)


@register("mode", f"""WITH f AS ({PART_MODES}), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rn FROM f)
SELECT column_name, value AS mode, n AS mode_count FROM r WHERE rn = 1""")
def mode(spark, sf):
    return frequencies.numeric_modes(table(spark, sf, "part")).drop("mode_text")


TYPED_MODES = {"big": "CAST(l_suppkey + 9007199254740993 AS BIGINT)", "money": "CAST(l_linenumber + 90071992547409.01 AS DECIMAL(20, 2))"}


@register("mode_typed", "WITH f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({e} AS DECIMAL(30, 2)) AS value, CAST({e} AS VARCHAR) AS mode_text, count(*) AS n FROM lineitem GROUP BY ALL" for c, e in TYPED_MODES.items())
          + """), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rn FROM f) SELECT column_name, mode_text, n AS mode_count FROM r WHERE rn = 1""")
def mode_typed(spark, sf):
    return frequencies.numeric_modes(table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in TYPED_MODES.items()])).drop("mode")


@register("skewness", f"""WITH l AS ({LINES}), m AS (SELECT column_name, value, avg(value) OVER (PARTITION BY column_name) AS mu FROM l)
SELECT column_name, round(avg(power(value - mu, 3)) / power(avg(power(value - mu, 2)), 1.5), 6) + 0.0 AS skewness FROM m GROUP BY column_name""")
def skewness(spark, sf):
    return rounded(moments.column_moments(table(spark, sf, "lineitem")).select("column_name", "skewness"), 6, "skewness")


@register("kurtosis", f"WITH l AS ({LINES}) SELECT column_name, round(kurtosis_pop(value), 6) + CAST(0 AS DOUBLE) AS kurtosis FROM l GROUP BY column_name")
def kurtosis(spark, sf):
    return rounded(moments.column_moments(table(spark, sf, "lineitem")).select("column_name", "kurtosis"), 6, "kurtosis")


@register("percentiles", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, " + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {p / 100}), 4) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM lineitem"
    for c in LINE_NUMBERS))
def percentiles(spark, sf):
    return rounded(quantiles.percentiles(table(spark, sf, "lineitem")), 4, "p5", "p25", "p50", "p75", "p95")


OUTLIERS = f"""WITH {DIRTY}, q AS ({quartiles_sql('dirty', DIRTY_NUMBERS)}), l AS ({long_sql('dirty', DIRTY_NUMBERS)})"""


@register("iqr_outliers", f"""{OUTLIERS} SELECT l.column_name, count(value) AS n, round(min(lo), 6) AS lower_bound, round(min(hi), 6) AS upper_bound,
count(*) FILTER (WHERE value < lo OR value > hi) AS outliers_count,
round(count(*) FILTER (WHERE value < lo OR value > hi) * 100.0 / count(value), 2) AS outliers_pct
FROM l JOIN q USING (column_name) GROUP BY l.column_name""")
def iqr_outliers(spark, sf):
    found = outliers.iqr_outliers(dirty(spark, sf))
    return rounded(found, 6, "lower_bound", "upper_bound").drop("q1", "q3", "outliers_share")


@register("bounds_join", f"""{OUTLIERS} SELECT l.column_name, count(*) FILTER (WHERE value < lo) AS below_count, count(*) FILTER (WHERE value > hi) AS above_count
FROM l JOIN q USING (column_name) GROUP BY l.column_name""")
def bounds_join(spark, sf):
    return outliers.beyond_fences(dirty(spark, sf)).select("column_name", "below_count", "above_count")


@register("outlier_filter", f"""WITH {DIRTY}, q AS ({quartiles_sql('dirty', ['price'])})
SELECT k, round(price, 4) AS price, flag, mixed, day FROM dirty, q WHERE price < lo OR price > hi""")
def outlier_filter(spark, sf):
    return rounded(outliers.outlier_rows(dirty(spark, sf), "price").select("k", "price", "flag", "mixed", "day"), 4, "price")


@register("infinite_counts", f"""WITH {SPECIAL} SELECT 'value' AS column_name, count(*) AS row_count,
count(*) FILTER (WHERE isinf(value)) AS infinity_count FROM special""")
def infinite_counts(spark, sf):
    return counts.infinite_counts(special(spark, sf))


@register("blank_string_counts", f"""WITH {DIRTY}, l AS ({long_sql('dirty', DIRTY_TEXTS, 'VARCHAR')})
SELECT column_name, count(*) AS row_count, count(*) FILTER (WHERE trim(value) = '') AS blank_count FROM l GROUP BY column_name""")
def blank_string_counts(spark, sf):
    return counts.blank_string_counts(dirty(spark, sf))


@register("avg_string_length", """SELECT 'text' AS column_name, round(avg(length(text)), 4) AS avg_length FROM documents
UNION ALL SELECT 'lang', round(avg(length(lang)), 4) FROM documents UNION ALL SELECT 'source', round(avg(length(source)), 4) FROM documents""")
def avg_string_length(spark, sf):
    return rounded(counts.avg_string_length(table(spark, sf, "documents")), 4, "avg_length")


TOP = """, f AS (SELECT column_name, value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY column_name, value),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rn FROM f)"""


@register("value_counts_topk", f"""WITH {DIRTY}, l AS ({long_sql('dirty', DIRTY_TEXTS, 'VARCHAR')}) {TOP}
SELECT column_name, CAST(rn AS INTEGER) AS rank, value, count, round(count * 100.0 / (SELECT count(*) FROM dirty), 2) AS percentage FROM r WHERE rn <= 10""")
def value_counts_topk(spark, sf):
    return frequencies.top_values(dirty(spark, sf))


PART_TEXTS = ("p_name", "p_brand", "p_type")


@register("topk_per_column", f"""WITH l AS ({long_sql('part', PART_TEXTS, 'VARCHAR')}) {TOP}
SELECT column_name, CAST(rn AS INTEGER) AS rank, value, count FROM r WHERE rn <= 5""")
def topk_per_column(spark, sf):
    return frequencies.top_values(table(spark, sf, "part"), PART_TEXTS, 5).drop("percentage")


@register("topk_long_text", """SELECT CAST(count AS BIGINT) AS count, count(*) AS texts FROM (SELECT text, count(*) AS count FROM documents GROUP BY text ORDER BY count DESC LIMIT 10) AS t GROUP BY count""")
def topk_long_text(spark, sf):
    top = frequencies.top_values(table(spark, sf, "documents"), ["text"])
    return top.groupBy("count").agg(F.count_distinct("value").alias("texts"))


@register("topk_text_values", """WITH c AS (SELECT text, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, text) AS rn FROM documents WHERE text IS NOT NULL GROUP BY text)
SELECT CAST(rn AS INTEGER) AS rank, sha256(text) AS text_sha256, count FROM c WHERE rn <= 40""")
def topk_text_values(spark, sf):
    """The texts themselves, most of which tie at one copy and are then in ascending order."""
    top = frequencies.top_values(table(spark, sf, "documents"), ["text"], 40)
    return top.select("rank", F.sha2("value", 256).alias("text_sha256"), "count")


@register("topk_many_values", f"""WITH l AS ({long_sql('lineitem', ('l_orderkey', 'l_extendedprice', 'l_partkey'), 'VARCHAR').replace('CAST(l_extendedprice AS VARCHAR)', 'CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)')}) {{TOP}}
SELECT column_name, CAST(rn AS INTEGER) AS rank, value, count FROM r WHERE rn <= 15""".replace("{TOP}", TOP))
def topk_many_values(spark, sf):
    """Columns with very many values, whose counts are near each other."""
    line = table(spark, sf, "lineitem")
    texts = line.select(F.col("l_orderkey").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string").alias("l_extendedprice"), F.col("l_partkey").cast("string"))
    return frequencies.top_values(texts, k=15).drop("percentage")


@register("all_null_table", f"""WITH {DIRTY}, l AS ({long_sql('dirty', DIRTY_COLUMNS, 'VARCHAR')})
SELECT (SELECT count(*) FROM dirty) AS row_count, count(value) AS present_cells, count(value) = 0 AS all_null FROM l""")
def all_null_table(spark, sf):
    return counts.all_null_table(dirty(spark, sf))


@register("duplicate_nested", """WITH d AS (SELECT DISTINCT l_shipdate, l_linenumber % 2 AS micro, l_quantity % 3 AS q, l_tax > 0.04 AS high, l_suppkey % 4 AS s FROM lineitem)
SELECT (SELECT count(*) FROM lineitem) AS row_count, (SELECT count(*) FROM lineitem) - count(*) AS duplicate_count FROM d""")
def duplicate_nested(spark, sf):
    """Rows equal at every depth: microseconds count, signs of zero, orders of entries and codes of NaN don't."""
    line, odd = table(spark, sf, "lineitem"), F.col("l_orderkey") % 2 == 1
    q, high = F.col("l_quantity") % 3, F.col("l_tax") > 0.04
    rows = line.select(
        F.struct(F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") % 2).alias("at"), F.when(high, F.lit(None)).otherwise(F.lit("x")).alias("none")).alias("nested"),
        F.array(F.when(odd, F.lit(-0.0)).otherwise(F.lit(0.0)), F.when(q > 0, q)).alias("numbers"),
        F.array(F.when(q == 0, F.lit(float("nan"))), F.lit(1.0)).alias("gaps"),
        F.when(odd, F.create_map(F.lit("a"), F.col("l_suppkey") % 4, F.lit("b"), F.lit(0).cast("long"))).otherwise(
            F.create_map(F.lit("b"), F.lit(0).cast("long"), F.lit("a"), F.col("l_suppkey") % 4)).alias("entries"),
    )
    return duplicates.duplicate_count(rows).select("row_count", "duplicate_count")


@register("drop_duplicates", f"""WITH {DIRTY} SELECT flag, const, count(*) AS n, count(qty) AS n_qty, round(sum(price), 2) AS price FROM (SELECT DISTINCT * FROM dirty) GROUP BY flag, const""")
def drop_duplicates(spark, sf):
    clean = duplicates.drop_duplicates(dirty(spark, sf))
    return clean.groupBy("flag", "const").agg(F.count(F.lit(1)).alias("n"), F.count("qty").alias("n_qty"), F.round(F.sum("price"), 2).alias("price"))


CORR_COLUMNS = (*LINE_NUMBERS, "charge")


def corr_pairs(source, columns=CORR_COLUMNS):
    return " UNION ALL ".join(
        f"SELECT {ix} AS pair_ix, '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {source}"
        for ix, (a, b) in enumerate(correlation.column_pairs(columns))
    )


def measures(spark, sf):
    return charged(spark, sf).select(*CORR_COLUMNS)


MATRIX = f"""m AS (SELECT var1 AS x, var2 AS y, r FROM p UNION ALL SELECT var2, var1, r FROM p UNION ALL SELECT x, x, CAST(1 AS DOUBLE) FROM (VALUES {', '.join(f"('{c}')" for c in CORR_COLUMNS)}) AS v(x))"""


@register("correlation_matrix", f"WITH {CHARGED}, p AS ({corr_pairs('charged')}), {MATRIX} SELECT x, y, round(r, 3) + CAST(0 AS DOUBLE) AS r_pairwise FROM m")
def correlation_matrix(spark, sf):
    return correlation.correlation_matrix(measures(spark, sf))


@register("heatmap_long", f"WITH {CHARGED}, p AS ({corr_pairs('charged')}), {MATRIX} SELECT x, y, coalesce(round(r, 3), CAST(0 AS DOUBLE)) + CAST(0 AS DOUBLE) AS value FROM m")
def heatmap_long(spark, sf):
    return correlation.heatmap(correlation.correlation_matrix(measures(spark, sf)))


GAPPED = """g AS (SELECT CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS price, CASE WHEN l_suppkey % 9 <> 0 THEN l_extendedprice * (1 - l_discount) END AS net, l_quantity AS qty FROM lineitem),
filled AS (SELECT coalesce(price, (SELECT quantile_cont(price, 0.5) FROM g)) AS price, coalesce(net, (SELECT quantile_cont(net, 0.5) FROM g)) AS net, qty FROM g)"""


def gapped(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select(
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_suppkey") % 9 != 0, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.col("l_quantity").alias("qty"),
    )


@register("median_filled_pair", f"WITH {GAPPED}, p AS ({corr_pairs('filled', ('price', 'net', 'qty'))}) SELECT var1, var2, n, round(r, 6) + CAST(0 AS DOUBLE) AS r_filled FROM p")
def median_filled_pair(spark, sf):
    return rounded(correlation.correlated_pairs(gapped(spark, sf)).drop("pair_ix"), 6, "r_filled")


@register("strong_correlations", f"WITH {CHARGED}, p AS ({corr_pairs('charged')}) SELECT var1, var2, n, round(r, 3) AS coefficient, CAST(0 AS DOUBLE) AS p_value, true AS significant FROM p WHERE abs(r) >= 0.7")
def strong_correlations(spark, sf):
    return correlation.strong_correlations(measures(spark, sf)).drop("pair_ix")


@register("multicollinearity", f"WITH {CHARGED}, p AS ({corr_pairs('charged')}) SELECT var1 AS column_name, var2 AS correlated_with, round(r, 3) AS coefficient FROM p WHERE abs(r) >= 0.8")
def multicollinearity(spark, sf):
    return correlation.multicollinearity(measures(spark, sf)).drop("pair_ix")


@register("column_pairs", f"WITH {GAPPED}, p AS ({corr_pairs('g', ('price', 'net', 'qty'))}) SELECT pair_ix, var1, var2, n AS complete_rows FROM p")
def column_pairs(spark, sf):
    return correlation.pair_counts(gapped(spark, sf))


@register("crosstab", """SELECT 'l_returnflag' AS var1, 'l_linestatus' AS var2, l_returnflag AS value1, l_linestatus AS value2, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def crosstab(spark, sf):
    return grouped.crosstab(table(spark, sf, "lineitem"), [("l_returnflag", "l_linestatus")])


@register("margins", """WITH t AS (SELECT o_orderstatus AS value1, o_orderpriority AS value2, count(*) AS n FROM orders GROUP BY ALL)
SELECT 'o_orderstatus' AS var1, 'o_orderpriority' AS var2, value1, value2, n, CAST(sum(n) OVER (PARTITION BY value1) AS BIGINT) AS row_total,
CAST(sum(n) OVER (PARTITION BY value2) AS BIGINT) AS column_total, CAST(sum(n) OVER () AS BIGINT) AS total FROM t""")
def margins(spark, sf):
    return grouped.margins(grouped.crosstab(table(spark, sf, "orders"), [("o_orderstatus", "o_orderpriority")]))


@register("group_summaries", """WITH l AS (SELECT o_orderpriority AS category_value, 'o_orderkey' AS column_name, CAST(o_orderkey AS DOUBLE) AS v FROM orders UNION ALL
SELECT o_orderpriority, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders UNION ALL SELECT o_orderpriority, 'o_totalprice', o_totalprice FROM orders)
SELECT 'o_orderpriority' AS category, category_value, column_name, count(v) AS n, round(avg(v), 4) AS mean, round(var_samp(v), 2) AS variance FROM l GROUP BY category_value, column_name""")
def group_summaries(spark, sf):
    found = grouped.group_summaries(table(spark, sf, "orders"), ["o_orderpriority"])
    return rounded(rounded(found, 4, "mean"), 2, "variance")


#: Twenty few-valued columns of lineitem, some with gaps: name to remainder of a sum, which both engines read.
CODED = {f"c{i}": (f"l_partkey + {i} * l_suppkey + {i % 3} * l_linenumber", 2 + i % 9) for i in range(18)}
_CODED_COLUMNS = ", ".join(f"CASE WHEN l_linenumber <> {i % 11} THEN CAST(({e}) % {m} AS {{text}}) END AS {c}" for i, (c, (e, m)) in enumerate(CODED.items()))
CODED_COLUMNS = ("l_returnflag", "l_linestatus", *CODED)
CODED_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")
CODED_SQL = f"coded AS (SELECT l_returnflag, l_linestatus, {', '.join(CODED_NUMBERS)}, {_CODED_COLUMNS.format(text='VARCHAR')} FROM lineitem)"


def coded(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_returnflag", "l_linestatus", *CODED_NUMBERS, *_CODED_COLUMNS.format(text="STRING").split(", "))


@register("crosstab_wide", f"WITH {CODED_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, {a} AS value1, {b} AS value2, count(*) AS n FROM coded WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL"
    for a, b in combinations(CODED_COLUMNS, 2)))
def crosstab_wide(spark, sf):
    """All pairs of twenty columns, in one scan."""
    return grouped.crosstab(coded(spark, sf), grouped.category_pairs(CODED_COLUMNS))


@register("group_summaries_wide", f"WITH {CODED_SQL}, l AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS category, {c} AS category_value, '{x}' AS column_name, {x} AS v FROM coded" for c in CODED_COLUMNS for x in CODED_NUMBERS) + """)
SELECT category, category_value, column_name, count(v) AS n, round(avg(v), 4) AS mean, round(var_samp(v), 4) AS variance FROM l WHERE category_value IS NOT NULL GROUP BY ALL""")
def group_summaries_wide(spark, sf):
    """Three numeric columns in the groups of twenty category columns, in one scan."""
    return rounded(grouped.group_summaries(coded(spark, sf), CODED_COLUMNS, CODED_NUMBERS), 4, "mean", "variance")


HISTOGRAM = """WITH b AS (SELECT {c} AS v FROM {t} WHERE {c} IS NOT NULL AND isfinite({c})),
e AS (SELECT min(v) AS lo, max(v) AS hi, CAST(greatest(1, least(least(15, greatest(5, floor(sqrt(count(*))))), count(DISTINCT v))) AS INTEGER) AS bins FROM b),
s AS (SELECT i AS bin, CASE WHEN i = 0 THEN lo ELSE lo + i * ((hi - lo) / bins) END AS lower, CASE WHEN i + 1 = bins THEN hi ELSE lo + (i + 1) * ((hi - lo) / bins) END AS upper, bins
  FROM e, range(15) AS r(i) WHERE i < bins)
SELECT '{c}' AS column_name, CAST(bin AS INTEGER) AS bin, round(lower, 4) AS lower, round(upper, 4) AS upper,
CAST(CAST(round(lower, 1) AS DECIMAL(18, 1)) AS VARCHAR) || ' - ' || CAST(CAST(round(upper, 1) AS DECIMAL(18, 1)) AS VARCHAR) AS label, count(v) AS count
FROM s LEFT JOIN b ON v >= lower AND (v < upper OR (bin = bins - 1 AND v <= upper)) GROUP BY bin, lower, upper"""


@register("histogram", HISTOGRAM.format(c="o_totalprice", t="orders") + " UNION ALL (" + HISTOGRAM.format(c="o_custkey", t="(SELECT CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders)") + ")")
def histogram(spark, sf):
    return rounded(charts.histogram(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"]), 4, "lower", "upper")


@register("histogram_discrete", HISTOGRAM.format(c="l_discount", t="lineitem"))
def histogram_discrete(spark, sf):
    return rounded(charts.histogram(table(spark, sf, "lineitem"), ["l_discount"]), 4, "lower", "upper")


@register("time_bucket_mean", "SELECT strftime(o_orderdate, '%Y-%m') AS date, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1")
def time_bucket_mean(spark, sf):
    return rounded(charts.time_bucket_mean(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"), 4, "value")


def event_buckets():
    labels = {
        "month": "strftime(ts, '%Y-%m')",
        "week": "strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d')",
        "day": "strftime(ts, '%Y-%m-%d')",
    }
    unit = "CASE WHEN days > 730 THEN 'month' WHEN days > 60 THEN 'week' ELSE 'day' END"
    label = "CASE unit " + " ".join(f"WHEN '{u}' THEN {text}" for u, text in labels.items()) + " END"
    return f"""WITH s AS (SELECT floor(epoch(max(ts) - min(ts)) / 86400) AS days FROM events), u AS (SELECT {unit} AS unit FROM s)
SELECT {label} AS date, round(avg(value), 4) AS value FROM events, u GROUP BY 1"""


@register("time_bucket_events", event_buckets())
def time_bucket_events(spark, sf):
    return rounded(charts.time_bucket_mean(table(spark, sf, "events"), "ts", "value"), 4, "value")


@register("sort_by_date", "SELECT strftime(ts, '%Y-%m-%d') AS date, round(value, 4) AS value FROM events WHERE value IS NOT NULL")
def sort_by_date(spark, sf):
    events = table(spark, sf, "events")
    return rounded(charts.time_bucket_mean(events, "ts", "value", raw_points=events.count()), 4, "value")


@register("bad_values", f"WITH {DIRTY} SELECT 'mixed' AS column_name, mixed AS value, count(*) AS n FROM dirty WHERE TRY_CAST(mixed AS DOUBLE) IS NULL AND mixed IS NOT NULL GROUP BY mixed")
def bad_values(spark, sf):
    return validation.bad_values(dirty(spark, sf), ["mixed"])


@register("scatter_sample", """SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem
ORDER BY md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), '42')), x, y LIMIT 300""")
def scatter_sample(spark, sf):
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return charts.scatter_sample(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", keys, points=300)


PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS n, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count,
round(avg({c}), 4) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std,
CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(kurtosis_pop({c}), 6) AS kurtosis, round(quantile_cont(CAST({c} AS DOUBLE), 0.05), 4) AS p5,
round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75, round(quantile_cont(CAST({c} AS DOUBLE), 0.95), 4) AS p95,
(SELECT CAST(arg_min(v, (-m, v)) AS DOUBLE) FROM (SELECT {c} AS v, count(*) AS m FROM lineitem GROUP BY {c})) AS mode,
count(*) FILTER (WHERE {c} < (SELECT lo FROM q WHERE column_name = '{c}') OR {c} > (SELECT hi FROM q WHERE column_name = '{c}')) AS outliers_count FROM lineitem"""
    for c in LINE_NUMBERS
)


@register("numeric_profile", f"WITH q AS ({QUARTILES}) {PROFILE_SQL}")
def numeric_profile_query(spark, sf):
    found = numeric_profile(table(spark, sf, "lineitem"))
    found = rounded(found, 4, "mean", "median", "std", "p5", "q25", "q75", "p95")
    return rounded(found, 6, "kurtosis").drop("variance", "skewness", "outliers_share", "outliers_pct")
