"""Rules over the profile: types, validation, scores, recommendations, findings, charts and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gaugechecks.cells import recommended_operations
from gaugechecks.statistics import ALL_TESTS, K2, ORDER_NUMBERS
from gaugechecks.tables import (
    CHARGED, DIRTY, DIRTY_COLUMNS, DIRTY_NUMBERS, LINE_NUMBERS, SPECIAL, charged, dirty, long_sql, quartiles_sql, rounded, special, table,
)
from sparkgauge.plans import catalog, findings as notes, reliability as tiers, report, validation
from sparkgauge.plans.profile import profile_table
from sparkgauge.plans.recommendations import cleaning_recommendations, model_targets
from sparkgauge.plans.score import quality_score, score_facts
from sparkgauge.plans.semantics import schema_profile
from sparkgauge.plans.texts import OPPORTUNITIES, RECOVERY, RISKS, SCORE_LEVELS, TARGET_MODELS, TIER_EXPLANATION, WARNING_EXPLANATIONS
from sparkgauge.session import scratch_path

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def shown(value: str, digits: int) -> str:
    """SQL for a rounded number as text without padding zeros."""
    text = f"CAST(CAST(round({value}, {digits}) AS DECIMAL(30, {digits})) AS VARCHAR)"
    return f"regexp_replace({text}, '(\\.\\d+?)0+$', '\\1')" if digits > 1 else text


TYPED = {
    "orders": (("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"), ("o_totalprice", "n"), ("o_orderdate", "t"), ("o_orderpriority", "s")),
    "part": (("p_partkey", "n"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "n"), ("p_retailprice", "n")),
    "customer": (("c_custkey", "n"), ("c_name", "s"), ("c_nationkey", "n"), ("c_acctbal", "n"), ("c_mktsegment", "s")),
    "documents": (("doc_id", "n"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "n")),
    "labels": (("doc_id", "n"), ("quality", "n"), ("toxic", "n")),
    "dirty": (("k", "n"), ("qty", "n"), ("price", "n"), ("flag", "s"), ("mixed", "s"), ("day", "s"), ("const", "s"), ("empty", "s")),
}


def types_sql(name: str) -> str:
    """One row per column of a table: its semantic type by the type rules."""
    parts = []
    for c, kind in TYPED[name]:
        if kind == "t":
            rule = "'datetime'"
        elif kind == "n":
            rule = f"CASE WHEN count(DISTINCT {c}) = 2 AND min({c}) = 0 AND max({c}) = 1 THEN 'boolean' ELSE 'numeric' END"
        else:
            rule = f"""CASE WHEN count({c}) > 0 AND count(TRY_CAST({c} AS TIMESTAMP)) = count({c}) THEN 'datetime'
WHEN count(DISTINCT {c}) = 2 AND min(lower({c})) || '/' || max(lower({c})) IN ('0/1', '0.0/1.0', 'false/true', 'f/t', 'no/yes', 'n/y') THEN 'boolean'
WHEN coalesce(avg(length({c})), 0) > 50 THEN 'text' WHEN count(DISTINCT {c}) * 1.0 / count(*) > 0.9 THEN 'identifier' ELSE 'categorical' END"""
        parts.append(
            f"SELECT '{name}' AS source, '{c}' AS column_name, {rule} AS semantic_type, count(DISTINCT {c}) AS unique_values, count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_percentage FROM {name}"
        )
    return " UNION ALL ".join(parts)


@register("semantic_type", f"WITH {DIRTY} {' UNION ALL '.join(types_sql(t) for t in TYPED)}")
def semantic_type(spark, sf):
    frames = []
    for name in TYPED:
        source = dirty(spark, sf) if name == "dirty" else table(spark, sf, name)
        frames.append(schema_profile(source).withColumn("source", F.lit(name)).drop("column_ix", "data_type"))
    return reduce(lambda a, b: a.unionByName(b), frames)


def tier_case(rows: str, values) -> str:
    a, b, c, d = values
    return f"CASE WHEN {rows} <= 1 THEN {a} WHEN {rows} <= 4 THEN {b} WHEN {rows} <= 29 THEN {c} ELSE {d} END"


LEVELS = ("'UNRELIABLE'", "'VERY_LIMITED'", "'LIMITED'", "'STANDARD'")


@register("reliability", f"""WITH g AS (SELECT user_id, event_type, count(*) AS row_count FROM events GROUP BY user_id, event_type)
SELECT user_id, event_type, row_count, {tier_case('row_count', LEVELS)} AS level, {tier_case('row_count', ("'none'", "'low'", "'medium'", "'high'"))} AS confidence,
{tier_case('row_count', ("'critical'", "'warning'", "'info'", "'info'"))} AS severity, row_count > 4 AS can_infer, row_count > 4 AS can_model, row_count > 4 AS can_hypothesis_test,
true AS can_visualize, row_count < 30 AS requires_caution, {tier_case('row_count', [quote(t) for t in TIER_EXPLANATION.values()])} AS explanation FROM g""")
def reliability(spark, sf):
    groups = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("row_count"))
    return tiers.reliability(groups).drop("warnings", "recommended_actions")


@register("critical_checks", f"""WITH {DIRTY} SELECT 6 AS rule_order, 'ALL_NULL_DATASET' AS code, 'The uploaded dataset is entirely empty (all cells are null/NaN).' AS message,
'critical' AS severity, true AS recoverable, {quote(RECOVERY['ALL_NULL_DATASET'])} AS recovery FROM dirty HAVING count(empty) = 0""")
def critical_checks(spark, sf):
    return validation.critical_checks(dirty(spark, sf).select("empty", F.col("empty").alias("blank")))


HEADERS = {"NO_COLUMNS": [], "BLANK_HEADERS": ["a", " ", "c"], "DUPLICATE_HEADERS": ["a", "b", "a"], "INVALID_HEADER_CHARACTERS": ["a", *["!" * i for i in range(1, 8)]]}


@register("critical_codes", f"""WITH n AS (SELECT count(*) AS n FROM orders), v(code, message) AS (VALUES ('NO_COLUMNS', 'The uploaded dataset has no columns.'),
('BLANK_HEADERS', 'The dataset contains blank or unnamed column headers.'), ('DUPLICATE_HEADERS', 'The dataset contains duplicate column headers: a.'),
('INVALID_HEADER_CHARACTERS', 'The dataset contains column headers with no readable alphanumeric characters (emoji-only or symbol-only): {", ".join("''" + "!" * i + "''" for i in range(1, 8))}.'),
('EMPTY_DATASET', 'The uploaded dataset contains column headers but no data rows.')) SELECT code, message, n AS row_count FROM v, n""")
def critical_codes(spark, sf):
    orders = table(spark, sf, "orders")
    found = [validation.critical_checks(orders, headers) for headers in HEADERS.values()] + [validation.critical_checks(orders.filter("o_orderkey is null"))]
    return reduce(lambda a, b: a.unionByName(b), found).select("code", "message").withColumn("row_count", F.lit(orders.count()))


BAD = "TRY_CAST(mixed AS DOUBLE) IS NULL AND mixed IS NOT NULL"


@register("mixed_type", f"""WITH {DIRTY} SELECT 'mixed' AS column_name, round(count(TRY_CAST(mixed AS DOUBLE)) * 100.0 / count(mixed), 2) AS numeric_percentage,
count(*) FILTER (WHERE {BAD}) AS invalid_count, round(count(*) FILTER (WHERE {BAD}) * 100.0 / count(mixed), 2) AS invalid_percentage,
(SELECT array_to_string(list(mixed ORDER BY mixed), ',') FROM (SELECT DISTINCT mixed FROM dirty WHERE {BAD} ORDER BY mixed LIMIT 5)) AS invalid_values FROM dirty""")
def mixed_type(spark, sf):
    return validation.mixed_type(dirty(spark, sf)).drop("numeric_share").withColumn("invalid_values", F.concat_ws(",", "invalid_values"))


@register("quality_warnings", f"""WITH {DIRTY}, n AS (SELECT count(*) AS n, count(mixed) AS m, count(*) FILTER (WHERE {BAD}) AS bad, count(*) FILTER (WHERE trim(flag) = '') AS blank FROM dirty),
u AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM dirty))
SELECT 6 AS rule_order, 'DUPLICATE_ROWS' AS code, CAST(NULL AS VARCHAR) AS column_name, CAST(n.n - u.n AS DOUBLE) AS metric,
'The dataset contains ' || (n.n - u.n) || ' duplicate row(s) (' || {shown('(n.n - u.n) * 100.0 / n.n', 1)} || '% of records). Duplicate records can distort statistical estimates and model training.' AS message FROM n, u
UNION ALL SELECT 8, 'EMPTY_STRING_VALUES', 'flag', blank, 'Column ''flag'' contains ' || blank || ' empty string value(s).' FROM n
UNION ALL SELECT 9, 'CONSTANT_COLUMN', 'empty', n, 'Column ''empty'' is entirely empty (all values are null), which means it has zero variance. Empty columns can be retained for descriptive review, but they add no analytical value and are generally not useful for predictive modeling.' FROM n
UNION ALL SELECT 11, 'CONSTANT_COLUMN', 'const', 1, 'Column ''const'' has a single constant value (''' || (SELECT max(const) FROM dirty) || ''') across all records, which means it has zero variance. Constant columns are useful for descriptive analysis and data auditing, but they generally do not improve statistical inference or predictive modeling because they add no discriminative signal.' FROM n
UNION ALL SELECT 13, 'MIXED_DATATYPE_COLUMN', 'mixed', bad, 'Column ''mixed'' appears to be predominantly numeric (' || {shown('(m - bad) * 100.0 / m', 1)} || '% of values coerce to a number) but contains ' || bad || ' non-numeric value(s) (' || {shown('bad * 100.0 / m', 2)} || '%). This is a quality warning, not a validation failure.' FROM n""")
def quality_warnings(spark, sf):
    return validation.quality_warnings(dirty(spark, sf)).select("rule_order", "code", "column_name", "metric", "message")


@register("warning_details", f"""WITH {DIRTY}, n AS (SELECT count(*) AS n, count(mixed) AS m, count(*) FILTER (WHERE {BAD}) AS bad, count(*) FILTER (WHERE trim(flag) = '') AS blank, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS dup FROM dirty)
SELECT 6 AS rule_order, NULL AS affected, CAST(dup AS VARCHAR) AS fact, CAST(NULL AS BIGINT) AS invalid_count, CAST(NULL AS DOUBLE) AS invalid_percentage, NULL AS expected_type, {quote(WARNING_EXPLANATIONS[6])} AS explanation FROM n
UNION ALL SELECT 8, 'flag', CAST(blank AS VARCHAR), NULL, NULL, NULL, {quote(WARNING_EXPLANATIONS[8])} FROM n UNION ALL SELECT 9, 'empty', CAST(n AS VARCHAR), NULL, NULL, NULL, {quote(WARNING_EXPLANATIONS[9])} FROM n
UNION ALL SELECT 11, 'const', 'x', NULL, NULL, NULL, {quote(WARNING_EXPLANATIONS[11])} FROM n
UNION ALL SELECT 13, 'mixed', {shown('(m - bad) * 100.0 / m', 2)}, bad, round(bad * 100.0 / m, 2), 'numeric', {quote(WARNING_EXPLANATIONS[13])} FROM n""")
def warning_details(spark, sf):
    found = validation.quality_warnings(dirty(spark, sf))
    facts = ("duplicate_rows", "empty_string_count", "missing_count", "constant_value", "numeric_percentage")
    return found.select("rule_order", F.array_join("affected_columns", ",").alias("affected"), F.coalesce(*[F.col("metadata")[k] for k in facts]).alias("fact"),
                        "invalid_count", "invalid_percentage", "expected_type", "explanation")


@register("quality_warnings_special", f"""WITH {SPECIAL}, f AS (SELECT CASE WHEN isfinite(value) THEN value END AS v FROM special), q AS ({quartiles_sql('f', ['v'])}),
o AS (SELECT count(*) FILTER (WHERE v < lo OR v > hi) * 100.0 / count(v) AS pct FROM f, q)
SELECT 'INFINITY_VALUES' AS code, 'value' AS column_name, CAST(count(*) FILTER (WHERE isinf(value)) AS DOUBLE) AS metric FROM special UNION ALL SELECT 'HIGH_OUTLIERS', 'value', round(pct, 2) FROM o WHERE pct > 15""")
def quality_warnings_special(spark, sf):
    return validation.quality_warnings(special(spark, sf)).select("code", "column_name", "metric")


GROUPS = """facts AS (SELECT l_suppkey, count(*) AS row_count, 3 AS column_count, count(*) FILTER (WHERE l_linenumber = 3) AS missing_cells,
count(*) FILTER (WHERE l_partkey % 5 = 0) AS duplicate_count, count(*) FILTER (WHERE l_quantity > 40) AS total_outliers, CAST(l_suppkey % 4 AS INTEGER) AS e, CAST(l_suppkey % 5 AS INTEGER) AS c, l_suppkey % 7 AS collinear_pairs
FROM lineitem GROUP BY l_suppkey)"""


def score_sql(facts: str) -> str:
    """CTEs that turn a ``facts`` CTE (with e empty and c constant columns) into scores."""
    return f"""{facts}, sh AS (SELECT *, missing_cells * 100.0 / (row_count * column_count) AS mp, duplicate_count * 100.0 / row_count AS dp, total_outliers * 100.0 / row_count AS op FROM facts),
sc AS (SELECT *, greatest(10, CAST(trunc(100.0::DOUBLE - least(25, mp * 0.5) - CASE WHEN duplicate_count > 0 THEN least(15, 3 + dp * 0.5) ELSE 0 END - least(20, e * 8) - least(15, c * 4)
- CASE WHEN total_outliers > 0 THEN least(10, op * 0.2) ELSE 0 END - least(10, collinear_pairs * 2)) AS INTEGER)) AS raw FROM sh),
scores AS (SELECT *, CAST(least(raw, {tier_case('row_count', ('70', '75', '85', '100'))}) AS INTEGER) AS score,
CAST(greatest(10, 100 - (e * 8 + c * 4)) AS INTEGER) AS structure, CAST(trunc(greatest(10, 100 - (mp * 1.5 + dp))) AS INTEGER) AS completeness,
CAST(trunc(greatest(10, 100 - (op + collinear_pairs * 4))) AS INTEGER) AS consistency, {tier_case('row_count', ('40', '60', '85', '100'))} AS reliability, {tier_case('row_count', ('10', '30', '80', '100'))} AS readiness,
CASE WHEN raw >= 90 THEN {quote(SCORE_LEVELS[0][1])} WHEN raw >= 75 THEN {quote(SCORE_LEVELS[1][1])} WHEN raw >= 50 THEN {quote(SCORE_LEVELS[2][1])} ELSE {quote(SCORE_LEVELS[3][1])} END AS level_text FROM sc)"""


STATUS = "CASE WHEN score >= 80 THEN 'Ready for Analysis' WHEN score >= 60 THEN 'Needs Cleaning' ELSE 'Requires Significant Cleaning' END"


def group_scores(spark, sf):
    """Score facts per supplier, so that the score arithmetic meets many different values."""
    line = table(spark, sf, "lineitem")
    def names(n):
        return F.transform(F.slice(F.array(*[F.lit(i) for i in range(5)]), F.lit(1), n), lambda i: F.concat(F.lit("c"), i.cast("string")))

    key = F.col("l_suppkey")
    facts = line.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("l_linenumber") == 3).alias("missing_cells"),
        F.count_if(F.col("l_partkey") % 5 == 0).alias("duplicate_count"), F.count_if(F.col("l_quantity") > 40).alias("total_outliers"),
    )
    facts = facts.select(
        "*", F.lit(3).alias("column_count"), F.lit(0).alias("long_names"), names((key % 4).cast("int")).alias("empty_columns"),
        names((key % 5).cast("int")).alias("constant_columns"), (key % 7).alias("collinear_pairs"),
    )
    return quality_score(facts)


@register("score_groups", f"WITH {score_sql(GROUPS)} SELECT row_count, missing_cells, duplicate_count, score, structure, completeness, consistency, reliability, readiness FROM scores")
def score_groups(spark, sf):
    return group_scores(spark, sf).select("row_count", "missing_cells", "duplicate_count", "score", "structure", "completeness", "consistency", "reliability", "readiness")


@register("final_status", f"WITH {score_sql(GROUPS)} SELECT score, {STATUS} AS status, count(*) AS n FROM scores GROUP BY 1, 2")
def final_status(spark, sf):
    return group_scores(spark, sf).groupBy("score", "status").agg(F.count(F.lit(1)).alias("n"))


def table_facts(source: str, numbers, extra_columns: int, e: str, c: str) -> str:
    """The ``facts`` CTE of a whole table."""
    missing = " + ".join(f"(count(*) - count({x}))" for x in DIRTY_COLUMNS[: extra_columns])
    return f"""q AS ({quartiles_sql(source, numbers)}), ol AS (SELECT count(*) AS t FROM ({long_sql(source, numbers)}) AS l JOIN q USING (column_name) WHERE value < lo OR value > hi),
facts AS (SELECT count(*) AS row_count, {extra_columns} AS column_count, {missing} AS missing_cells, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS duplicate_count,
(SELECT t FROM ol) AS total_outliers, {e} AS e, {c} AS c, 0 AS collinear_pairs FROM {source})"""


DIRTY_FACTS = table_facts("dirty", DIRTY_NUMBERS, 8, "1", "1")


@register("quality_score", f"""WITH {DIRTY}, {score_sql(DIRTY_FACTS)} SELECT row_count, missing_cells, duplicate_count, round(mp, 4) AS missing_pct, round(dp, 4) AS duplicate_pct, round(op, 4) AS outlier_pct, score, level_text AS explanation,
round(greatest(0.1, score / 100.0), 2)::DOUBLE AS confidence,
'Deducted ' || {shown('least(25, mp * 0.5)', 1)} || ' points due to ' || {shown('mp', 1)} || '% total missingness in the dataset.|Deducted ' || {shown('least(15, 3 + dp * 0.5)', 1)} || ' points due to ' || duplicate_count || ' duplicate records (' || {shown('dp', 1)} || '%).|Deducted 8 points due to empty columns: empty.|Deducted 4 points due to constant columns offering zero variance: const.|Deducted ' || {shown('least(10, op * 0.2)', 1)} || ' points due to presence of ' || total_outliers || ' numerical outliers.' AS reasons FROM scores""")
def quality_score_query(spark, sf):
    scores = quality_score(score_facts(profile_table(dirty(spark, sf))))
    found = scores.select("row_count", "missing_cells", "duplicate_count", "missing_pct", "duplicate_pct", "outlier_pct", "score", "explanation", "confidence", F.concat_ws("|", "reasons").alias("reasons"))
    return rounded(found, 4, "missing_pct", "duplicate_pct", "outlier_pct")


@register("score_components", f"WITH {DIRTY}, {score_sql(DIRTY_FACTS)} SELECT score, structure, completeness, consistency, reliability, readiness, {STATUS} AS status FROM scores")
def score_components(spark, sf):
    scores = quality_score(score_facts(profile_table(dirty(spark, sf))))
    return scores.select("score", "structure", "completeness", "consistency", "reliability", "readiness", "status")


@register("executive_summary", f"""WITH {DIRTY}, {score_sql(DIRTY_FACTS)} SELECT score, 'The dataset contains ' || row_count || ' records and 8 attributes. A comprehensive data quality evaluation yielded a score of ' || score || '/100, indicating ' || lower(level_text)
|| ' A total of ' || missing_cells || ' cells are missing values. There are ' || duplicate_count || ' duplicate rows detected. ' AS summary FROM scores""")
def executive_summary(spark, sf):
    return notes.executive_summary(quality_score(score_facts(profile_table(dirty(spark, sf)))))


@register("cleaning_recommendations", f"""WITH {DIRTY}, q AS ({quartiles_sql('dirty', DIRTY_NUMBERS)}), o AS (SELECT column_name, count(*) FILTER (WHERE value < lo OR value > hi) AS n, count(*) FILTER (WHERE value < lo OR value > hi) * 100.0 / count(value) AS pct
FROM ({long_sql('dirty', DIRTY_NUMBERS)}) AS l JOIN q USING (column_name) GROUP BY column_name), m AS (SELECT count(*) - count(qty) AS gaps, count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS u FROM dirty)
SELECT 'drop_duplicates' AS id, 'drop_duplicates' AS type, CAST(NULL AS VARCHAR) AS "column", 'The dataset contains ' || (n - u) || ' duplicate rows.' AS issue, 'medium' AS severity, CAST(NULL AS VARCHAR) AS default_strategy FROM m
UNION ALL SELECT 'drop_empty_empty', 'drop_columns', 'empty', 'Column ''empty'' is entirely empty (100% missing).', 'high', NULL FROM m
UNION ALL SELECT 'drop_constant_const', 'drop_columns', 'const', 'Column ''const'' has a constant value across all records.', 'low', NULL FROM m
UNION ALL SELECT 'impute_qty', 'impute_missing', 'qty', 'Column ''qty'' has ' || gaps || ' missing values (' || {shown('gaps * 100.0 / n', 2)} || '%).', 'medium', 'median' FROM m
UNION ALL SELECT 'handle_outliers_' || column_name, 'handle_outliers', column_name, 'Column ''' || column_name || ''' has ' || n || ' outliers (' || {shown('pct', 2)} || '% of values).', CASE WHEN pct < 5 THEN 'low' ELSE 'medium' END, NULL FROM o WHERE n > 0""")
def cleaning_recommendations_query(spark, sf):
    found = cleaning_recommendations(profile_table(dirty(spark, sf)))
    return found.select("id", "type", "column", "issue", "severity", "default_strategy")


@register("model_targets", f"""WITH s AS ({types_sql('orders')}), t AS (SELECT column_name, CASE WHEN semantic_type = 'numeric' AND regexp_matches(column_name, 'price|cost|revenue|amount|total') THEN 'Regression'
WHEN semantic_type = 'categorical' AND (unique_values = 2 OR regexp_matches(column_name, 'is_|has_|status|category')) THEN 'Classification' END AS task FROM s)
SELECT column_name, task, CASE task WHEN 'Regression' THEN '{'|'.join(TARGET_MODELS['Regression'])}' ELSE '{'|'.join(TARGET_MODELS['Classification'])}' END AS models FROM t WHERE task IS NOT NULL""")
def model_targets_query(spark, sf):
    orders = table(spark, sf, "orders")
    rows = orders.agg(F.count(F.lit(1)).alias("row_count"))
    return model_targets(schema_profile(orders), rows).select("column_name", "task", F.concat_ws("|", "suggested_models").alias("models"))


@register("findings", f"""WITH {DIRTY}, l AS ({long_sql('dirty', DIRTY_NUMBERS)}), {K2}, g AS (SELECT count(*) AS n, count(*) - count(qty) AS a, count(*) - count(empty) AS b FROM dirty)
SELECT 1 AS rule_order, 'High missingness in ''qty'': ' || {shown('a * 100.0 / n', 1)} || '% of values are missing. This requires imputation or exclusion to avoid biased estimates.' AS finding FROM g WHERE a * 100.0 / n > 10
UNION ALL SELECT 1, 'High missingness in ''empty'': ' || {shown('b * 100.0 / n', 1)} || '% of values are missing. This requires imputation or exclusion to avoid biased estimates.' FROM g
UNION ALL SELECT 5, 'Non-normal distribution in ''' || z7.column_name || ''': The column shows a skewness of ' || {shown('g1', 2)} || ' and kurtosis of ' || {shown('b2 - 3', 2)} || ', deviating significantly from normality (p < 0.05).' FROM z7 JOIN k2 USING (column_name) WHERE exp(-statistic / 2) < 0.05""")
def findings(spark, sf):
    return notes.findings(profile_table(dirty(spark, sf))).filter("rule_order < 6").select("rule_order", "finding")


@register("findings_tests", f"""WITH {ALL_TESTS} SELECT 6 AS rule_order, 'Hypothesis Test Result (ANOVA): There are statistically significant differences between the group means of ''' || column_name || ''' across categories of ''' || category || ''' (p < 0.05).' AS finding FROM an WHERE p_value < 0.05
UNION ALL SELECT 6, 'Hypothesis Test Result (Chi-Square): There is a statistically significant association between ''o_orderstatus'' and ''o_orderpriority'' (p < 0.05).' FROM cp WHERE df1 = 8 AND p_value < 0.05""")
def findings_tests(spark, sf):
    return notes.findings(profile_table(table(spark, sf, "orders"))).filter("rule_order = 6").select("rule_order", "finding")


BANDS = """banded AS (SELECT o_totalprice, CASE WHEN o_totalprice < 150000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS band,
CASE WHEN o_totalprice < 200000 THEN 'no' ELSE 'yes' END AS large FROM orders)"""


def banded(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(price, F.when(price < 150000, "low").when(price < 300000, "mid").otherwise("high").alias("band"), F.when(price < 200000, "no").otherwise("yes").alias("large"))


@register("findings_significant", f"""WITH {BANDS}, m AS (SELECT avg(o_totalprice) AS m, count(*) AS n FROM banded),
g AS (SELECT band, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM banded GROUP BY band),
a AS (SELECT sum(g.n * power(g.m - m.m, 2)) / (count(*) - 1) / (sum((g.n - 1) * v) / (any_value(m.n) - count(*))) AS f FROM g, m),
w AS (SELECT abs(max(m) FILTER (WHERE large = 'yes') - max(m) FILTER (WHERE large = 'no')) / sqrt(sum(v / n)) AS t FROM (SELECT large, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM banded GROUP BY large)),
c AS (SELECT sum(o * o / (r * k)) * any_value(n) - any_value(n) AS chi FROM (SELECT CAST(o AS DOUBLE) AS o, CAST(sum(o) OVER (PARTITION BY band) AS DOUBLE) AS r, CAST(sum(o) OVER (PARTITION BY large) AS DOUBLE) AS k, CAST(sum(o) OVER () AS DOUBLE) AS n FROM (SELECT band, large, count(*) AS o FROM banded GROUP BY ALL)))
SELECT 6 AS rule_order, 'Hypothesis Test Result (T-Test): The mean of ''o_totalprice'' is significantly different between groups ''no'' and ''yes'' (p < 0.05).' AS finding FROM w WHERE t > 10
UNION ALL SELECT 6, 'Hypothesis Test Result (ANOVA): There are statistically significant differences between the group means of ''o_totalprice'' across categories of ''band'' (p < 0.05).' FROM a WHERE f > 10
UNION ALL SELECT 6, 'Hypothesis Test Result (Chi-Square): There is a statistically significant association between ''band'' and ''large'' (p < 0.05).' FROM c WHERE chi > 20""")
def findings_significant(spark, sf):
    """Each kind of test with a finding; statistics this far out have p < 0.05 at any size."""
    return notes.findings(profile_table(banded(spark, sf))).filter("rule_order = 6").select("rule_order", "finding")


@register("findings_first", f"""WITH {DIRTY}, g AS (SELECT count(*) AS n, count(*) - count(qty) AS a, count(*) - count(empty) AS b FROM dirty)
SELECT 1 AS place, 'High missingness in ''qty'': ' || {shown('a * 100.0 / n', 1)} || '% of values are missing. This requires imputation or exclusion to avoid biased estimates.' AS finding FROM g WHERE a * 100.0 / n > 10
UNION ALL SELECT 2, 'High missingness in ''empty'': ' || {shown('b * 100.0 / n', 1)} || '% of values are missing. This requires imputation or exclusion to avoid biased estimates.' FROM g""")
def findings_first(spark, sf):
    """The first two findings, as a caller who asks for two gets them."""
    return notes.findings(profile_table(dirty(spark, sf)), most=2).select(F.col("place").cast("int").alias("place"), "finding")


@register("model_features", f"SELECT column_name, semantic_type FROM ({types_sql('orders')}) WHERE semantic_type IN ('numeric', 'categorical')")
def model_features(spark, sf):
    from sparkgauge.plans.recommendations import model_features as features

    return features(schema_profile(table(spark, sf, "orders"))).select("column_name", "semantic_type")


@register("report_histograms", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, round(CAST(min({c}) AS DOUBLE), 4) AS low, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median,
round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q3, round(CAST(max({c}) AS DOUBLE), 4) AS high FROM orders""" for c in ORDER_NUMBERS))
def report_histograms(spark, sf):
    """Five points of each numeric column's distribution, read back from the JSON report."""
    text = report.json_report(profile_table(table(spark, sf, "orders")), "orders")
    parts = text.select(F.explode(F.from_json(F.get_json_object("value", "$.column_profiles"), "array<struct<column_name: string, histogram: array<double>>>")).alias("p"))
    point = lambda i: F.round(F.get("p.histogram", F.lit(i)), 4)
    return parts.filter(F.size("p.histogram") > 0).select("p.column_name", point(0).alias("low"), point(1).alias("q1"), point(2).alias("median"), point(3).alias("q3"), point(4).alias("high"))


@register("profile_states", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, round(avg({c}), 4) AS mean, round(var_samp({c}) / avg({c}) / avg({c}), 8) AS variance,
CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(skewness({c}) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6) AS skewness FROM orders""" for c in ORDER_NUMBERS))
def profile_states(spark, sf):
    """The numeric profile of a table merged from the stored states of three parts, one of which was written anew."""
    from sparkgauge.plans import states

    orders, path, part = table(spark, sf, "orders"), scratch_path(spark, "states"), F.col("o_custkey") % 3
    states.append_state(states.profile_state(orders.filter((part == 0) & (F.month("o_orderdate") < 7)), "0"), path)
    for i in range(3):
        states.append_state(states.profile_state(orders.filter(part == i), str(i)), path)
    found = states.merged_profile(states.current_states(spark, path)).filter(F.col("column_name").isin(*ORDER_NUMBERS))
    scaled = F.round(F.col("variance") / F.col("mean") / F.col("mean"), 8)
    return found.select("column_name", "row_count", "null_count", F.round("mean", 4).alias("mean"), scaled.alias("variance"), "min", "max", F.round("skewness", 6).alias("skewness"))


@register("merged_top_values", """SELECT 'l_returnflag' AS column_name, l_returnflag AS key, count(*) AS count, count(*) AS count_at_most FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), count(*) FROM lineitem GROUP BY l_linestatus""")
def merged_top_values(spark, sf):
    """Counts of values merged from the states of four parts."""
    from functools import reduce

    from sparkgauge.plans import states

    flags = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    parts = [states.profile_state(flags.filter(F.col("l_orderkey") % 4 == i), str(i)) for i in range(4)]
    return states.merged_top(reduce(lambda a, b: a.unionByName(b), parts)).drop("rank")


@register("write_observed", f"""WITH {DIRTY} SELECT count(*) AS rows, count(*) * 8 - {' - '.join(f'count({c})' for c in ('k', 'qty', 'price', 'flag', 'mixed', 'day', 'const', 'empty'))} AS missing_cells, CAST(0 AS BIGINT) AS empty_rows, (SELECT count(*) FROM dirty) AS read_again FROM dirty""")
def write_observed(spark, sf):
    """Numbers gathered while a table is written, and the rows it then has."""
    from sparkgauge.sources.sinks import write_observed as write

    path = scratch_path(spark, "observed")
    told = write(dirty(spark, sf), path)
    counts = [F.lit(told[c]).cast("bigint").alias(c) for c in ("rows", "missing_cells", "empty_rows")]
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("read_again")).select(*counts, "read_again")


@register("risks_opportunities", f"""WITH {ALL_TESTS}, hit AS (SELECT test_name FROM tests WHERE p_value < 0.05 AND test_type <> 'Normality Test' ORDER BY test_type, strpos(test_name, 'priority'), strpos('o_orderkey o_custkey o_totalprice', regexp_extract(test_name, 'vs (\\w+)', 1)) LIMIT 1)
SELECT 'risk' AS kind, {quote(RISKS['none'])} AS text FROM orders HAVING count(*) >= 30 UNION ALL SELECT 'opportunity', replace({quote(OPPORTUNITIES['associated'])}, '%s', test_name) FROM hit
UNION ALL SELECT 'opportunity', {quote(OPPORTUNITIES['numeric'])} FROM orders HAVING count(*) >= 30""")
def risks_opportunities(spark, sf):
    return notes.risks_opportunities(profile_table(table(spark, sf, "orders"))).select("kind", "text")


@register("chart_catalog", f"""WITH {CHARGED}, r AS (SELECT corr(l_extendedprice, charge) AS r FROM charged)
SELECT chart_type, x_axis, y_axis FROM (VALUES ('heatmap', NULL, NULL), {', '.join(f"('line', 'l_shipdate', '{c}'), ('histogram', '{c}', 'Frequency Count')" for c in (*LINE_NUMBERS, 'charge'))},
('bar', 'l_returnflag', 'Count'), ('bar', 'l_linestatus', 'Count')) AS v(chart_type, x_axis, y_axis) UNION ALL SELECT 'scatter', 'l_extendedprice', 'charge' FROM r WHERE r >= 0.7""")
def chart_catalog(spark, sf):
    from sparkgauge.operators.correlation import strong_correlations

    source = charged(spark, sf)
    return catalog.chart_catalog(schema_profile(source), strong_correlations(source)).select("chart_type", "x_axis", "y_axis")


@register("chart_series", """WITH months AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, avg(o_orderkey) AS a, avg(o_custkey) AS b, avg(o_totalprice) AS c FROM orders GROUP BY 1),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p FROM orders)
SELECT 'heatmap' AS chart_type, 9 AS points, CAST(NULL AS DOUBLE) AS total FROM n UNION ALL SELECT 'line', count(*) * 3, round(sum(a) + sum(b) + sum(c), 2) FROM months UNION ALL SELECT 'histogram', 45, n * 3 FROM n UNION ALL SELECT 'bar', s + p, n * 2 FROM n""")
def chart_series(spark, sf):
    orders = table(spark, sf, "orders")
    series = catalog.chart_series(orders, profile_table(orders)).groupBy("chart_type").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 2).alias("total"))
    return series.withColumn("total", F.when(F.col("chart_type") != "heatmap", F.col("total")))


CLEAN = f"""u AS (SELECT DISTINCT * FROM dirty), uq AS ({quartiles_sql('u', ['price'])}),
clean AS (SELECT k, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM u)) AS qty, least(greatest(price, lo), hi) AS price, flag, mixed, day FROM u, uq)"""
CLEAN_FACTS = table_facts("clean", DIRTY_NUMBERS, 6, "0", "0")


def measures_sql(facts: str, side: str) -> str:
    metrics = ("row_count", "column_count", "missing_cells", "duplicate_count", "score")
    inner = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS {side} FROM scores" for m in metrics)
    return f"{side} AS (WITH {score_sql(facts)} {inner})"


@register("before_after", f"WITH {DIRTY}, {CLEAN}, {measures_sql(DIRTY_FACTS, 'before')}, {measures_sql(CLEAN_FACTS, 'after')} SELECT metric, before, after FROM before JOIN after USING (metric)")
def before_after(spark, sf):
    operations = [
        {"type": "drop_duplicates", "column": None},
        {"type": "drop_columns", "column": "empty", "columns": ["empty"]},
        {"type": "drop_columns", "column": "const", "columns": ["const"]},
        {"type": "impute_missing", "column": "qty", "strategy": "median"},
        {"type": "handle_outliers", "column": "price"},
    ]
    return report.before_after(dirty(spark, sf), operations)


def number_line(c: str) -> str:
    return f"""'Mean: ' || {shown(f'avg({c})', 2)} || ' | Median: ' || {shown(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 2)} || ' | Std: ' || {shown(f'stddev_samp({c})', 2)} || ' | Min: ' || {shown(f'CAST(min({c}) AS DOUBLE)', 2)} || ' | Max: ' || {shown(f'CAST(max({c}) AS DOUBLE)', 2)}"""


def mode_line(c: str) -> str:
    return f"""(SELECT 'Mode: ''' || v || ''' (' || {shown('n * 100.0 / (SELECT count(*) FROM orders)', 2)} || '%)' FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, v LIMIT 1))"""


@register("column_profiles", f"""WITH s AS ({types_sql('orders')}), x AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, {number_line(c)} AS stats_summary FROM orders" for c in ORDER_NUMBERS)}
UNION ALL {' UNION ALL '.join(f"SELECT '{c}', {mode_line(c)}" for c in ('o_orderstatus', 'o_orderpriority'))} UNION ALL SELECT 'o_orderdate', 'N/A')
SELECT column_name, semantic_type, unique_values AS unique_count, null_count, stats_summary FROM s JOIN x USING (column_name)""")
def column_profiles(spark, sf):
    found = report.column_profiles(profile_table(table(spark, sf, "orders")))
    return found.select("column_name", "semantic_type", "unique_count", "null_count", "stats_summary")


@register("json_report", f"""WITH {DIRTY}, {score_sql(DIRTY_FACTS)} SELECT CAST(row_count AS VARCHAR) AS rows, CAST(score AS VARCHAR) AS score, 'empty' AS last_column, 'Ready' AS note, CAST(completeness AS VARCHAR) AS completeness FROM scores""")
def json_report(spark, sf):
    text = report.json_report(profile_table(dirty(spark, sf)), "dirty")

    def at(path):
        return F.get_json_object("value", path)

    return text.select(
        at("$.metadata.rows").alias("rows"), at("$.quality.score").alias("score"), at("$.column_profiles[7].column_name").alias("last_column"),
        F.when(at("$.methodology").isNotNull() & at("$.hypothesis_tests[0].test_name").isNotNull(), "Ready").alias("note"), at("$.quality.components.completeness").alias("completeness"),
    )
