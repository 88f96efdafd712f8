"""Hypothesis tests. Tails are repeated in SQL by closed forms or by Simpson's rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugechecks.tables import LINE_NUMBERS, long_sql, rounded, table
from sparkgauge.functions import tails
from sparkgauge.functions.normality import (
    LARGE_MEAN, LARGE_SCALE, LAST_WEIGHT, SECOND_WEIGHT, SMALL_BOUND, SMALL_MEAN, SMALL_SCALE,
)
from sparkgauge.operators import hypothesis

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def t_tail_sql(t: str, df: str) -> str:
    """Two-sided t tail: one minus twice Simpson's integral of the density up to |t|."""
    c = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi())"
    x = f"(abs({t}) * i / 4000.0)"
    weight = "CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"1 - 2 * {c} * abs({t}) / 12000.0 * (SELECT sum({weight} * power(1 + {x} * {x} / {df}, -({df} + 1) / 2)) FROM range(4001) AS r(i))"


NORMAL_TAIL = t_tail_sql("sqrt(statistic)", "1e9")

K2 = """mu AS (SELECT column_name, avg(value) AS m FROM l GROUP BY column_name),
c AS (SELECT l.column_name, CAST(count(value) AS DOUBLE) AS n, avg(power(value - m, 2)) AS m2, avg(power(value - m, 3)) AS m3, avg(power(value - m, 4)) AS m4 FROM l JOIN mu USING (column_name) WHERE value IS NOT NULL GROUP BY l.column_name),
s AS (SELECT column_name, n, m3 / power(m2, 1.5) AS g1, m4 / (m2 * m2) AS b2 FROM c WHERE n > 5000),
z1 AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y, 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta FROM s),
z2 AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w FROM z1), z3 AS (SELECT *, sqrt(2 / (w - 1)) AS alpha, 1 / sqrt(0.5 * ln(w)) AS delta FROM z2),
z4 AS (SELECT *, delta * ln(y / alpha + sqrt(power(y / alpha, 2) + 1)) AS zs, (b2 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / (power(n + 1, 2) * (n + 3) * (n + 5))) AS x,
  6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rb FROM z3),
z5 AS (SELECT *, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a FROM z4), z6 AS (SELECT *, 1 + x * sqrt(2 / (a - 4)) AS d FROM z5),
z7 AS (SELECT *, (1 - 2 / (9 * a) - sign(d) * power((1 - 2 / a) / abs(d), 1.0 / 3)) / sqrt(2 / (9 * a)) AS zk FROM z6),
k2 AS (SELECT column_name, CAST(n AS BIGINT) AS n, zs * zs + zk * zk AS statistic FROM z7)"""

# The rational functions of algorithm AS 241 for the inverse normal, centre and tail (numerators, denominators).
INVERSE_NORMAL = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9),
)


def poly_sql(coefficients, x: str) -> str:
    """A polynomial, lowest power first, by nested products."""
    text = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        text = f"({c!r}::DOUBLE + {x} * {text})"
    return text


CENTRE, CENTRE_BELOW, TAIL, TAIL_BELOW = INVERSE_NORMAL

#: Royston's W test over ``l`` (column_name, value): CTEs ending in ``w`` (column_name, n, statistic, p_value). At most 5000 values, so the far tail of the inverse normal isn't met.
W_TEST = f"""wr AS (SELECT column_name, value AS x, row_number() OVER (PARTITION BY column_name ORDER BY value) AS i, count(*) OVER (PARTITION BY column_name) AS n FROM l WHERE value IS NOT NULL),
wp AS (SELECT *, (i - 0.375) / (n + 0.25) - 0.5 AS q FROM wr WHERE n BETWEEN 8 AND 5000),
wq AS (SELECT *, 0.180625 - q * q AS r, sqrt(-ln(0.5 - abs(q))) - 1.6 AS t FROM wp),
ws AS (SELECT *, CASE WHEN abs(q) <= 0.425 THEN q * {poly_sql(CENTRE, 'r')} / {poly_sql(CENTRE_BELOW, 'r')} ELSE sign(q) * {poly_sql(TAIL, 't')} / {poly_sql(TAIL_BELOW, 't')} END AS s FROM wq),
wn AS (SELECT column_name, CAST(max(n) AS DOUBLE) AS n, sum(s * s) AS square, max(s) AS s1, max(s) FILTER (WHERE i = n - 1) AS s2, avg(x) AS mx FROM ws GROUP BY column_name),
wl AS (SELECT *, {poly_sql(LAST_WEIGHT, '(1 / sqrt(n))')} + s1 / sqrt(square) AS last, {poly_sql(SECOND_WEIGHT, '(1 / sqrt(n))')} + s2 / sqrt(square) AS second FROM wn),
wf AS (SELECT *, (square - 2 * s1 * s1 - 2 * s2 * s2) / (1 - 2 * last * last - 2 * second * second) AS phi FROM wl),
ww AS (SELECT column_name, any_value(f.n) AS n, least(1, power(sum(x * CASE WHEN i = 1 THEN -last WHEN i = 2 THEN -second WHEN i = ws.n - 1 THEN second WHEN i = ws.n THEN last ELSE s / sqrt(phi) END), 2) / sum(power(x - mx, 2))) AS statistic
  FROM ws JOIN wf AS f USING (column_name) GROUP BY column_name),
wy AS (SELECT *, CASE WHEN n <= 11 THEN -ln({poly_sql(SMALL_BOUND, 'n')} - ln(1 - statistic)) ELSE ln(1 - statistic) END AS y,
  CASE WHEN n <= 11 THEN {poly_sql(SMALL_MEAN, 'n')} ELSE {poly_sql(LARGE_MEAN, 'ln(n)')} END AS mean, exp(CASE WHEN n <= 11 THEN {poly_sql(SMALL_SCALE, 'n')} ELSE {poly_sql(LARGE_SCALE, 'ln(n)')} END) AS scale FROM ww),
wz AS (SELECT *, (y - mean) / scale AS z FROM wy),
w AS (SELECT column_name, CAST(n AS BIGINT) AS n, statistic, CASE WHEN z > 0 THEN 0.5 * ({t_tail_sql('z', '1e9')}) ELSE 1 - 0.5 * ({t_tail_sql('z', '1e9')}) END AS p_value FROM wz)"""

ORDER_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")


@register("normality_k2", f"""WITH l AS ({long_sql('lineitem', LINE_NUMBERS)}), {K2}
SELECT column_name, n, round(statistic, 3) AS statistic, round(exp(-statistic / 2), 6) AS p_value, exp(-statistic / 2) >= 0.05 AS is_normal FROM k2""")
def normality_k2(spark, sf):
    found = hypothesis.normality_k2(table(spark, sf, "lineitem")).drop("reason")
    return rounded(rounded(found, 3, "statistic"), 6, "p_value")


CUSTOMER_NUMBERS = ("c_custkey", "c_nationkey", "c_acctbal")


@register("normality_shapiro", f"""WITH l AS ({long_sql('customer', CUSTOMER_NUMBERS)} UNION ALL SELECT 'mean_quantity', avg(l_quantity) FROM lineitem GROUP BY l_discount
UNION ALL {long_sql('region', ('r_regionkey',))}), {W_TEST}, c AS (SELECT column_name, count(value) AS n FROM l GROUP BY column_name)
SELECT column_name, c.n, round(statistic, 6) AS statistic, round(p_value, 5) AS p_value, p_value >= 0.05 AS is_normal, CASE WHEN c.n < 8 THEN 'too_few' WHEN c.n > 5000 THEN 'too_many' END AS reason FROM c LEFT JOIN w USING (column_name)""")
def normality_shapiro(spark, sf):
    small = table(spark, sf, "lineitem").groupBy("l_discount").agg(F.avg("l_quantity").alias("mean_quantity")).select("mean_quantity")
    found = hypothesis.normality_shapiro(table(spark, sf, "customer"))
    for other in (small, table(spark, sf, "region")):
        found = found.unionByName(hypothesis.normality_shapiro(other))
    return rounded(rounded(found, 6, "statistic"), 5, "p_value")


NORMAL = "nt AS (SELECT column_name, n, statistic, exp(-statistic / 2) AS p_value, 'D''Agostino K-squared' AS test_name FROM k2 UNION ALL SELECT column_name, n, statistic, p_value, 'Shapiro-Wilk' FROM w)"


@register("normality", f"""WITH l AS ({long_sql('orders', ORDER_NUMBERS)}), {K2}, {W_TEST}, {NORMAL}
SELECT column_name, n, round(statistic, 3) AS statistic, round(p_value, 5) AS p_value, p_value >= 0.05 AS is_normal, CAST(NULL AS VARCHAR) AS reason, test_name FROM nt""")
def normality(spark, sf):
    return rounded(rounded(hypothesis.normality(table(spark, sf, "orders")), 3, "statistic"), 5, "p_value")


WELCH = f"""l AS ({long_sql('lineitem', LINE_NUMBERS).replace(' AS value FROM', ' AS value, l_linestatus AS g FROM')}),
w AS (SELECT column_name, g, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM l GROUP BY column_name, g HAVING count(value) >= 5),
p AS (SELECT a.column_name, a.g AS g1, b.g AS g2, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS statistic,
power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)) AS df1 FROM w a JOIN w b ON a.column_name = b.column_name AND a.g < b.g),
t AS (SELECT *, {t_tail_sql('statistic', 'df1')} AS p_value FROM p)"""


@register("welch_t", f"""WITH {WELCH} SELECT 'T-Test' AS test_type, 'Independent Two-Sample T-Test (l_linestatus vs ' || column_name || ')' AS test_name,
round(statistic, 4) + CAST(0 AS DOUBLE) AS statistic, round(df1, 2) AS df1, round(p_value, 5) AS p_value, p_value < 0.05 AS significant,
CASE WHEN p_value < 0.05 THEN 'The mean of ''' || column_name || ''' is significantly different between groups ''' || g1 || ''' and ''' || g2 || ''' (p < 0.05).'
ELSE 'No statistically significant difference in the mean of ''' || column_name || ''' between groups ''' || g1 || ''' and ''' || g2 || '''.' END AS interpretation FROM t""")
def welch_t(spark, sf):
    found = hypothesis.welch_t(table(spark, sf, "lineitem"))
    found = found.select("test_type", "test_name", "statistic", "df1", "p_value", "significant", "interpretation")
    return rounded(rounded(rounded(found, 4, "statistic"), 2, "df1"), 5, "p_value")


def anova_sql(category: str, numeric: str) -> str:
    """F test in SQL; the upper tail has a closed form for an even number of degrees of freedom."""
    return f"""SELECT '{category}' AS category, '{numeric}' AS column_name, (ssb / (g - 1)) / (ssw / (n - g)) AS statistic, CAST(g - 1 AS DOUBLE) AS df1, CAST(n - g AS DOUBLE) AS df2 FROM (
SELECT count(*) AS g, sum(c) AS n, sum(c * power(m - gm, 2)) AS ssb, sum((c - 1) * v) AS ssw FROM (
SELECT count(*) AS c, avg({numeric}) AS m, var_samp({numeric}) AS v, any_value(gm) AS gm FROM orders, (SELECT avg({numeric}) AS gm FROM orders) AS o GROUP BY {category} HAVING count(*) >= 5) AS i) AS j"""


ANOVA = f"""f AS ({' UNION ALL '.join(anova_sql(c, x) for c in ('o_orderstatus', 'o_orderpriority') for x in ORDER_NUMBERS)}),
x AS (SELECT *, df2 / (df2 + df1 * statistic) AS u, df2 / 2 AS a FROM f),
an AS (SELECT *, CASE df1 WHEN 2 THEN power(u, a) WHEN 4 THEN power(u, a) * (1 + a * (1 - u)) END AS p_value FROM x)"""


@register("anova", f"""WITH {ANOVA} SELECT 'One-Way ANOVA (' || category || ' vs ' || column_name || ')' AS test_name, round(statistic, 4) AS statistic, df1, df2,
round(p_value, 5) AS p_value, p_value < 0.05 AS significant FROM an""")
def anova(spark, sf):
    found = hypothesis.anova(table(spark, sf, "orders")).select("test_name", "statistic", "df1", "df2", "p_value", "significant")
    return rounded(rounded(found, 4, "statistic"), 5, "p_value")


def chi_sql(a: str, b: str, source: str) -> str:
    return f"""SELECT sum(o * o / (r * c)) AS share, max(abs(o - r * c / n)) AS gap, any_value(n) AS n, count(DISTINCT a) AS rows, count(DISTINCT b) AS cols,
CAST(min(r) AS DOUBLE) * max(r) * min(c) * max(c) AS product FROM (SELECT a, b, CAST(o AS DOUBLE) AS o, sum(o) OVER (PARTITION BY a) * 1.0::DOUBLE AS r, sum(o) OVER (PARTITION BY b) * 1.0::DOUBLE AS c, sum(o) OVER () * 1.0::DOUBLE AS n
FROM (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o FROM {source} GROUP BY 1, 2) AS t0) AS t1"""


CHI = f"""ch AS (SELECT 'l_returnflag vs l_linestatus' AS pair, * FROM ({chi_sql('l_returnflag', 'l_linestatus', 'lineitem')}) AS q1 UNION ALL
SELECT 'o_orderstatus vs o_orderpriority', * FROM ({chi_sql('o_orderstatus', 'o_orderpriority', 'orders')}) AS q2 UNION ALL
SELECT 'quality vs toxic', * FROM ({chi_sql('quality', 'toxic', 'labels')}) AS q3),
cs AS (SELECT pair, CAST((rows - 1) * (cols - 1) AS DOUBLE) AS df1, CASE WHEN (rows - 1) * (cols - 1) = 1 THEN power(greatest(gap - 0.5, 0), 2) * n * n * n / product ELSE n * (share - 1) END AS statistic FROM ch),
cp AS (SELECT *, CASE df1 WHEN 1 THEN {NORMAL_TAIL} WHEN 2 THEN exp(-statistic / 2)
WHEN 8 THEN exp(-statistic / 2) * (1 + statistic / 2 + power(statistic / 2, 2) / 2 + power(statistic / 2, 3) / 6) END AS p_value FROM cs)"""


@register("chi_square", f"""WITH {CHI} SELECT 'Chi-Square Test of Independence (' || pair || ')' AS test_name, round(statistic, 4) AS statistic, df1, round(p_value, 5) AS p_value, p_value < 0.05 AS significant FROM cp""")
def chi_square(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("quality").cast("string"), F.col("toxic").cast("string"))
    parts = [hypothesis.chi_square(t) for t in (table(spark, sf, "lineitem"), table(spark, sf, "orders"), labels)]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("test_name", "statistic", "df1", "p_value", "significant")
    return rounded(rounded(found, 4, "statistic"), 5, "p_value")


ALL_TESTS = f"""l AS ({long_sql('orders', ORDER_NUMBERS)}), {K2}, {W_TEST}, {NORMAL}, {ANOVA}, {CHI},
tests AS (SELECT 'ANOVA' AS test_type, 'One-Way ANOVA (' || category || ' vs ' || column_name || ')' AS test_name, statistic, p_value FROM an UNION ALL
SELECT 'Chi-Square', 'Chi-Square Test of Independence (' || pair || ')', statistic, p_value FROM cp WHERE df1 = 8 UNION ALL
SELECT 'Normality Test', test_name || ': ''' || column_name || '''', statistic, p_value FROM nt)"""


@register("all_tests", f"WITH {ALL_TESTS} SELECT test_type, test_name, round(statistic, 3) AS statistic, round(p_value, 5) AS p_value, p_value < 0.05 AS significant FROM tests")
def all_tests(spark, sf):
    found = hypothesis.all_tests(table(spark, sf, "orders")).select("test_type", "test_name", "statistic", "p_value", "significant")
    return rounded(rounded(found, 3, "statistic"), 5, "p_value")


@register("union_tests", f"WITH {ALL_TESTS} SELECT test_type, count(*) AS tests, count(*) FILTER (WHERE p_value < 0.05) AS significant FROM tests GROUP BY test_type")
def union_tests(spark, sf):
    found = hypothesis.all_tests(table(spark, sf, "orders"))
    return found.groupBy("test_type").agg(F.count(F.lit(1)).alias("tests"), F.count_if("significant").alias("significant"))


@register("p_value", f"""WITH g AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY o_custkey HAVING count(*) >= 5),
s AS (SELECT o_custkey, (m - (SELECT avg(o_totalprice) FROM orders)) / sqrt(v / n) AS statistic, CAST(n - 1 AS DOUBLE) AS df1 FROM g)
SELECT o_custkey, round({t_tail_sql('statistic', 'df1')}, 6) AS t_p, round(exp(-abs(statistic) / 2), 6) AS chi_p, round(power(df1 / (df1 + 2 * abs(statistic)), df1 / 2), 6) AS f_p FROM s""")
def p_value(spark, sf):
    orders = table(spark, sf, "orders")
    mean = orders.agg(F.avg("o_totalprice").alias("m")).scalar()
    groups = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"), F.var_samp("o_totalprice").alias("v"))
    t = (F.col("m") - mean) / F.sqrt(F.col("v") / F.col("n"))
    tested = groups.filter("n >= 5").select("o_custkey", t.alias("t"), (F.col("n") - 1).alias("df"))
    size = F.abs("t")
    return tested.select(
        "o_custkey", F.round(tails.t_p_value(F.col("t"), F.col("df")), 6).alias("t_p"),
        F.round(tails.chi_p_value(size, F.lit(2)), 6).alias("chi_p"), F.round(tails.f_p_value(size, F.lit(2), F.col("df")), 6).alias("f_p"),
    )
