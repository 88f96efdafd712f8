"""Which charts a table gets, and their series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkgauge.operators.charts import bars, histogram, scatter_sample, time_bucket_mean
from sparkgauge.operators.correlation import correlation_matrix, heatmap
from sparkgauge.plans.profile import Profile
from sparkgauge.session import small_frame

CATALOG_SCHEMA = "chart_ix int, chart_type string, x_axis string, y_axis string, title string"


def _names(schema: DataFrame, *kinds: str) -> list[str]:
    rows = schema.filter(F.col("semantic_type").isin(*kinds)).orderBy("column_ix").select("column_name").collect()
    return [r["column_name"] for r in rows]


def chart_catalog(schema: DataFrame, strong: DataFrame, most: int | None = None) -> DataFrame:
    """(chart_ix, chart_type, x_axis, y_axis, title) in display order; all charts, or the first ``most`` of each type."""
    numeric = _names(schema, "numeric")
    categories = _names(schema, "categorical", "boolean")
    dates = _names(schema, "datetime")
    pairs = [(r["var1"], r["var2"]) for r in strong.orderBy("pair_ix").collect()]
    charts = []
    if len(numeric) >= 2:
        charts.append(("heatmap", None, None, "Feature Correlation Heatmap"))
    charts += [("line", d, c, f"Trend of {c} over time") for d in dates for c in numeric][:most]
    charts += [("histogram", c, "Frequency Count", f"Distribution of {c}") for c in numeric[:most]]
    charts += [("bar", c, "Count", f"Value Counts of {c}") for c in categories[:most]]
    charts += [("scatter", a, b, f"{a} vs {b} Scatter Plot") for a, b in pairs[:most]]
    return small_frame(schema.sparkSession, [(i, *c) for i, c in enumerate(charts)], CATALOG_SCHEMA)


def chart_series(df: DataFrame, profile: Profile, most: int | None = None, scatter_points: int | None = 300, raw_points: int = 0) -> DataFrame:
    """(chart_ix, chart_type, x, y, value) of the charts in the catalog.

    A scatter chart draws a sample of ``scatter_points`` rows (None: all); a line of at most ``raw_points`` points is drawn as it is.

    x is a label or a number as text, y the second label of heatmap cells.
    """
    parts = []
    none = F.lit(None).cast("string")
    for chart in chart_catalog(profile.columns, profile.strong, most).collect():
        kind, x, y = chart["chart_type"], chart["x_axis"], chart["y_axis"]
        if kind == "heatmap":
            rows = heatmap(correlation_matrix(df)).select("x", "y", "value")
        elif kind == "line":
            rows = time_bucket_mean(df, x, y, raw_points).select(F.col("date").alias("x"), none.alias("y"), "value")
        elif kind == "histogram":
            rows = histogram(df, [x]).select(F.col("label").alias("x"), none.alias("y"), F.col("count").cast("double").alias("value"))
        elif kind == "bar":
            rows = bars(df, [x]).select(F.col("category").alias("x"), none.alias("y"), F.col("count").cast("double").alias("value"))
        else:
            rows = scatter_sample(df, x, y, points=scatter_points).select(F.col("x").cast("string"), none.alias("y"), F.col("y").alias("value"))
        parts.append(rows.select(F.lit(chart["chart_ix"]).alias("chart_ix"), F.lit(kind).alias("chart_type"), "x", "y", "value"))
    if not parts:
        return small_frame(df.sparkSession, [], "chart_ix int, chart_type string, x string, y string, value double")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
