"""Reliability tier by row count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkgauge.plans.texts import TIER_ACTIONS, TIER_EXPLANATION, TIER_WARNINGS, TIERS


def by_tier(rows: Column, values: list) -> Column:
    """The value of the tier a row count falls in; ``values`` in tier order."""
    chosen = F.lit(values[-1]) if not isinstance(values[-1], Column) else values[-1]
    for (_, most, *_), value in reversed(list(zip(TIERS, values))):
        if most is not None:
            chosen = F.when(rows <= most, value if isinstance(value, Column) else F.lit(value)).otherwise(chosen)
    return chosen


def tier(rows: Column) -> Column:
    return by_tier(rows, [t[0] for t in TIERS])


def can_infer(rows: Column) -> Column:
    return by_tier(rows, [t[4] for t in TIERS])


def texts(rows: Column, table: dict[str, tuple[str, ...]]) -> Column:
    lists = [F.array(*[F.lit(x) for x in table[t[0]]]).cast("array<string>") for t in TIERS]
    return by_tier(rows, lists)


def reliability(counts: DataFrame) -> DataFrame:
    """One row per row of ``counts`` with its tier, flags, warnings and actions."""
    rows = F.col("row_count")
    return counts.select(
        "*",
        tier(rows).alias("level"),
        by_tier(rows, [t[2] for t in TIERS]).alias("confidence"),
        by_tier(rows, [t[3] for t in TIERS]).alias("severity"),
        can_infer(rows).alias("can_infer"),
        can_infer(rows).alias("can_model"),
        can_infer(rows).alias("can_hypothesis_test"),
        F.lit(True).alias("can_visualize"),
        by_tier(rows, [t[5] for t in TIERS]).alias("requires_caution"),
        by_tier(rows, [TIER_EXPLANATION[t[0]] for t in TIERS]).alias("explanation"),
        texts(rows, TIER_WARNINGS).alias("warnings"),
        texts(rows, TIER_ACTIONS).alias("recommended_actions"),
    )
