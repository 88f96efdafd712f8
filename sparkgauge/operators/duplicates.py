"""Exact-row duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkgauge.operators.shape import col_of


def _has(kind: T.DataType, *sought: type) -> bool:
    """Whether a type is or holds one of the sought types at any depth."""
    if isinstance(kind, sought):
        return True
    if isinstance(kind, T.ArrayType):
        return _has(kind.elementType, *sought)
    if isinstance(kind, T.MapType):
        return _has(kind.keyType, *sought) or _has(kind.valueType, *sought)
    return isinstance(kind, T.StructType) and any(_has(f.dataType, *sought) for f in kind.fields)


def comparable(c: Column, kind: T.DataType) -> Column:
    """The value with maps, which have no equality, as sorted entries at every depth, and variants as JSON."""
    if not _has(kind, T.MapType, T.VariantType):
        return c
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: comparable(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(
            comparable(e["key"], kind.keyType).alias("key"), comparable(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    fields = [comparable(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
    return F.when(c.isNotNull(), F.struct(*fields))


def _keys(df: DataFrame) -> list[Column]:
    return [comparable(col_of(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]


def encoded(c: Column, kind: T.DataType) -> list[Column]:
    """A value as columns whose sequence tells it apart from every unequal value of its type, and from none equal to it.

    A hash passes over nulls and the ends of arrays, so each value at each depth is led by
    whether it is there, and an array by its size. Zeros and NaNs each have one form; times and
    decimals keep their own type and so all their digits; maps are sorted entries.
    """
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return encoded(comparable(c, kind), T.ArrayType(entry))
    there = c.isNotNull()
    if isinstance(kind, T.ArrayType):
        return [there, F.size(c), F.transform(c, lambda x: F.struct(*encoded(x, kind.elementType)))]
    if isinstance(kind, T.StructType):
        return [there, *[part for f in kind.fields for part in encoded(c.getField(f.name), f.dataType)]]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return [there, F.when(c == 0, F.lit(0).cast(kind)).when(F.isnan(c), F.lit(float("nan")).cast(kind)).otherwise(c)]
    return [there, comparable(c, kind)]


def _digest(df: DataFrame) -> list[Column]:
    """128 bits of a row's encoding: two XXH64 values with different leads.

    Among 10^12 different rows the chance of any two with one digest is about 10^-15.
    """
    parts = [part for f in df.schema.fields for part in encoded(col_of(f.name), f.dataType)]
    return [F.xxhash64(F.lit(lead), *parts).alias(f"h{lead}") for lead in (1, 2)]


def duplicate_count(df: DataFrame) -> DataFrame:
    """(row_count, duplicate_count, duplicate_percentage): rows that repeat another row.

    One scan and one shuffle: rows become 16-byte digests, copies are combined inside
    each map task, and the counts of the digests give both numbers.
    """
    counted = df.select(*_digest(df)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"),
                       F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"))
    rows = F.col("row_count")
    share = F.when(rows > 0, F.col("duplicate_count") / rows * 100).otherwise(F.lit(0.0))
    return sums.select("row_count", "duplicate_count", share.alias("duplicate_share"), F.round(share, 1).alias("duplicate_percentage"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows; maps at any depth are equal when their entries are."""
    odd = [i for i, f in enumerate(df.schema.fields) if _has(f.dataType, T.MapType, T.VariantType)]
    if not odd:
        return df.dropDuplicates()
    keys = _keys(df)
    named = {i: f"__key_{i}" for i in odd}
    wide = df.select(*[col_of(c) for c in df.columns], *[keys[i].alias(n) for i, n in named.items()])
    return wide.dropDuplicates([named.get(i, c) for i, c in enumerate(df.columns)]).drop(*named.values())
