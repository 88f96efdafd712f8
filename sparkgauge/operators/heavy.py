"""The most frequent values of columns, found by a sketch with a proof.

**Sketch.** Each task counts values in a dictionary of at most ``HELD`` entries for each
column. When it is full, the count of the entry in the middle is taken from all, what is
not positive goes, and the amount is noted as missed. Such sketches add up: no value has
more occurrences than its counts and all missed amounts together. A column with few values
has missed nothing and its counts are exact; one whose values are all different sends
almost nothing on, instead of every value through the shuffle.

**Proof.** If the missed amount is less than the k-th largest count, no value outside the
sketch is among the first k, and a second scan counts the few that can be.

**Else** (counts near each other) values are counted in full, as 8-byte hashes. A hash
counts at least as often as any of its values, so the values behind the hashes with the
largest counts are counted again, exactly, until the k-th count is at least the limit they
were chosen by. If too many values tie at that limit, they are read in ascending order, a
bounded number at a time, until enough of them have that count.

Long texts are told apart by their first ``KEY_LIMIT`` characters and a digest; only texts
that tie with each other up to there are looked at in full.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparkgauge.functions.cells import boolean_mask, is_datetime_text, to_timestamp
from sparkgauge.operators.shape import as_text, fields, long_form
from sparkgauge.session import PIN_LIMIT, cut_lineage, pin, small_frame

KEY_LIMIT = 64
#: Characters of the longest text that can be a date or a boolean.
LONGEST_FACT = 100
ALWAYS_SHORT = (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Values that a task counts for each column, and those it sends on if some were missed.
HELD, SENT = 1 << 15, 1 << 11
#: Values of a column that are counted again one by one, and long texts that are fetched to order them.
MOST_CANDIDATES, MOST_FETCHED = 20_000, 200


def value_key(text: Column) -> Column:
    """Short text as it is; long text as its first characters, which keep its place in the order, its SHA-256 and its value facts."""
    return F.when(F.char_length(text) <= KEY_LIMIT, text).otherwise(
        F.when(text.isNotNull(), F.concat(F.substring(text, 1, KEY_LIMIT), F.sha2(text, 256), *[F.concat(F.lit(":"), x.cast("string")) for x in _facts(text)])))


def key_of(field: T.StructField) -> Column:
    text = as_text(field)
    return text if isinstance(field.dataType, ALWAYS_SHORT) else value_key(text)


def length_of(field: T.StructField) -> Column:
    """Characters of a value; of a kind that has no long texts, null, since nothing asks for them."""
    return F.lit(None).cast("int") if isinstance(field.dataType, ALWAYS_SHORT) else F.char_length(as_text(field))


def _facts(text: Column) -> tuple[Column, Column]:
    """Whether a text is a date, and its boolean bit; no text that is long without its outer blanks is either."""
    short = F.when(F.char_length(F.trim(text)) <= LONGEST_FACT, text)
    return to_timestamp(short).isNotNull().cast("int"), F.coalesce(boolean_mask(short), F.lit(0))


def key_facts(key: Column) -> tuple[Column, Column]:
    """The same from a key."""
    long = F.char_length(key) > KEY_LIMIT
    short = F.when(~long, key)
    held = lambda i: F.element_at(F.split(key, ":"), i).cast("int")
    return F.when(long, held(-2)).otherwise(to_timestamp(short).isNotNull().cast("int")), F.when(long, held(-1)).otherwise(boolean_mask(short))


class Sketch:
    """Counts of a stream's most frequent values; ``missed`` bounds what any value has more."""

    def __init__(self, held: int = HELD, sent: int = SENT):
        self.counts: dict[str, int] = {}
        self.missed = self.rows = self.chars = 0
        self.example: str | None = None
        self.most_held, self.most_sent = held, sent

    def add(self, column: pa.Array, lengths: pa.Array | None = None) -> None:
        self.rows += len(column)
        self.chars += (pc.sum(lengths).as_py() or 0) if lengths is not None else 0
        found = pc.value_counts(column.drop_null())
        counts, values = self.counts, found.field(0).to_pylist()
        for value, n in zip(values, found.field(1).to_pylist()):
            counts[value] = counts.get(value, 0) + n
        if self.example is None and values:
            self.example = values[0]
        if len(counts) > self.most_held:
            middle = sorted(counts.values(), reverse=True)[self.most_held // 2]
            self.counts = {value: n - middle for value, n in counts.items() if n > middle}
            self.missed += middle

    def sent(self) -> tuple[list[tuple[str, int]], int]:
        """The counts to send on, and what a value may have more than it has among them."""
        if not self.missed or len(self.counts) <= self.most_sent:
            return list(self.counts.items()), self.missed
        ordered = sorted(self.counts.items(), key=lambda x: -x[1])
        return ordered[:self.most_sent], self.missed + ordered[self.most_sent][1]


STATE = "column_ix int, key string, n bigint, missed bigint, rows bigint, chars bigint, example string"


def sketched(keys: DataFrame, width: int) -> DataFrame:
    """The sketches of ``width`` columns of keys, which their lengths may follow.

    One row with a null key for each column has its totals and one of its values; the others have counts of values.
    """
    held, sent = HELD, SENT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [Sketch(held, sent) for _ in range(width)]
        for batch in batches:
            for i, sketch in enumerate(sketches):
                sketch.add(batch.column(i), batch.column(width + i) if batch.num_columns > width else None)
        for i, sketch in enumerate(sketches):
            counts, missed = sketch.sent()
            size = len(counts) + 1
            first = lambda x: pa.array([x] + [0] * (size - 1), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * size, pa.int32()), pa.array([None, *[v for v, _ in counts]], pa.string()), pa.array([0, *[n for _, n in counts]], pa.int64()),
                 first(missed), first(sketch.rows), first(sketch.chars), pa.array([sketch.example] + [None] * (size - 1), pa.string())],
                ["column_ix", "key", "n", "missed", "rows", "chars", "example"])

    states = keys.mapInArrow(count, STATE)
    return states.groupBy("column_ix", "key").agg(*[F.sum(c).alias(c) for c in ("n", "missed", "rows", "chars")], F.min("example").alias("example"))


@dataclass
class Counted:
    """One scan's sketches of a table's columns, which value facts, modes and top values all read; and the hash counts of columns with too many values for one."""

    df: DataFrame
    names: list[str]
    counts: DataFrame  # column_name, key, n
    local: dict[str, dict[str, int]] | None  # the same, if it is small enough to be here
    totals: dict[str, dict]  # of each column: missed, rows, chars, example
    hashes: DataFrame | None = None  # column_name, h, g, n

    def few(self) -> list[str]:
        return [c for c in self.names if c in self.totals and not self.totals[c]["missed"]]

    def many(self) -> list[str]:
        return [c for c in self.names if c in self.totals and self.totals[c]["missed"]]

    def sizes(self) -> dict[str, int]:
        """Distinct counts of the columns with few."""
        if self.local is not None:
            return {c: len(self.local.get(c, ())) for c in self.few()}
        found = self.counts.filter(F.col("column_name").isin(self.few())).groupBy("column_name").agg(F.count(F.lit(1)).alias("k"))
        return dict.fromkeys(self.few(), 0) | {r["column_name"]: r["k"] for r in found.collect()}

    def hashed(self) -> DataFrame:
        """All present values of the columns with many, counted by 128 bits; stored once."""
        if self.hashes is None:
            chosen = fields(self.df, self.many())
            long = long_form(self.df, {f.name: key_of(f) for f in chosen}).filter(F.col("value").isNotNull())
            digests = (F.xxhash64("value").alias("h"), F.xxhash64(F.lit(1), "value").alias("g"))
            self.hashes = cut_lineage(long.select("column_name", *digests).groupBy("column_name", "h", "g").agg(F.count(F.lit(1)).alias("n")))
        return self.hashes


def count_values(df: DataFrame, names: Sequence[str]) -> Counted:
    """Sketch the columns in one scan."""
    chosen, schema, spark = fields(df, names), "column_name string, key string, n bigint", df.sparkSession
    if not chosen:
        return Counted(df, [], small_frame(spark, [], schema), {}, {})
    sketch = sketched(df.select(*[key_of(f).alias(f"c{i}") for i, f in enumerate(chosen)], *[length_of(f).alias(f"l{i}") for i, f in enumerate(chosen)]), len(chosen))
    rows = sketch.limit(PIN_LIMIT + 1).collect()
    if len(rows) > PIN_LIMIT:
        stored = cut_lineage(sketch)
        totals = {names[r["column_ix"]]: r.asDict() for r in stored.filter(F.col("key").isNull()).collect()}
        return Counted(df, list(names), stored.filter(F.col("key").isNotNull()).select(F.get(F.lit(list(names)), F.col("column_ix")).alias("column_name"), "key", "n"), None, totals)
    totals = {names[r["column_ix"]]: r.asDict() for r in rows if r["key"] is None}
    local: dict[str, dict[str, int]] = {}
    for r in rows:
        if r["key"] is not None:
            local.setdefault(names[r["column_ix"]], {})[r["key"]] = r["n"]
    counts = small_frame(spark, [(c, key, n) for c, held in local.items() for key, n in held.items()], schema)
    return Counted(df, list(names), counts, local, totals)


def distinct(counted: Counted) -> DataFrame:
    """(column_name, distinct_count, present) of all columns that have rows; exact."""
    name, schema = F.col("column_name"), "column_name string, distinct_count bigint, present bigint"
    if counted.local is not None:
        found = small_frame(counted.df.sparkSession, [(c, len(v), sum(v.values())) for c in counted.few() for v in [counted.local.get(c, {})]], schema)
    else:
        found = counted.counts.filter(name.isin(counted.few())).groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"), F.sum("n").alias("present"))
    if counted.many():
        found = found.unionByName(counted.hashed().groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"), F.sum("n").alias("present")))
    return found


def text_facts(counted: Counted) -> DataFrame:
    """(column_name, row_count, null_count, distinct_count, avg_length, all_dates, boolean_pair) of the columns.

    Dates and booleans are looked for among the distinct values of a column with few. Of one with many, which is
    no boolean pair, all values are read only if one of them is a date.
    """
    spark, many, schema = counted.df.sparkSession, counted.many(), "column_name string, all_dates boolean, boolean_pair boolean"
    is_date, mask = key_facts(F.col("key"))
    few = counted.counts.filter(F.col("column_name").isin(counted.few())).select("column_name", is_date.alias("is_date"), mask.alias("mask"))
    if counted.local is not None:
        seen: dict[str, list[int]] = {}
        for r in few.collect():  # worked out where the few values are, without a job
            held = seen.setdefault(r["column_name"], [1, -1])
            held[:] = [held[0] & r["is_date"], held[1] & r["mask"]]
        tests = small_frame(spark, [(c, a == 1, b not in (0, -1)) for c, (a, b) in seen.items()], schema)
    else:
        tests = few.groupBy("column_name").agg((F.min("is_date") == 1).alias("all_dates"), (F.bit_and("mask") != 0).alias("boolean_pair"))
    maybe: list[str] = []
    if many:
        example = small_frame(spark, [(c, counted.totals[c]["example"]) for c in many], "column_name string, key string")
        maybe = [r["column_name"] for r in example.filter(is_date == 1).collect()]
        tests = tests.unionByName(small_frame(spark, [(c, False, False) for c in many if c not in maybe], schema))
    if maybe:
        long = long_form(counted.df, {f.name: as_text(f) for f in fields(counted.df, maybe)})
        tests = tests.unionByName(long.groupBy("column_name").agg(is_datetime_text(F.col("value")).alias("all_dates"), F.lit(False).alias("boolean_pair")))
    totals = small_frame(spark, [(c, t["rows"], t["chars"]) for c, t in counted.totals.items()], "column_name string, row_count bigint, chars bigint")
    told = totals.join(F.broadcast(distinct(counted)), "column_name", "left").join(F.broadcast(tests), "column_name", "left")
    present = F.coalesce("present", F.lit(0))
    return told.filter("row_count > 0").select(
        "column_name", "row_count", (F.col("row_count") - present).alias("null_count"), F.coalesce("distinct_count", F.lit(0)).cast("bigint").alias("distinct_count"),
        F.when(present > 0, F.col("chars") / present).alias("avg_length"), F.coalesce("all_dates", F.lit(False)).alias("all_dates"),
        F.coalesce("boolean_pair", F.lit(False)).alias("boolean_pair"))


def _kth(counts: DataFrame, group: str, k: int) -> dict:
    """The k-th largest n of each group that has as many rows."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n")))
    return {r[group]: r["n"] for r in counts.withColumn("nth", nth).filter(F.col("nth") == k).select(group, "n").collect()}


def _recounted(df: DataFrame, names: Sequence[str], wanted: DataFrame) -> DataFrame:
    """(column_name, key, n): exact counts of the keys whose hash is among a few wanted ones (column_name, h)."""
    long = long_form(df, {f.name: key_of(f) for f in fields(df, names)}).withColumnRenamed("value", "key")
    hashed = long.filter(F.col("key").isNotNull()).withColumn("h", F.xxhash64("key"))
    return hashed.join(F.broadcast(wanted), ["column_name", "h"], "left_semi").groupBy("column_name", "key").agg(F.count(F.lit(1)).alias("n"))


def _smallest(df: DataFrame, name: str, after: str | None, most: int) -> list[str]:
    """The ``most`` smallest different values of a column above ``after``; each task holds no more than that."""
    text = df.select(as_text(fields(df, [name])[0]).alias("value")).filter(F.col("value").isNotNull())

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            column = batch.column(0)
            if after is not None:
                column = column.filter(pc.greater(column, after))
            if len(held) == most:
                column = column.filter(pc.less(column, held[-1]))
            if len(column):
                held = sorted({*held, *pc.unique(column).to_pylist()}, key=str.encode)[:most]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    found = text.mapInArrow(least, "value string").distinct().orderBy("value").limit(most)
    return [r["value"] for r in found.collect()]


def _ties(df: DataFrame, name: str, tied: DataFrame, count: int, needed: int, k: int) -> DataFrame:
    """(column_name, value, n) of the ``needed`` smallest values with this count; ``tied`` (h) has their hashes, and perhaps a few more."""
    spark, after, found, most = df.sparkSession, None, [], 2 * k + 16
    while len(found) < needed:
        values = _smallest(df, name, after, most)
        if not values:
            break
        listed = spark.createDataFrame([(v,) for v in values], "value string").withColumn("h", F.xxhash64(value_key(F.col("value"))))
        maybe = tied.join(F.broadcast(listed), "h").select("h", "value")
        if count > 1:  # a hash may stand for several values; one that occurs once can't
            exact = _recounted(df, [name], maybe.select(F.lit(name).alias("column_name"), "h")).filter(F.col("n") == count)
            maybe = maybe.withColumn("key", value_key(F.col("value"))).join(exact.select("key"), "key", "left_semi")
        found += [r["value"] for r in maybe.select("value").distinct().collect()]
        after, most = values[-1], most * 8
    rows = [(name, v, count) for v in sorted(found, key=str.encode)[:needed]]
    return spark.createDataFrame(rows, "column_name string, value string, n bigint")


def _texts_of(df: DataFrame, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """(column_name, key, full): the texts behind a few long keys; copies collapse inside each task."""
    long = long_form(df, {f.name: as_text(f) for f in fields(df, columns)})
    found = long.filter(F.char_length("value") > KEY_LIMIT).withColumn("key", value_key(F.col("value")))
    hits = found.join(F.broadcast(keys), ["column_name", "key"], "left_semi")
    return hits.groupBy("column_name", "key").agg(F.any_value("value").alias("full"))


def _first(df: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(column_name, rank, value, n): the first k by exact counts (column_name, key, n), ties in ascending order of the whole value."""
    lead = Window.partitionBy("column_name").orderBy(F.desc("n"), F.substring("key", 1, KEY_LIMIT))
    # Besides the first k, what ties with the last of them up to KEY_LIMIT characters.
    ranked = counts.withColumn("rank", F.rank().over(lead)).filter(F.col("rank") <= k)
    sizes = ranked.groupBy("column_name").agg(F.count_if(F.char_length("key") > KEY_LIMIT).alias("long")).collect()
    crowded = [r["column_name"] for r in sizes if r["long"] > MOST_FETCHED + k]
    some = (ranked.filter(~F.col("column_name").isin(crowded)) if crowded else ranked).select("column_name", "key", "n").collect()
    return _in_order(df, counts, [tuple(r) for r in some], crowded, k)


def _first_here(df: DataFrame, counted: Counted, k: int) -> DataFrame:
    """The same for the columns with few values, whose counts are here."""
    some, crowded = [], []
    for name in counted.few():
        ordered = sorted(counted.local.get(name, {}).items(), key=lambda x: (-x[1], x[0][:KEY_LIMIT].encode()))
        if len(ordered) > k:
            last = (ordered[k - 1][1], ordered[k - 1][0][:KEY_LIMIT])
            ordered = ordered[:k] + [x for x in ordered[k:] if (x[1], x[0][:KEY_LIMIT]) == last]
        if sum(len(key) > KEY_LIMIT for key, _ in ordered) > MOST_FETCHED + k:
            crowded.append(name)
        else:
            some += [(name, key, n) for key, n in ordered]
    return _in_order(df, counted.counts, some, crowded, k)


def _in_order(df: DataFrame, counts: DataFrame, some: list[tuple[str, str, int]], crowded: Sequence[str], k: int) -> DataFrame:
    """Ranks of a few candidates by count and whole value, and of the columns where very many tie."""
    spark, value_of = df.sparkSession, {}
    long_keys = [(name, key) for name, key, _ in some if len(key) > KEY_LIMIT]
    if long_keys:
        found = _texts_of(df, sorted({name for name, _ in long_keys}), small_frame(spark, long_keys, "column_name string, key string"))
        value_of = {(r["column_name"], r["key"]): r["full"] for r in found.collect()}
    rows = [(name, value_of.get((name, key), key), n) for name, key, n in some]
    for name in crowded:
        own = counts.filter(F.col("column_name") == name)
        rows += [tuple(r) for r in _crowded(df, name, own.select(F.xxhash64("key").alias("h"), "n"), k, _kth(own, "column_name", k)[name]).collect()]
    rows.sort(key=lambda r: (r[0], -r[2], r[1].encode()))
    ranked = [(name, i + 1, value, n) for _, group in groupby(rows, key=lambda r: r[0]) for i, (name, value, n) in enumerate(group) if i < k]
    return small_frame(spark, ranked, "column_name string, rank int, value string, n bigint")


def _crowded(df: DataFrame, name: str, hashes: DataFrame, k: int, limit: int) -> DataFrame:
    """(column_name, value, n) of the first k where very many values tie at the count ``limit`` of hashes (h, n)."""
    above = hashes.filter(F.col("n") > limit).select(F.lit(name).alias("column_name"), "h")
    exact = pin(_recounted(df, [name], above))
    more = _first(df, exact.filter(F.col("n") > limit), k).drop("rank")
    same = exact.filter(F.col("n") == limit).select(F.xxhash64("key").alias("h"))
    tied = hashes.filter(F.col("n") == limit).select("h").unionByName(same)
    found = pin(more.unionByName(_ties(df, name, tied, limit, k - more.count(), k)))
    lower = hashes.filter(F.col("n") < limit).agg(F.max("n").alias("n")).first()["n"]
    # Too few only if values share hashes: then the k-th has a smaller count.
    return found if lower is None or found.count() >= k else _crowded(df, name, hashes, k, lower)


def _by_hashes(df: DataFrame, names: Sequence[str], hashes: DataFrame, k: int) -> DataFrame:
    """(column_name, rank, value, n) from the counts of all values as hashes (column_name, h, n)."""
    limits, result, open_ = _kth(hashes, "column_name", k), None, list(names)
    while open_:
        chosen = F.lit(False)
        for name in open_:
            chosen = chosen | ((F.col("column_name") == name) & (F.col("n") >= limits.get(name, 1)))
        among = hashes.filter(chosen)
        sizes = {r["column_name"]: r["size"] for r in among.groupBy("column_name").agg(F.count(F.lit(1)).alias("size")).collect()}
        few = [name for name in open_ if sizes.get(name, 0) <= MOST_CANDIDATES]
        parts = [_crowded(df, name, hashes.filter(F.col("column_name") == name).select("h", "n"), k, limits.get(name, 1)) for name in open_ if name not in few]
        open_ = []
        if few:
            exact = cut_lineage(_recounted(df, few, among.filter(F.col("column_name").isin(few)).select("column_name", "h")))
            reached = _kth(exact, "column_name", k)
            # Two values under one hash: what they have together let others go that may have more than each.
            open_ = [name for name in few if name in limits and reached.get(name, 1) < limits[name]]
            limits |= {name: reached.get(name, 1) for name in open_}
            done = [name for name in few if name not in open_]
            if done:
                parts.append(_first(df, exact.filter(F.col("column_name").isin(done)), k).drop("rank"))
        for part in parts:
            result = part if result is None else result.unionByName(part)
    nth = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return result.withColumn("rank", nth).filter(F.col("rank") <= k).select("column_name", "rank", "value", "n")


def top_values(df: DataFrame, names: Sequence[str], k: int = 10, counted: Counted | None = None) -> DataFrame:
    """(column_name, rank, value, count, percentage of all rows); ties in ascending value order.

    The result is a selection, the k most frequent values of each column; it is exact.
    """
    spark = df.sparkSession
    counted = count_values(df, names) if counted is None else counted
    counts, name, missed = counted.counts, F.col("column_name"), {c: counted.totals[c]["missed"] for c in counted.many()}
    limit = _kth(counts.filter(name.isin(counted.many())), "column_name", k) if missed else {}
    proven = [c for c in missed if missed[c] < limit.get(c, 0)]
    parts = []
    if counted.few():
        parts.append(_first(df, counts.filter(name.isin(counted.few())), k) if counted.local is None else _first_here(df, counted, k))
    if proven:
        chosen = F.lit(False)
        for c in proven:
            chosen = chosen | ((name == c) & (F.col("n") + missed[c] >= limit[c]))
        candidates = counts.filter(chosen)
        sizes = {r["column_name"]: r["size"] for r in candidates.groupBy("column_name").agg(F.count(F.lit(1)).alias("size")).collect()}
        proven = [c for c in proven if sizes.get(c, 0) <= MOST_CANDIDATES]
    if proven:
        wanted = candidates.filter(name.isin(proven)).select("column_name", F.xxhash64("key").alias("h"))
        parts.append(_first(df, pin(_recounted(df, proven, wanted)), k))
    rest = [c for c in missed if c not in proven]
    if rest:
        hashes = counted.hashed().filter(name.isin(rest)).groupBy("column_name", "h").agg(F.sum("n").alias("n"))
        parts.append(_by_hashes(df, rest, cut_lineage(hashes), k))
    top = spark.createDataFrame([], "column_name string, rank int, value string, n bigint")
    for part in parts:
        top = top.unionByName(part)
    rows = max([x["rows"] for x in counted.totals.values()], default=0)
    return top.select("column_name", "rank", "value", F.col("n").alias("count"), F.round(F.col("n") / F.lit(rows) * 100, 2).alias("percentage"))
