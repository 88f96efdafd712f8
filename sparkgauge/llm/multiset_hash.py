"""Document fingerprints by a homomorphic multiset hash, in DataFrame operations only.

Each paragraph is hashed into a wide vector and a document's fingerprint is the sum of
its paragraphs' vectors, lane by lane modulo a power of two. Order plays no part, and
a paragraph is put in or taken out by adding or subtracting its vector
(``insert_paragraphs``, ``delete_paragraphs``). The vector has eight lanes of 32 bits,
four XXH64 values with seeds of their own, which decide equality; a count of its
sentences; and 64 lanes of 16 bits that count, over its sentences, how often each
hash bit is set. Twice a count less the number of sentences is a sum of random signs,
so squared differences of these lanes estimate how many sentences two documents do
not share; ``likeness`` is one less that, over what both have.

Paragraphs are the non-empty lines of a text; sentences end at ``.``, ``!`` or ``?``
before a blank. Null text counts as empty and has the zero vector; two zero vectors are
alike (1.0). Rows that repeat are kept. Ids are numbers; rows without one come last, in the
order of a hash of their text, and are dealt over many ranges like those of any other id with
many rows. Columns beyond id and text are not returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkgauge.llm.common import HOT_SHARE, column, stored

WIDE = 8
SIGNS = 64
LANES = WIDE + 1 + SIGNS
#: Bytes of text in a range of ids, and the most ranges.
RANGE_BYTES = 8 << 20
#: Bytes of text that a task holds, about.
TASK_BYTES = 64 << 20
MOST_RANGES = 1 << 16
_PAIR = (1 << 32) + 1
_LOW = (1 << 32) - 1


def units(text: Column) -> Column:
    """Array of (paragraph hash parts, sentence hash): one element for each paragraph and one for each sentence."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    paragraphs = F.transform(lines, lambda x: F.struct(x.alias("unit"), F.lit(True).alias("whole")))
    sentences = F.filter(F.split(text, "\n|(?<=[.!?]) "), lambda x: x != "")
    return F.concat(paragraphs, F.transform(sentences, lambda x: F.struct(x.alias("unit"), F.lit(False).alias("whole"))))


def vector_sums(unit: str, whole: str) -> list[Column]:
    """Aggregates that add up the vectors of exploded units; sign lanes go in pairs of 32 bits in one number."""
    sums = []
    for seed in range(WIDE // 2):
        h = F.when(F.col(whole), F.xxhash64(F.lit(seed), F.col(unit)))
        sums += [F.sum(h.bitwiseAND(F.lit(_LOW))), F.sum(F.shiftrightunsigned(h, 32))]
    h = F.when(~F.col(whole), F.xxhash64(F.col(unit)))
    sums.append(F.count(h))
    sums += [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_PAIR))) for i in range(SIGNS // 2)]
    return sums


def _lanes(sums: list[Column]) -> Column:
    """The vector as an array of longs, each within its modulus."""
    sums = [F.coalesce(s, F.lit(0).cast("long")) for s in sums]
    wide = [s.bitwiseAND(F.lit(_LOW)) for s in sums[:WIDE]]
    pairs = [x.bitwiseAND(F.lit(0xFFFF)) for s in sums[WIDE + 1:] for x in (s, F.shiftrightunsigned(s, 32))]
    return F.array(*wide, sums[WIDE].bitwiseAND(F.lit(0xFFFF)), *pairs)


def _modulus(i: Column) -> Column:
    return F.when(i < WIDE, F.lit(_LOW)).otherwise(F.lit(0xFFFF))


def insert_paragraphs(vector: Column, added: Column) -> Column:
    """The vector of a document after the paragraphs with vector ``added`` came in."""
    return F.transform(F.arrays_zip(vector.alias("a"), added.alias("b")), lambda x, i: (x["a"] + x["b"]).bitwiseAND(_modulus(i)))


def delete_paragraphs(vector: Column, removed: Column) -> Column:
    """The vector of a document after the paragraphs with vector ``removed`` went out."""
    return F.transform(F.arrays_zip(vector.alias("a"), removed.alias("b")), lambda x, i: (x["a"] - x["b"]).bitwiseAND(_modulus(i)))


def as_text(vector: Column) -> Column:
    """Hexadecimal digits of all lanes."""
    return F.lower(F.array_join(F.transform(vector, lambda x, i: F.when(i < WIDE, F.lpad(F.hex(x), 8, "0")).otherwise(F.lpad(F.hex(x), 4, "0"))), ""))


def _signs(vector: Column) -> Column:
    n = F.element_at(vector, WIDE + 1)
    centred = lambda x: F.when(x >= 1 << 15, x - (1 << 16)).otherwise(x)
    return F.transform(F.slice(vector, WIDE + 2, SIGNS), lambda c: centred((2 * c - n).bitwiseAND(F.lit(0xFFFF))).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of sentences in common, 0 to 1; 1 for equal vectors."""
    squares = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    apart = squares(F.zip_with(_signs(a), _signs(b), lambda x, y: x - y))
    both = squares(_signs(a)) + squares(_signs(b))
    return F.when(a == b, 1.0).when(both == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / both))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, vector) for each row; equal texts have equal vectors."""
    rows = docs.select(column(doc_id).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    exploded = numbered.select("doc_id", "row", F.explode_outer(units(F.col("text"))).alias("u")).select("doc_id", "row", "u.*")
    sums = [s.alias(f"s{i}") for i, s in enumerate(vector_sums("unit", "whole"))]
    return exploded.groupBy("row", "doc_id").agg(*sums).select("doc_id", _lanes([F.col(f"s{i}") for i in range(len(sums))]).alias("vector"))


def _below(cuts: list, value: Column) -> Column:
    """How many of the ascending cuts are less than the value: first by every ``step``-th, then among one step's."""
    step = max(1, math.isqrt(len(cuts)))
    every, all_ = F.array(*map(F.lit, cuts[step - 1::step])), F.array(*map(F.lit, cuts))
    passed = F.size(F.filter(every, lambda c: c < value)) * step
    return passed + F.size(F.filter(F.slice(all_, passed + 1, step), lambda c: c < value))


def _hot_ids(rows: DataFrame, ranges: int, total: int) -> DataFrame:
    """(hot_id, parts, ties): ids, null too, that are due several ranges and have one in ``HOT_SHARE`` rows, so at most that many; and of their texts those with as many."""
    due = F.ceil(F.col("n") / total * ranges).cast("long")
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HOT_SHARE >= total)
    ids = stored(ids.select(F.col("doc_id").alias("hot_id"), due.alias("parts")).filter("parts > 1"), "hot-ids")
    texts = rows.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("hot_id"))).groupBy("hot_id", "tie").agg(F.count(F.lit(1)).alias("n"))
    texts = texts.filter(F.col("n") * HOT_SHARE >= total).groupBy("hot_id").agg(F.array_sort(F.collect_list(F.struct("tie", due.alias("parts")))).alias("ties"))
    joined = ids.join(texts.withColumnRenamed("hot_id", "same"), F.col("hot_id").eqNullSafe(F.col("same")), "left")
    return stored(joined.select("hot_id", "parts", F.coalesce("ties", F.array().cast("array<struct<tie: bigint, parts: bigint>>")).alias("ties")), "hot-rows")


def _in_ranges(rows: DataFrame) -> DataFrame:
    """Rows with ``range``, a number that rises with the order (id descending, nulls last, then ``tie``); a range has a bounded share of the rows.

    Its parts, from the top: a stretch of ids; for an id with many rows, a stretch of ``tie``; for a text that one id has
    many times, what lies before, at and behind it, and a share of the equal rows.
    """
    told = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    ranges = min(MOST_RANGES, max(1, math.ceil((told["bytes"] or 0) / RANGE_BYTES)))
    if ranges == 1:
        return rows.withColumn("range", F.lit(0).cast("long"))
    shares = [(i + 1) / ranges for i in range(ranges - 1)]
    hot = _hot_ids(rows, ranges, told["n"])
    found = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 10 * MOST_RANGES)).first()[0] or []
    # An id with ranges of its own begins a stretch; the other ids of the stretch come behind it.
    cuts = sorted({*found, *[r["hot_id"] for r in hot.select("hot_id").filter("hot_id is not null").collect()]})
    stretch = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - _below(cuts, F.col("doc_id")) if cuts else F.lit(0))
    met = rows.join(F.broadcast(hot), F.col("doc_id").eqNullSafe(F.col("hot_id")), "left")
    share = F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(-(1 << 63))), 33)  # rises with tie, below 2^31
    by_tie = F.coalesce(F.shiftright(share * F.col("parts"), 31), F.lit((1 << 17) - 1).cast("long"))
    same = F.get(F.filter("ties", lambda t: t["tie"] == F.col("tie")), F.lit(0))
    around = F.coalesce(2 * F.size(F.filter("ties", lambda t: t["tie"] < F.col("tie"))) + same.isNotNull().cast("int"), F.lit(0))
    equal = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), same["parts"]), F.lit(0).cast("long"))
    number = F.shiftleft(stretch.cast("long"), 46) + F.shiftleft(by_tie, 29) + F.shiftleft(around.cast("long"), 17) + equal
    ranged = met.withColumn("range", number).drop("hot_id", "parts", "ties")
    # All later steps keep this partitioning; more partitions than usual where theirs would hold too much text each.
    tasks = ranges * RANGE_BYTES // TASK_BYTES
    return ranged.repartition(tasks, "range") if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ranged


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's text.

    The next document is the one with the next smaller id (after the last: the first;
    nulls last, ties by a hash of the text); the edit replaces the last half of the
    code points by as many of the next text's first. Texts move once, to their range
    of ids; all later steps keep that partitioning, and only the first text of each
    range is looked up from the range before.
    """
    rows = docs.select(column(doc_id).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    ranged = _in_ranges(rows.withColumn("tie", F.xxhash64("text")))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    in_range = Window.partitionBy("range").orderBy(*order)
    placed = ranged.withColumns({"next_text": F.lead("text").over(in_range), "place": F.row_number().over(in_range)})
    # The first text of the next range that has rows; at most MOST_RANGES rows in all.
    best = F.struct(F.col("doc_id").isNull().cast("int"), F.negative(F.try_subtract("doc_id", F.lit(1))), "tie")
    heads = stored(ranged.groupBy("range").agg(F.min_by("text", best).alias("head_text")), "range-heads")
    numbers = [r[0] for r in heads.select("range").orderBy("range").collect()]
    if not numbers:
        follow = heads.select("range", "head_text")
    else:
        after = dict(zip(numbers, [*numbers[1:], numbers[0]]))
        pairs = docs.sparkSession.createDataFrame([(b, a) for a, b in after.items()], "range long, before long")
        follow = heads.join(F.broadcast(pairs), "range").select(F.col("before").alias("range"), "head_text")
    joined = placed.join(follow, "range", "left").withColumn("next_text", F.coalesce("next_text", "head_text", F.lit("")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    both = joined.select("range", "place", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = both.select("range", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")),
                                         F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("w"))
    exploded = both.select("range", "place", "doc_id", "n_chars", "edited_sha256", F.col("w.which").alias("which"),
                           F.explode_outer(units(F.col("w.t"))).alias("u"))
    exploded = exploded.select("range", "place", "doc_id", "n_chars", "edited_sha256", "which", "u.*")
    keys = ["range", "place", "doc_id", "n_chars", "edited_sha256"]
    sums = [s.alias(f"s{i}") for i, s in enumerate(vector_sums("unit", "whole"))]
    vectors = exploded.groupBy(*keys, "which").agg(*sums).select(*keys, "which", _lanes([F.col(f"s{i}") for i in range(len(sums))]).alias("v"))
    paired = vectors.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("v"))).alias("vector"),
                                        F.max(F.when(F.col("which") == 1, F.col("v"))).alias("edited_vector"))
    result = stored(paired, "vectors")
    by_place = Window.partitionBy("range").orderBy("place")
    first = result.filter("place = 1").select("range", F.col("vector").alias("head_vector"))
    if numbers:
        first = first.join(F.broadcast(pairs), "range").select(F.col("before").alias("range"), "head_vector")
    met = result.withColumn("next_vector", F.lead("vector").over(by_place)).join(first, "range", "left")
    return met.withColumn("next_vector", F.coalesce("next_vector", "head_vector")).select(
        "doc_id", "n_chars", "edited_sha256", "vector", "edited_vector", "next_vector")
