"""Column functions over single cells: missing markers, casts, text and header tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

INFINITIES = (float("inf"), float("-inf"))

# The literal pairs that make a two-valued column boolean.
BOOLEAN_SETS = (
    ("0", "1"),
    ("0.0", "1.0"),
    ("false", "true"),
    ("f", "t"),
    ("no", "yes"),
    ("n", "y"),
)

NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

# Shape of the text and the pattern that parses it. Bare years are left out on purpose.
DATE_FORMATS: tuple[tuple[str, str | None], ...] = (
    (r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$", None),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)

# What every shape above starts with; other text is turned away by this one test.
DATE_START = r"^\s*(\d{1,4}[-/]|[A-Za-z]{3} \d)"

LONG_NAME_LIMIT = 100


def col_of(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def inf_to_null(c: Column) -> Column:
    return F.when(~c.isin(*INFINITIES), c)


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & ~c.isin(*INFINITIES), c)


def is_infinite(c: Column) -> Column:
    return c.isin(*INFINITIES)


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def to_text(c: Column) -> Column:
    return c.cast("string")


def to_timestamp(c: Column, formats: Sequence[tuple[str, str | None]] = DATE_FORMATS) -> Column:
    """Text to timestamp by a list of (shape, pattern); other text becomes null."""
    text = F.when(c.rlike(DATE_START), F.trim(c))
    parsed = [
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text))
        for shape, pattern in formats
    ]
    return F.coalesce(*parsed)


def is_datetime_text(c: Column) -> Column:
    """Aggregate: true when there is a value and every value parses as a date."""
    return (F.count(c) > 0) & (F.count(to_timestamp(c)) == F.count(c))


def norm_text(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def in_boolean_set(low: Column, high: Column) -> Column:
    """Whether the two extreme normalised values of a two-valued column form a boolean pair."""
    fits = [low.isin(*pair) & high.isin(*pair) for pair in BOOLEAN_SETS]
    test = fits[0]
    for fit in fits[1:]:
        test = test | fit
    return F.coalesce(test, F.lit(False))


def boolean_mask(c: Column) -> Column:
    """Bit of the boolean pair a value belongs to, 0 for other values."""
    text = norm_text(c)
    mask = F.lit(0)
    for bit, pair in enumerate(BOOLEAN_SETS):
        mask = F.when(text.isin(*pair), 1 << bit).otherwise(mask)
    return mask


def has_letter_or_digit(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


def is_blank_header(c: Column) -> Column:
    return (
        c.isNull()
        | (F.trim(c) == "")
        | c.startswith("Unnamed:")
        | (F.lower(c) == "nan")
    )


def is_blank(c: Column) -> Column:
    """A present string that is empty once white space is cut off."""
    return c.rlike(r"^\s*$")


def contains_any(c: Column, words: Sequence[str]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | F.lower(c).contains(word)
    return test


def is_long_name(c: Column, limit: int = LONG_NAME_LIMIT) -> Column:
    return F.char_length(c) > limit


def percent_from_text(c: Column) -> Column:
    """First ``(12.5%)`` of a message as a number."""
    found = F.regexp_extract(c, r"\((\d+\.?\d*)%\)", 1)
    return F.when(found != "", found.cast("double"))


def report_filename(base: Column, report_type: str, stamp: Column, extension: str) -> Column:
    """Cleaned base name, report type, minute stamp and extension joined to a file name."""
    clean = F.replace(F.replace(base, F.lit(" "), F.lit("_")), F.lit(","), F.lit(""))
    when = F.date_format(stamp, "yyyy-MM-dd_HH-mm")
    parts = [clean, F.lit("Report"), when]
    if extension != "json":
        parts.insert(1, F.lit(report_type.title()))
    suffix = {"markdown": "md"}.get(extension, extension)
    return F.concat(F.concat_ws("_", *parts), F.lit(f".{suffix}"))


def sqrt_bins(n: Column, distinct: Column | None = None) -> Column:
    """Histogram bin count: square root of n between 5 and 15, no more than the distinct values."""
    bins = F.least(F.lit(15), F.greatest(F.lit(5), F.floor(F.sqrt(n)).cast("int")))
    if distinct is not None:
        bins = F.least(bins, distinct.cast("int"))
    return F.greatest(F.lit(1), bins)


def one_decimal(c: Column) -> Column:
    """One decimal as plain text, without an exponent for large numbers."""
    return F.round(c, 1).cast("decimal(38,1)").cast("string")


def plain(c: Column, digits: int) -> Column:
    """A rounded number as text the way messages show it: no exponent, no padding zeros."""
    text = F.round(c, digits).cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(text, r"(\.\d+?)0+$", "$1") if digits > 1 else text


def day_span(ts: Column) -> Column:
    """Aggregate: whole days between the first and last moment."""
    seconds = F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))
    return F.floor(seconds / F.lit(86_400_000_000)).cast("long")


def period_start(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("date")


def period_label(ts: Column, unit: str) -> Column:
    """``2024-03`` for months, ``2024-03-04/2024-03-10`` for weeks, ``2024-03-04`` for days."""
    start = period_start(ts, unit)
    if unit == "month":
        return F.date_format(start, "yyyy-MM")
    if unit == "week":
        return F.concat_ws("/", F.date_format(start, "yyyy-MM-dd"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))
    return F.date_format(start, "yyyy-MM-dd")
