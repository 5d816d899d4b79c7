"""Column expressions that turn dirty text and numbers into typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .dates import parse_free_time

# Seconds of 0001-01-01 and 9999-12-31 23:59:59, the calendar's ends.
_FIRST_SECOND = -62135596800
_LAST_SECOND = 253402300799

# Text layouts tried in order for free-form dates.
DATE_LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
)


def number_from_text(col: Column) -> Column:
    """Double for plain decimal text, null for anything else.

    Spark's cast also reads Java's "1d", "NaN" and hexadecimal floats; a look at
    the last character and for an x rules them out without a regular expression.
    """
    text = F.btrim(col.cast("string"), F.lit(" \t\n\r"))
    last = F.substring(text, -1, 1)
    plain = (last.between("0", "9") | (last == ".")) & ~F.contains(F.lower(text), F.lit("x"))
    return F.when(plain, text.try_cast("double"))


def number_in(df: DataFrame, name: str) -> Column:
    """A column as double: numeric ones as they are, text read as plain decimals,
    null where the column does not exist."""
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(None).cast("double")
    return number_from_text(F.col(name)) if kind == "string" else F.col(name).cast("double")


def zero_if_missing(value: Column) -> Column:
    """The double, or 0 for null and NaN."""
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))


def coerce_number(col: Column) -> Column:
    """Numeric value, 0 where missing or unreadable (NaN counts as missing)."""
    return zero_if_missing(number_from_text(col))


def epoch_to_ntz(seconds: Column) -> Column:
    """Wall-clock UTC timestamp for epoch seconds; null outside years 1-9999."""
    inside = seconds.between(F.lit(_FIRST_SECOND), F.lit(_LAST_SECOND))
    span = F.make_dt_interval(secs=F.when(inside, seconds).try_cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + span


def epoch_seconds(ts: Column) -> Column:
    """Whole epoch seconds of a UTC wall-clock timestamp (session clock is UTC)."""
    return F.unix_timestamp(ts)


def parse_epoch(col: Column, is_text: bool = True) -> Column:
    """Epoch-only reader: empty, zero numbers and unreadable text give null.

    The text "0" is a real instant while the number 0 means "missing".
    """
    value = number_from_text(col)
    if not is_text:
        value = F.when(value != 0, value)
    return epoch_to_ntz(value)


def parse_any_time(col: Column) -> Column:
    """General reader: numbers are epoch seconds, other text is tried against
    ``DATE_LAYOUTS`` and then read by the grammar of ``dates``; sub-second parts are
    dropped, failures give null.  Missing values are not tried against anything."""
    text = F.trim(col.cast("string"))
    number = number_from_text(text)
    read = [F.try_to_timestamp(text, F.lit(layout)) for layout in DATE_LAYOUTS]
    parsed = F.coalesce(F.date_trunc("second", F.coalesce(*read)).cast("timestamp_ntz"), parse_free_time(text))
    return F.when(number.isNotNull(), epoch_to_ntz(number.try_cast("bigint"))).when(text.isNotNull(), parsed)


def parse_flag(col: Column) -> Column:
    """Case-insensitive t/true/1; everything else, null included, is false."""
    return F.coalesce(F.lower(col.cast("string")).isin("t", "true", "1"), F.lit(False))


def parse_flag_int(col: Column) -> Column:
    """Exact spellings t, true, True, 1 give 1; everything else gives 0."""
    return F.when(col.cast("string").isin("t", "true", "True", "1"), 1).otherwise(0)


def whole_or_zero(col: Column) -> Column:
    """Identifier where missing means 0."""
    return F.coalesce(col.try_cast("bigint"), F.lit(0).cast("bigint"))


def whole_or_null(col: Column) -> Column:
    """Identifier where 0 and missing both mean null."""
    value = col.try_cast("bigint")
    return F.when(value != 0, value)


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def cohort_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_index(ts: Column) -> Column:
    """Months as one integer, so month distance is plain subtraction."""
    return F.year(ts) * 12 + F.month(ts)
