"""Dates in free form: a small token grammar in column expressions.

A text is read as a clock, an offset behind it and a date, in any of these forms:

- clock: ``h:mm``, ``h:mm:ss`` with a fraction, either with am or pm, ``h am``, or six or four digits behind a ``T``;
- offset: ``Z``, ``UTC``, ``GMT``, ``+hh``, ``+hhmm`` or ``+hh:mm`` behind the clock; none means UTC;
- date: year first (``2024-1-5``, ``2024/01/05``, ``20240105``), month names or their beginnings with the day
  before or behind and an ordinal's ending (``5th of January 2024``, ``Jan. 5, 2024``, ``2024-Jan-05``), or three
  numbers, month first unless that cannot be or ``day_first`` is asked for.

Names of weekdays and commas say nothing.  Years of two digits lie in 1969 to 2068.  A
text without a whole date, or with anything else in it, gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Names of the months and of the days.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

# Groups: hour, minute, second | hour | hour, minute, second; half of the day; sign, hours and minutes of the offset.
_CLOCK = (r"(?:(?:^|[\st])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?|(?:^|\s)(\d{1,2})(?=\s*[ap]\.?m)"
          r"|(?<=\d)t(\d{2})(\d{2})(\d{2})?)\s*(am|pm|a\.m\.|p\.m\.)?"
          r"\s*(?:z|utc|gmt)?\s*(?:([+-])(\d{2}):?(\d{2})?)?\s*$")
_MONTH = r"([a-z]{3,9})\.?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_GAP = r"[\s\-/.]*"


def _prefixes(names: tuple[str, ...]) -> str:
    """A pattern of all beginnings of three letters or more, whole names first."""
    return "|".join(n[:k] for n in names for k in range(len(n), 2, -1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def parse_free_time(col: Column, day_first: bool = False) -> Column:
    """UTC wall-clock timestamp of a date in free form, whole seconds; null where it cannot be read."""
    text = F.trim(F.regexp_replace(F.lower(col.cast("string")), r"[\s,]+", " "))
    return _let(text, lambda t: _let(_clock(t), lambda clock: _let(
        _date(F.trim(F.regexp_replace(F.regexp_replace(t, _CLOCK, ""), rf"(^|\s)(?:{_prefixes(DAYS)})\.?(?=\s|$)", " ")),
              day_first), lambda date: _stamp(clock, date))))


def _clock(text: Column) -> Column:
    """Parts of the clock and the offset as texts, empty where they are missing."""
    def group(*numbers: int) -> Column:
        # At most one of the groups has matched.
        return F.concat(*[F.regexp_extract(text, _CLOCK, k) for k in numbers])

    return F.struct(group(1, 4, 5).alias("hour"), group(2, 6).alias("minute"), group(3, 7).alias("second"),
                    F.substring(group(8), 1, 1).alias("half"), group(9).alias("sign"),
                    group(10).alias("off_hour"), group(11).alias("off_minute"))


def _stamp(clock: Column, date: Column) -> Column:
    def number(name: str) -> Column:
        return F.coalesce(clock[name].try_cast("int"), F.lit(0))

    hour, half, year = number("hour"), clock["half"], date["year"]
    hour = (F.when((half != "") & ~hour.between(1, 12), None).when(half == "p", hour % 12 + 12)
            .when(half == "a", hour % 12).otherwise(hour))
    year = F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(year)
    stamp = F.try_make_timestamp_ntz(year, date["month"], date["day"], hour, number("minute"),
                                     number("second").cast("decimal(8,6)"))
    ahead = F.when(clock["sign"] == "-", -1).otherwise(1) * (number("off_hour") * 60 + number("off_minute"))
    return stamp - F.make_dt_interval(mins=ahead)


def _date(text: Column, day_first: bool) -> Column:
    """(year, month, day) of the text that is left without clock and weekday; null if it is no date."""
    return _let(text, lambda date: _forms(date, day_first))


def _forms(date: Column, day_first: bool) -> Column:
    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(date, pattern, group).try_cast("int")

    def month(pattern: str, group: int) -> Column:
        name = F.regexp_extract(date, pattern, group)
        known = F.regexp_like(name, F.lit(f"^(?:{_prefixes(MONTHS)}|sept)$"))
        return F.when(known, F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(name, 1, 3))
                      .cast("int"))

    def parts(year: Column, month_: Column, day: Column) -> Column:
        return F.struct(year.alias("year"), month_.alias("month"), day.alias("day"))

    out = F.lit(None).cast("struct<year:int,month:int,day:int>")
    for pattern, y, m, d, named in (
            (r"^(\d{4})[\s\-/.](\d{1,2})[\s\-/.](\d{1,2})$", 1, 2, 3, False),
            (r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3, False),
            (rf"^{_DAY}{_GAP}(?:of )?{_MONTH}{_GAP}(\d{{4}}|\d{{2}})$", 3, 2, 1, True),
            (rf"^{_MONTH}{_GAP}{_DAY}[\s\-/.]+(\d{{4}})$", 3, 1, 2, True),
            (rf"^(\d{{4}}){_GAP}{_MONTH}{_GAP}{_DAY}$", 1, 2, 3, True)):
        found = parts(number(pattern, y), (month if named else number)(pattern, m), number(pattern, d))
        out = F.when(F.regexp_like(date, F.lit(pattern)), found).otherwise(out)
    pattern = r"^(\d{1,2})[\-/.](\d{1,2})[\-/.](\d{4}|\d{2})$"
    one, two, year = (number(pattern, k) for k in (1, 2, 3))
    turned = two <= 12 if day_first else one > 12
    found = parts(year, F.when(turned, two).otherwise(one), F.when(turned, one).otherwise(two))
    return F.when(F.regexp_like(date, F.lit(pattern)), found).otherwise(out)
