"""Caption, hashtag and label-text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def caption_length(col: Column) -> Column:
    return F.length(F.coalesce(col, F.lit("")))


def caption_head(col: Column, width: int = 80) -> Column:
    return F.substring(F.coalesce(col, F.lit("")), 1, width)


def hashtag_count(col: Column) -> Column:
    """JSON list: its length; other text: non-blank comma parts; null: 0."""
    parts = F.size(F.filter(F.split(col, ","), lambda part: F.trim(part) != ""))
    return F.when(col.isNull(), 0).otherwise(F.coalesce(F.json_array_length(col), parts))


def hashtag_list_count(col: Column) -> Column:
    """Count for a column that already holds an array."""
    return F.when(col.isNull(), 0).otherwise(F.size(col))


def text_template(title: Column, track: Column, artist: Column, challenges: Column,
                  objects: Column, city: Column, place: Column) -> Column:
    """One model input line.  Section markers and the spelling of a missing value are fixed."""
    def said(col: Column) -> Column:
        return F.coalesce(col.cast("string"), F.lit("None"))

    return F.concat(
        F.lit("[CLS] [TITLE] "), said(title),
        F.lit(" [MUSIC] "), said(track), F.lit(" by "), said(artist),
        F.lit(" [CHALLENGES] "), said(challenges),
        F.lit(" [OBJECTS] "), said(objects),
        F.lit(" [LOC] "), said(city), F.lit(" "), said(place))


def short_count(col: Column) -> Column:
    """1234567 -> 1.2M, 1234 -> 1K, 999 -> 999 (for axis labels).

    Millions are rounded by the binary value (1150000 is a little less than 1.15
    million as a double, hence 1.1M), which ``format_number`` does and ``round`` does
    not; thousands end in an exact half, where ``bround`` takes the even one.
    """
    whole = col.cast("bigint")
    millions = F.replace(F.format_number(whole / 1e6, 1), F.lit(","), F.lit(""))
    return (F.when(whole >= 1_000_000, F.concat(millions, F.lit("M")))
            .when(whole >= 1_000, F.concat(F.bround(whole / 1e3, 0).cast("bigint"), F.lit("K")))
            .otherwise(whole.cast("string")))
