"""The 19 tabular model inputs as columns and as one vector."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..config import FEATURE_NAMES
from .scores import log_count


def number_or(col: Column, default: float = 0.0) -> Column:
    """Double; null and 0 both become ``default``."""
    value = col.cast("double")
    return F.coalesce(F.when(value != 0, value), F.lit(default))


def flag(col: Column) -> Column:
    return F.coalesce(col.cast("boolean"), F.lit(False)).cast("double")


def cyclic(col: Column, period: int) -> tuple[Column, Column]:
    angle = F.coalesce(col.cast("double"), F.lit(0.0)) * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def feature_columns() -> list[Column]:
    """Named feature columns over a frame with the curated table's column names."""
    c = F.col
    sin_hour, cos_hour = cyclic(c("hour_of_day"), 24)
    sin_day, cos_day = cyclic(c("day_of_week"), 7)
    values = [
        log_count(c("author_follower_count")),
        log_count(c("author_following_count")),
        log_count(c("author_total_heart_count")),
        log_count(c("author_video_count")),
        log_count(c("author_friend_count")),
        number_or(c("duration")),
        number_or(c("width")),
        number_or(c("height")),
        number_or(c("aspect_ratio"), 1.0),
        number_or(c("vq_score")),
        flag(c("user_verified")),
        flag(c("is_private")),
        flag(c("is_ad")),
        flag(c("share_enabled")),
        flag(c("stitch_enabled")),
        sin_hour, cos_hour, sin_day, cos_day,
    ]
    assert len(values) == len(FEATURE_NAMES)
    return [value.alias(f"f{i:02d}") for i, value in enumerate(values, 1)]


FEATURE_SLOTS = [f"f{i:02d}" for i in range(1, len(FEATURE_NAMES) + 1)]


def with_features(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *feature_columns())


def feature_vector(slots=FEATURE_SLOTS) -> Column:
    """The ordered feature array; its width is part of the contract."""
    if len(slots) != len(FEATURE_NAMES):
        raise ValueError(f"expected {len(FEATURE_NAMES)} features, got {len(slots)}")
    return F.array(*slots)
