"""Engagement, velocity, ratios and the transforms of the training targets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import SETTINGS


def zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def engagement(shares: Column, saves: Column, comments: Column, likes: Column,
               plays: Column, settings=SETTINGS) -> Column:
    """Weighted interactions per play; the +1 keeps unplayed posts finite."""
    weighted = (zero(shares) * settings.weight_shares + zero(saves) * settings.weight_saves
                + zero(comments) * settings.weight_comments + zero(likes) * settings.weight_likes)
    return weighted.cast("double") / (zero(plays) + 1)


def age_hours_floored(create_s: Column, stats_s: Column) -> Column:
    """Age in hours, never below one second; a missing clock counts as one second."""
    seconds = F.greatest(F.lit(1), F.coalesce(stats_s - create_s, F.lit(0)))
    return seconds / F.lit(3600.0)


def view_velocity(plays: Column, create_s: Column, stats_s: Column) -> Column:
    """log(1 + plays per hour)."""
    return F.log1p(zero(plays) / age_hours_floored(create_s, stats_s))


def interaction_ratio(likes: Column, comments: Column, shares: Column, plays: Column) -> Column:
    """Unweighted interactions per play; leaks the outcome, so for baselines only."""
    return (likes + comments + shares) / (plays + 1)


def log_count(col: Column) -> Column:
    """log(1 + x) with null, NaN and negatives read as zero."""
    value = F.nanvl(F.coalesce(col.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.log1p(F.greatest(F.lit(0.0), value))


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def targets(engagement_score: Column, velocity_score: Column, label: Column) -> Column:
    """Three training targets: both scores on the log scale, then the label."""
    return F.array(log_count(engagement_score), log_count(velocity_score), label.cast("double"))


def untransform(col: Column) -> Column:
    return F.expm1(col)
