"""Tail labels: global, per cohort, and with statistics of the training rows only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LABEL_TABLE_COLUMNS, SETTINGS
from ..functions import clean, scores, text
from ..session import materialize
from .compose import keep_present
from .quantiles import exact_quantiles, hinted

# Scores and thresholds are compared at this many decimals, so that the last
# floating-point digit of an interpolated quantile cannot decide a label.
_DECIMALS = 9


@dataclass(frozen=True)
class TailStats:
    """Three numbers that define a global label."""

    max_engagement: float | None
    max_velocity: float | None
    threshold: float | None


def combined_score(engagement: Column, velocity: Column, max_e, max_v) -> Column:
    """Sum of both max-normalised scores; null when a maximum is zero."""
    def top(value):
        return value if isinstance(value, Column) else F.lit(value).cast("double")

    total = F.try_divide(engagement, top(max_e)) + F.try_divide(velocity, top(max_v))
    return F.round(total, _DECIMALS)


def tail_stats(df: DataFrame, p: float = SETTINGS.tail_quantile,
               engagement: str = "engagement_score", velocity: str = "view_velocity_score"
               ) -> TailStats:
    """Maxima and the exact quantile of the combined score.

    Each step returns one row of numbers, which become constants of the next
    plan; no table is joined just to carry a scalar.  The frame is read several
    times, so pass a stored one if it is costly.
    """
    top = df.agg(F.max(engagement).alias("e"), F.max(velocity).alias("v")).first()
    score = combined_score(F.col(engagement), F.col(velocity), top["e"], top["v"])
    found = exact_quantiles(df, score, [p]).select(F.round(F.col("q")[0], _DECIMALS)).first()
    return TailStats(top["e"], top["v"], found[0] if found else None)


def label_tail(df: DataFrame, stats: TailStats, engagement: str = "engagement_score",
               velocity: str = "view_velocity_score", label: str = "is_tail") -> DataFrame:
    """1 where the combined score reaches the threshold, else 0."""
    score = combined_score(F.col(engagement), F.col(velocity),
                           stats.max_engagement, stats.max_velocity)
    hit = score >= F.lit(stats.threshold).cast("double")
    return df.withColumn(label, F.when(hit, 1).otherwise(0).cast("bigint"))


def regression_rule(df: DataFrame, stats: TailStats, log_engagement: str, log_velocity: str,
                    out: str = "prediction") -> DataFrame:
    """Class from two predicted log-scale scores, by the training rows' rule."""
    undone = (df.withColumn("_e", scores.untransform(F.col(log_engagement)))
              .withColumn("_v", scores.untransform(F.col(log_velocity))))
    return label_tail(undone, stats, "_e", "_v", out).drop("_e", "_v")


def cohort_thresholds(df: DataFrame, value: str, cohort: str = "cohort_month",
                      p: float = SETTINGS.tail_quantile) -> DataFrame:
    """(cohort, n, threshold)."""
    found = exact_quantiles(df, F.col(value), [p], by=(cohort,))
    return found.select(cohort, "n", F.round(F.col("q")[0], _DECIMALS).alias("threshold"))


def label_cohorts(df: DataFrame, value: str, cohort: str = "cohort_month", label: str = "tail",
                  p: float = SETTINGS.tail_quantile) -> DataFrame:
    """1 where the value reaches its cohort's quantile.

    The thresholds are broadcast where cohorts are counted to be few, as months are; else
    rows and thresholds meet in a shuffle.
    """
    thresholds = materialize(cohort_thresholds(df, value, cohort, p).select(cohort, "threshold"), "thresholds")
    joined = df.join(hinted(thresholds), cohort)
    reached = F.round(F.col(value).cast("double"), _DECIMALS) >= F.col("threshold")
    return joined.withColumn(label, reached.cast("int")).drop("threshold")


def label_rate(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def engineer_flat(raw: DataFrame) -> DataFrame:
    """Flat features of raw posts; rows without a usable creation time or play count go."""
    def column(name):
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    def number(name):
        return clean.zero_if_missing(clean.number_in(raw, name))

    created_s = clean.number_in(raw, "create_time")
    created = clean.epoch_to_ntz(created_s)
    numbers = {name: number(name)
               for name in ("digg_count", "comment_count", "share_count", "play_count")}
    readable = column("play_count").isNotNull() & ~F.isnan(clean.number_in(raw, "play_count"))
    usable = raw.where(readable & (created_s > 0))
    return usable.select(
        *[c for c in ("id", "user_id") if c in raw.columns],
        clean.cohort_month(created).alias("cohort_month"),
        numbers["play_count"].alias("play_count"),
        number("duration").alias("duration"),
        number("vq_score").alias("vq_score"),
        clean.parse_flag_int(column("music_original")).alias("music_original"),
        clean.parse_flag_int(column("user_verified")).alias("user_verified"),
        text.hashtag_count(column("challenges")).alias("hashtag_count"),
        text.caption_length(column("desc")).alias("caption_length"),
        F.hour(created).alias("post_hour"),
        clean.weekday(created).alias("post_dow"),
        scores.interaction_ratio(numbers["digg_count"], numbers["comment_count"],
                                 numbers["share_count"], numbers["play_count"]
                                 ).alias("engage_ratio"),
    ).where("cohort_month is not null")


def label_table(raw: DataFrame) -> DataFrame:
    """Raw posts to the flat cohort-labelled table."""
    return keep_present(label_cohorts(engineer_flat(raw), "play_count"), LABEL_TABLE_COLUMNS)


def fold_tail_stats(folds: DataFrame, p: float = SETTINGS.tail_quantile,
                    engagement: str = "engagement_score", velocity: str = "view_velocity_score"
                    ) -> DataFrame:
    """Maxima and threshold per fold from its training rows: one row per fold."""
    train = folds.where("part = 'train'")
    tops = train.groupBy("fold").agg(F.max(engagement).alias("max_engagement"),
                                     F.max(velocity).alias("max_velocity"))
    judged = train.join(F.broadcast(tops), "fold")
    cuts = exact_quantiles(judged, _fold_score(engagement, velocity), [p], by=("fold",))
    return tops.join(cuts.select("fold", F.round(F.col("q")[0], _DECIMALS).alias("threshold")),
                     "fold")


def _fold_score(engagement: str, velocity: str) -> Column:
    return combined_score(F.col(engagement), F.col(velocity),
                          F.col("max_engagement"), F.col("max_velocity"))


def label_by_fold(rows: DataFrame, stats: DataFrame, engagement: str = "engagement_score",
                  velocity: str = "view_velocity_score", label: str = "is_tail") -> DataFrame:
    """Label rows by the statistics of their fold's training part."""
    joined = rows.join(F.broadcast(stats), "fold")
    hit = _fold_score(engagement, velocity) >= F.col("threshold")
    return joined.withColumn(label, F.when(hit, 1).otherwise(0).cast("bigint"))
