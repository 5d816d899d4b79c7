"""Quantile and fixed bins, and the distribution reports built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import SETTINGS
from ..functions import clean, text
from .quantiles import box_summary, exact_quantiles


def quantile_edges(df: DataFrame, value: str, q: int = 5) -> list[float]:
    """Distinct bin edges: exact quantiles at 0, 1/q .. 1 (a handful of numbers)."""
    found = exact_quantiles(df, F.col(value), [i / q for i in range(q + 1)]).first()
    return sorted({round(e, 9) for e in found["q"]}) if found else []


def bin_of(value: Column, edges) -> Column:
    """0-based bin with right-closed intervals, the lowest edge included; null outside."""
    value = F.round(value, 9)
    number = F.lit(0)
    for edge in edges[1:-1]:
        number = number + F.when(value > F.lit(float(edge)), 1).otherwise(0)
    return F.when((value >= F.lit(float(edges[0]))) & (value <= F.lit(float(edges[-1]))), number)


def cut(df: DataFrame, value: str, edges, out: str = "bin") -> DataFrame:
    """Attach the bin number and its edges; rows outside the edges go."""
    if len(edges) < 2:  # no rows, or one single value: there is no interval
        return df.limit(0).withColumns({out: F.lit(0), "lo": F.lit(0.0), "hi": F.lit(0.0)})
    low, high = edge_columns(edges, out)
    return (df.withColumn(out, bin_of(F.col(value), edges)).where(F.col(out).isNotNull())
            .withColumn("lo", low).withColumn("hi", high))


def edge_columns(edges, bin_column: str = "bin") -> tuple[Column, Column]:
    """Lower and upper edge of a row's bin."""
    ends = F.lit([float(e) for e in edges])
    return ends[F.col(bin_column)], ends[F.col(bin_column) + 1]


def quantile_cut(df: DataFrame, value: str, q: int = 5, out: str = "bin") -> DataFrame:
    return cut(df, value, quantile_edges(df, value, q), out)


def interval_label(low: Column, high: Column, joiner: str = "–", unit: str = "") -> Column:
    return F.concat(low, F.lit(joiner), high, F.lit(unit))


def hours_label(joiner: str):
    return lambda low, high: interval_label(whole_hours(low), whole_hours(high), joiner, "h")


def whole_hours(col: Column) -> Column:
    """Hours without decimals, ties to even."""
    return F.bround(col, 0).cast("bigint").cast("string")


def with_age_hours(df: DataFrame, create: str = "create_time", stats: str = "stats_time",
                   out: str = "delta_hours") -> DataFrame:
    seconds = clean.epoch_seconds(F.col(stats)) - clean.epoch_seconds(F.col(create))
    return df.withColumn(out, seconds / F.lit(3600.0))


def binned_report(df: DataFrame, value: str, edges, measures: list[str], label) -> DataFrame:
    """One row per (bin, measure): label and box summary; all measures share the passes.

    ``label`` turns the two edge columns into text, on the few summary rows only.
    """
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x"))
                       for m in measures])
    long = cut(df, value, edges).select("bin", F.explode(values).alias("m")).select("bin", "m.*")
    boxes = box_summary(long, "x", ("bin", "measure"))
    low, high = edge_columns(edges)
    return boxes.withColumn("label", label(low, high))


def account_size_report(posts: DataFrame) -> DataFrame:
    """Plays, raw and log10, by follower-count quintile."""
    kept = (posts.select("play_count", "author_follower_count")
            .where("play_count > 0 and author_follower_count > 0")
            .withColumn("log_play_count", F.log10("play_count")))
    return binned_report(
        kept, "author_follower_count", quantile_edges(kept, "author_follower_count"),
        ["play_count", "log_play_count"],
        lambda low, high: interval_label(text.short_count(low), text.short_count(high)))


def _aged(posts: DataFrame) -> DataFrame:
    aged = with_age_hours(posts.select("play_count", "create_time", "stats_time"))
    return aged.where("play_count > 0 and delta_hours is not null").drop(
        "create_time", "stats_time")


def age_report(posts: DataFrame) -> DataFrame:
    """Plays, raw and log10, by quintile of time since publication."""
    kept = (_aged(posts).where("delta_hours > 0")
            .withColumn("log_play_count", F.log10("play_count")))
    return binned_report(kept, "delta_hours", quantile_edges(kept, "delta_hours"),
                         ["play_count", "log_play_count"], hours_label("–"))


def velocity_report(posts: DataFrame) -> DataFrame:
    """Plays per hour, raw and log, by quintile of time since publication."""
    speed = F.col("play_count") / F.col("delta_hours")
    kept = (_aged(posts).where("delta_hours > 0")
            .withColumn("view_velocity_raw", speed)
            .withColumn("view_velocity_log", F.log1p(speed)))
    return binned_report(kept, "delta_hours", quantile_edges(kept, "delta_hours"),
                         ["view_velocity_raw", "view_velocity_log"], hours_label(" - "))


def recent_report(posts: DataFrame, edges=SETTINGS.recent_edges_hours) -> DataFrame:
    """Log plays per hour in fixed age bins of recent posts."""
    kept = _aged(posts).where(F.col("delta_hours").between(edges[0], edges[-1])).withColumn(
        "view_velocity", F.log1p(F.col("play_count") / F.col("delta_hours")))
    return binned_report(kept, "delta_hours", edges, ["view_velocity"], hours_label(" - "))
