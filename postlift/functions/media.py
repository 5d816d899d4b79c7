"""Frame-sampling and crop geometry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import SETTINGS


def frame_positions(n_frames: Column, samples: int = SETTINGS.num_frames) -> Column:
    """``samples`` evenly spaced, truncated positions over 0..n-1."""
    steps = F.sequence(F.lit(0), F.lit(samples - 1))
    last = n_frames.cast("bigint") - 1
    return F.transform(steps, lambda i: F.floor(i * last / F.lit(float(samples - 1))))


def middle_frame(n_frames: Column) -> Column:
    return F.floor(n_frames / 2)


def crop_plan(width: Column, height: Column, target_w: int = SETTINGS.target_width,
              target_h: int = SETTINGS.target_height) -> Column:
    """Scale to cover the target, then crop the centre; untouched if already sized."""
    scale = F.greatest(F.lit(float(target_w)) / width, F.lit(float(target_h)) / height)
    new_w = F.floor(width * scale)
    new_h = F.floor(height * scale)
    return F.struct(
        new_w.alias("new_w"), new_h.alias("new_h"),
        F.floor((new_w - target_w) / 2).alias("x1"),
        F.floor((new_h - target_h) / 2).alias("y1"),
        ((width == target_w) & (height == target_h)).alias("noop"))
