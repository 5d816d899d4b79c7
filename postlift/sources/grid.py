"""Parameter grids: every combination of the listed options."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

# The temporal grid's option lists (months, months, years, months).
TEMPORAL_GRID = {
    "feature_window": (12,),
    "update_freq": (6,),
    "max_history_years": (5,),
    "h": (3,),
}


@dataclass(frozen=True)
class TemporalSpec:
    """One combination; calendar offsets are whole months, dates are month indexes."""

    label_start: int
    label_end: int
    feature_window: int = 12
    update_freq: int = 6
    max_history_months: int = 60
    h: int = 3


def combinations(options: dict[str, tuple]) -> list[dict]:
    """All combinations in listing order (a few driver-side settings, not data)."""
    return [dict(zip(options, values)) for values in itertools.product(*options.values())]


def temporal_specs(label_starts, label_ends, options=TEMPORAL_GRID) -> list[TemporalSpec]:
    return [TemporalSpec(start, end, combo["feature_window"], combo["update_freq"],
                         combo["max_history_years"] * 12, combo["h"])
            for start, end in itertools.product(label_starts, label_ends)
            for combo in combinations(options)]


def with_options(df: DataFrame, options: dict[str, tuple]) -> DataFrame:
    """Repeat each row for every combination; the factor is the grid's fixed size."""
    grid = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in combo.items()])
                     for combo in combinations(options)])
    return df.withColumn("_combo", F.explode(grid)).select(*df.columns, "_combo.*")


def grid_table(spark: SparkSession, options: dict[str, tuple]) -> DataFrame:
    """The model guide: one numbered row per combination."""
    rows = [(i, *combo.values()) for i, combo in enumerate(combinations(options))]
    return spark.createDataFrame(rows, ["model_no", *options])
