"""Random and time-ordered splits, seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SETTINGS
from .ranking import rank_ranges, seeded_hash, store_ranges


def random_split(df: DataFrame, key: str = "id", seed: int = SETTINGS.seed,
                 train_tenths: int = SETTINGS.train_tenths, out: str = "split") -> DataFrame:
    """Mark rows train or test by a seeded hash of the key: no shuffle, and stable
    under retries, repartitioning and added rows."""
    digits = F.conv(F.substring(seeded_hash(F.col(key), seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(out, F.when(digits % 10 < train_tenths, "train").otherwise("test"))


def sample_rows(df: DataFrame, n: int, key: str = "id", seed: int = SETTINGS.seed) -> DataFrame:
    """Uniform sample of ``n`` rows without replacement (a top-k heap per task)."""
    return df.orderBy(seeded_hash(F.col(key), seed), key).limit(n)


def random_row(df: DataFrame, key: str = "id", seed: int = SETTINGS.seed) -> DataFrame:
    return sample_rows(df, 1, key, seed)


def fold_edges(n: int, train_fractions=SETTINGS.train_fractions,
               val_fraction: float = SETTINGS.val_fraction) -> list[tuple[int, int, int]]:
    """(fold, train end, validation end) as rank positions; empty folds are skipped."""
    edges = []
    for fold, fraction in enumerate(train_fractions, 1):
        train_end = int(n * fraction)
        val_end = min(n, train_end + int(n * val_fraction))
        if train_end > 0 and val_end > train_end:
            edges.append((fold, train_end, val_end))
    return edges


def time_folds(df: DataFrame, time: str = "create_time", key: str = "id",
               train_fractions=SETTINGS.train_fractions,
               val_fraction: float = SETTINGS.val_fraction) -> DataFrame:
    """Rows of every expanding-window fold: ``df`` columns, fold, part (train/val).

    Each row appears once per fold it belongs to, at most once per fraction.
    """
    stored = store_ranges(df, [time, key])
    edges = fold_edges(stored.count(), train_fractions, val_fraction)
    if not edges:
        empty = df.limit(0)
        return empty.withColumn("fold", F.lit(0)).withColumn("part", F.lit("train"))
    ranked, rank = rank_ranges(stored, [time, key]), F.col("rank")
    parts = F.array(*[
        F.struct(F.lit(fold).alias("fold"),
                 F.when(rank < train_end, "train").when(rank < val_end, "val").alias("part"))
        for fold, train_end, val_end in edges])
    return (ranked.withColumn("_f", F.explode(parts))
            .select(*df.columns, "_f.fold", "_f.part").where("part is not null"))
