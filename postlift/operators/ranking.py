"""Ordered totals and ranks without a single-task sort.

Everything here is a two-level prefix sum: rows are cut into ordered cells, the
totals of the cells (few rows) are summed up first, and only then is each cell
sorted on its own task.
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

# Worker functions travel with their code, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def running_sums(df: DataFrame, cell: Column, order: list[Column], sums: dict[str, str],
                 by: tuple[str, ...] = (), inclusive: bool = True) -> DataFrame:
    """Add running totals over ``order`` inside each ``by`` group.

    ``cell`` must rise with ``order`` and take a bounded number of values; rows
    of one cell meet in one task, so choose it fine enough.  ``sums`` maps new
    column names to the columns summed; with ``inclusive=False`` a row's own
    value is left out.  ``df`` is read twice.
    """
    celled = df.withColumn("_cell", cell)
    totals = celled.groupBy(*by, "_cell").agg(*[
        F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(
        Window.unboundedPreceding, -1)
    # One row per cell: the bound on ``cell`` bounds this table and the window on it.
    offsets = totals.select(*by, "_cell", *[
        F.coalesce(F.sum(f"_t_{out}").over(earlier), F.lit(0)).alias(f"_o_{out}")
        for out in sums])
    last = Window.currentRow if inclusive else -1
    inside = (Window.partitionBy(*by, "_cell").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, last))
    joined = celled.join(offsets, [*by, "_cell"])
    return joined.select(*df.columns, *[
        (F.col(f"_o_{out}") + F.coalesce(F.sum(src).over(inside), F.lit(0))).alias(out)
        for out, src in sums.items()])


def hash_order(df: DataFrame, key: str, seed: int, rank: str = "rank",
               digits: int = 4) -> DataFrame:
    """0-based rank in a seeded pseudo-random order of a unique ``key``.

    The first ``digits`` hex digits of the hash are the cells: evenly filled by
    construction, 16**digits of them.
    """
    hashed = df.withColumn("_h", seeded_hash(F.col(key), seed)).withColumn("_one", F.lit(1))
    ranked = running_sums(hashed, F.substring("_h", 1, digits), [F.col("_h")],
                          {rank: "_one"}, inclusive=False)
    return ranked.drop("_h", "_one")


def seeded_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


# Multipliers and moduli (primes below 2**31) of the hash in ``permuted``, whose products fit 64 bits.
_A, _B, _P, _Q = 1_103_515_245, 48_271, 2_147_483_647, 2_147_483_629
_KEY, _ROUND, _SEED = 104_729, 1_299_709, 15_485_863


def permuted(rank: Column, n: int, key: Column | int, seed: int, rounds: int = 4) -> Column:
    """Where a keyed pseudo-random permutation of 0 … n-1 sends ``rank``; every key has its own.

    The numbers below a x b, the least such grid that holds n, are permuted by Feistel rounds:
    row and column in turn move on by a hash of the other.  A number sent beyond n - 1 is
    sent on until it falls below; fewer than a numbers lie beyond, so that is rare, and
    as many steps are allowed as can be needed (or, from n = 4,096 on, 16 steps, which are too
    few with a chance below 10**-28).
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    beyond = a * b - n
    start = (F.lit(key) if isinstance(key, int) else key).cast("long") * _KEY + seed * _SEED

    def word(k: Column, v: Column) -> Column:
        once = (v * _A + start + k.cast("long") * _ROUND) % _P
        return (once * _B + 12_345) % _Q

    def turn(at: Column, k: Column) -> Column:
        even = k % 2 == 0
        row = F.when(even, (at["row"] + word(k, at["column"])) % a).otherwise(at["row"])
        column = F.when(even, at["column"]).otherwise((at["column"] + word(k, at["row"])) % b)
        return F.struct(row.alias("row"), column.alias("column"))

    def sent(x: Column) -> Column:
        first = F.struct(F.floor(x / b).cast("long").alias("row"), (x % b).cast("long").alias("column"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * rounds - 1)), first, turn,
                           lambda at: at["row"] * b + at["column"])

    if not beyond:
        return sent(rank)
    # The first step is taken in any case.
    steps = F.sequence(F.lit(0), F.lit(min(beyond, 16) if n >= 4_096 else beyond))
    return F.aggregate(steps, rank.cast("long") + n, lambda x, k: F.when(k == 0, sent(x - n)).when(
        x < n, x).otherwise(sent(x)))


def permuted_numbers(rank: np.ndarray, n: int, key: int, seed: int, rounds: int = 4) -> np.ndarray:
    """``permuted`` over an array of ranks inside a task; numbers beyond n - 1 are sent on to the end."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    start = key * _KEY + seed * _SEED

    def rest(x: np.ndarray, m: int) -> np.ndarray:
        # Division by one number is several times faster than the remainder.
        return x - x // m * m

    def word(k: int, v: np.ndarray) -> np.ndarray:
        return rest(rest(v * _A + (start + k * _ROUND), _P) * _B + 12_345, _Q)

    def sent(x: np.ndarray) -> np.ndarray:
        row = x // b
        column = x - row * b
        for k in range(0, 2 * rounds, 2):
            row = rest(row + word(k, column), a)
            column = rest(column + word(k + 1, row), b)
        return row * b + column

    out = sent(rank.astype(np.int64))
    beyond = np.flatnonzero(out >= n)
    while len(beyond):
        out[beyond] = sent(out[beyond])
        beyond = beyond[out[beyond] >= n]
    return out


def global_rank(df: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """0-based rank over unique ``order`` columns (the last one breaks ties).

    Range partitioning splits even a hot leading value, since the tie breaker is
    part of the range key.  The range number is written down with the rows, so
    both passes see the same ranges; there are at most as many cells as shuffle
    partitions.
    """
    return rank_ranges(store_ranges(df, order), order, rank)


def store_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """First half of ``global_rank``: rows with their range number, written down."""
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    return materialize(ranged, "ranges")


def rank_ranges(stored: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """Second half of ``global_rank``: range totals first, then ranks inside each range."""
    ranked = running_sums(stored.withColumn("_one", F.lit(1)), F.col("_range"),
                          [F.col(c) for c in order], {rank: "_one"}, inclusive=False)
    return ranked.drop("_range", "_one")


def latest_by_suffix(df: DataFrame, key: str, name: str, pattern: str = r"checkpoint-(\d+)$"
                     ) -> DataFrame:
    """Per key, the row whose name carries the highest numeric suffix.

    ``max_by`` combines on the map side, so a hot key sends one row per task.
    """
    step = F.regexp_extract(name, pattern, 1).try_cast("bigint")
    rest = F.struct(*[c for c in df.columns if c != key])
    numbered = df.withColumn("_step", step).where("_step is not null")
    return (numbered.groupBy(key).agg(F.max_by(rest, "_step").alias("_row"),
                                      F.max("_step").alias("step"))
            .select(key, "step", "_row.*"))
