"""Exact linear-interpolated quantiles and box summaries at scale.

``percentile`` keeps every distinct value of a group in one task.  Here a quantile
sketch only proposes where to cut the values: it is merged in two levels, so no task
meets the sketches of all scan tasks.  The rows of every cell between two cuts are
then counted exactly, which tells the cells that hold the wanted ranks, whatever the
sketch's error.  A holding cell of more than ``CELL_ROWS`` rows is cut again, its rows
alone being read, until it is small or holds one value; only then are the distinct values
of the holding cells ranked, so a task's share does not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

# Size of a sketch (its rank error is about 0.04 %), and into how many the scan tasks merge first.
SKETCH, SALTS = 8_192, 64
# Distances of the cuts from a wanted rank, in units of 4 / accuracy.
_STEPS = (-16, -4, -1, 1, 4, 16)
#: Rows of different values that one task may rank, and into how many parts a larger cell is cut.
CELL_ROWS, PARTS = 1 << 20, 32
#: Rows up to which a table of one row per group is broadcast.
FEW = 10_000


def hinted(stored: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has been counted to have ``FEW`` rows at most."""
    return F.broadcast(stored) if stored.limit(FEW + 1).count() <= FEW else stored


def exact_quantiles(df: DataFrame, value: Column, probs: list[float], by: tuple[str, ...] = (),
                    accuracy: int = 10_000) -> DataFrame:
    """One row per group: ``by``, row count ``n``, ``q`` (array in ``probs`` order).

    Null and NaN values and rows without a group are left out; a table without values
    gives no row.  The cuts, one row per group, are broadcast where the groups are
    counted to be few.  ``df`` is read three times.
    """
    keys = [*by, "_cell"]
    chosen = _holding_rows(df, value, probs, by, accuracy)
    distinct = chosen.groupBy(*keys, "_n", "_before", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v")
                            .rowsBetween(Window.unboundedPreceding, 0))
    ranked = distinct.withColumn("_upto", F.col("_before") + upto)
    # Rank p*(n-1) interpolates between the values at its floor and ceiling.
    picks, results = [], []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("_n") - 1)
        for name, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
            picks.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{name}{i}"))
        at_lo, at_hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        results.append(at_lo + (at_hi - at_lo) * (position - F.floor(position)))
    return (ranked.groupBy(*by, "_n").agg(*picks)
            .select(*by, F.col("_n").alias("n"), F.array(*results).alias("q")))


def _holding_rows(df: DataFrame, value: Column, probs: list[float], by: tuple[str, ...],
                  accuracy: int) -> DataFrame:
    """(by, _cell, _n, _before, _v): the rows of all cells that hold a wanted rank.

    ``_n`` is the group's size and ``_before`` the number of its rows in lower cells.
    """
    values = (df.select(*by, value.cast("double").alias("_v"))
              .where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    for there in [F.col(c).isNotNull() for c in by]:
        values = values.where(there)
    wanted = sorted({min(1.0, max(0.0, p + step * 4.0 / accuracy)) for p in probs for step in _STEPS})
    if by:
        cut = values.join(hinted(materialize(_cuts(values, by, wanted), "cuts")), list(by))
        ends = [F.col("_e")[i] for i in range(len(wanted))]
    else:
        # One row of a few numbers: read it and go on with constants.
        head = _cuts(values, by, wanted).first()
        cut, ends = values, [F.lit(e) for e in (head["_e"] if head and head["_e"] else [])]
    cell = F.lit(0).cast("long")
    for end in ends:
        cell = cell + (F.col("_v") > end).cast("int")
    celled = cut.select(*by, "_v", cell.alias("_cell"), F.lit(0).cast("long").alias("_under"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # A group has at most one cell more than cuts, so these tables are as short as the groups are few.
    counted = _counted(celled, [*by, "_cell", "_under"]).withColumn("_n", F.sum("_rows").over(group))
    chosen, crowd = _holding(celled, counted, probs, by, group)
    while crowd > CELL_ROWS:
        # A cell is a group of its own now; both sides of every cut are told apart, so ties are left alone.
        keys = [*by, "_cell", "_under", "_n"]
        crowded = materialize(chosen.select(*by, "_cell", F.col("_before").alias("_under"), "_n", "_v"), "cells")
        within = hinted(materialize(_cuts(crowded, keys, [i / PARTS for i in range(1, PARTS)]), "cuts"))
        part = F.lit(0)
        for i in range(PARTS - 1):
            part = part + (F.col("_v") >= F.col("_e")[i]).cast("int") + (F.col("_v") > F.col("_e")[i]).cast("int")
        celled = crowded.join(within, keys).select(
            *by, "_v", (F.col("_cell") * (2 * PARTS) + part).alias("_cell"), "_under", "_n")
        chosen, crowd = _holding(celled.drop("_n"), _counted(celled, keys), probs, by,
                                 Window.partitionBy(*by, "_under"))
    return chosen


def _counted(celled: DataFrame, keys: list[str]) -> DataFrame:
    return celled.groupBy(*keys).agg(F.count("*").alias("_rows"), (F.min("_v") < F.max("_v")).alias("_mixed"))


def _holding(celled: DataFrame, counted: DataFrame, probs: list[float], by: tuple[str, ...], whole
             ) -> tuple[DataFrame, int]:
    """Rows of the cells that hold a wanted rank, and the rows of the fullest one with several values.

    ``whole`` is the window of cells whose rows add up, on top of ``_under`` rows below them.
    """
    before = F.sum("_rows").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("_before", F.col("_under") + F.coalesce(before, F.lit(0)))
    hits = F.lit(False)
    for p in probs:
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for rank in (F.floor(at), F.ceil(at)):
            hits = hits | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_rows")))
    keys = [*by, "_cell", "_under"]
    stored = materialize(placed.where(hits).select(*keys, "_n", "_before", "_rows", "_mixed"), "holding")
    crowd = stored.where("_mixed").agg(F.max("_rows")).first()[0] or 0
    return celled.join(hinted(stored.drop("_rows", "_mixed")), keys).drop("_under"), crowd


def _cuts(values: DataFrame, by: tuple[str, ...], ranks: list[float]) -> DataFrame:
    """(by, _e): the sketched values at the given ranks, one row per group."""
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    partial = values.groupBy(*by, salt.alias("_salt")).agg(
        F.count("*").alias("_c"), F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("_s"))
    merged = partial.groupBy(*by).agg(F.sum("_c").alias("_c"), F.kll_merge_agg_double("_s").alias("_s"))
    at = F.array(*[F.lit(r) for r in ranks])
    return merged.select(*by, F.when(F.col("_c") > 0, F.kll_sketch_get_quantile_double(
        "_s", at)).alias("_e"))


def box_summary(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Quartiles per bin and the furthest values within 1.5 IQR of the box."""
    boxes = materialize(exact_quantiles(df, F.col(value), [0.25, 0.5, 0.75], by=by), "boxes")
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    fenced = boxes.select(
        *by, "n", q1.alias("q1"), q2.alias("median"), q3.alias("q3"),
        (q1 - 1.5 * (q3 - q1)).alias("_low"), (q3 + 1.5 * (q3 - q1)).alias("_high"))
    v = F.col(value)
    fences = fenced.select(*by, "_low", "_high")
    reach = (df.select(*by, value).join(hinted(fences), list(by)).groupBy(*by).agg(
        F.min(F.when(v >= F.col("_low"), v)).alias("_reach_low"),
        F.max(F.when(v <= F.col("_high"), v)).alias("_reach_high")))
    # Whiskers never end inside the box.
    return (fenced.join(reach, list(by)).select(
        *by, "n", "q1", "median", "q3",
        F.least("_reach_low", "q1").alias("whisker_low"),
        F.greatest("_reach_high", "q3").alias("whisker_high")))
