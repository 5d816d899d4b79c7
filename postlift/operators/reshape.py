"""Small table shapes: row accounting, unions of shards, wide pivots."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..session import prepare


def _gate_counts(gates: dict[str, Column]) -> dict[str, Column]:
    """Aggregates: rows read, rows passing each further gate, rows that do not pass all."""
    passed, counts = F.lit(True), {"read": F.count("*")}
    for name, gate in gates.items():
        passed = passed & F.coalesce(gate, F.lit(False))
        counts[name] = F.count(F.when(passed, 1))
    counts["dropped"] = F.count(F.when(~passed, 1))
    return counts


def drop_accounting(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(stage, n_rows): rows read, rows passing each further gate, rows dropped, in one pass of their own."""
    wide = df.agg(*[value.alias(name) for name, value in _gate_counts(gates).items()])
    rows = F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("n_rows"))
                     for c in wide.columns])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def count_passing(spark: SparkSession, build: Callable[[SparkSession], DataFrame], gates: dict[str, Column],
                  act: Callable[[DataFrame], None]) -> DataFrame:
    """Run ``act`` on the rows that pass all gates, and count on the side what ``drop_accounting`` counts.

    ``build`` makes the frame in the session that it is given: metrics are observed in a
    session of their own, as one that has observed some cannot ship fitted models to
    tasks any more (Spark 4.1).  The rows are read once; tasks that ran twice count once.
    """
    side = prepare(spark.newSession())
    seen, kept = Observation("gates"), F.lit(True)
    for gate in gates.values():
        kept = kept & F.coalesce(gate, F.lit(False))
    counts = _gate_counts(gates)
    act(build(side).observe(seen, *[value.alias(name) for name, value in counts.items()]).where(kept))
    found = seen.get
    return spark.createDataFrame([(name, found[name]) for name in counts], "stage string, n_rows long")


def union_shards(shards: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, shards)


def pivot_metrics(long: DataFrame, row: str, column: str, value: str, names: list[str]
                  ) -> DataFrame:
    """Long metrics to one column per name; the listed names spare a distinct pass."""
    return long.groupBy(row).pivot(column, names).agg(F.first(value, ignorenulls=True))
