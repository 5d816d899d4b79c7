"""Temporal experiments: every option combination, timecut and model in a fixed number of jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from ..sources.grid import TemporalSpec
from .newton import Asked, Fit, Fitted, fit_logistic, score_rows
from .temporal import supervised_matrix, timecut_windows


@dataclass(frozen=True)
class Logistic:
    """A logistic model over some columns (all lags if none are named) with a ridge penalty."""
    columns: tuple[str, ...] | None = None
    ridge: float = 0.0


#: The model that predicts the mean label of the training rows.
MEAN = None

#: Rows of the lag matrices that one task makes.
TASK_ROWS = 1 << 18

_OPTIONS = ("feature_window", "update_freq", "h")


@dataclass
class Run:
    """What an experiment gives: scored rows, and the fits behind them by (spec, timecut, model)."""
    results: DataFrame
    fits: dict[tuple[TemporalSpec, int, str], Fitted]
    names: dict[tuple[int, int], list[str]]

    def moments(self) -> DataFrame:
        """(options, timecut, model_id, feature, n_train, moment, converged) of all fitted models.

        ``moment`` is the feature's mean prediction, weighted by its values, plus the
        penalty's share: at the optimum it equals the mean label weighted alike.
        The row named ``bias`` is unweighted.  One row per weight, made from sums that the last step
        left on the driver.
        """
        rows = []
        for (spec, timecut, model_id), found in self.fits.items():
            names = ["bias", *(self.names[spec.feature_window, spec.h][c] for c in found.fit.columns)]
            matched = found.predicted + found.pull()
            for name, value, total in zip(names, matched.tolist(), found.total.tolist()):
                rows.append((spec.feature_window, spec.update_freq, spec.h, timecut, model_id, name, found.n,
                             value / total if total else 0.0, found.converged))
        return self.results.sparkSession.createDataFrame(
            rows, "feature_window int, update_freq int, h int, timecut int, model_id string, "
                  "feature string, n_train long, moment double, converged boolean")


def run_experiment(panel: DataFrame, entity: str, month: str, target: str, features: list[str],
                   specs: list[TemporalSpec], models: dict[str, Logistic | None],
                   flags: Callable[[TemporalSpec], dict[str, Column]] | None = None) -> Run:
    """Fit every model under every timecut of every option combination and score the months that follow.

    Combinations of one window and gap share a lag matrix; ``flags`` may add columns made
    from its lags (they may depend on the window and the gap alone).  All matrices are
    stored as one frame, the logistic fits of all timecuts advance
    together (``newton``), and one pass scores all.  Jobs do not grow with timecuts or models;
    what reaches the driver is one row per matrix and month, and the fits' sums.

    Result rows: (entity, eval_month, ytrue, timecut, feature_window, update_freq, h,
    model_id, p, fallback).  Where the training rows have one class only, and for ``MEAN``, p is
    their mean label and ``fallback`` is true.  Timecuts without training rows are left
    out, as are those whose months hold no data; an empty panel gives no rows.
    """
    shapes = list(dict.fromkeys((s.feature_window, s.h) for s in specs))
    names, matrices = {}, []
    # Every task makes a bounded part of the matrices, however large the panel.
    tasks = max(panel.sparkSession.sparkContext.defaultParallelism, -(-panel.count() * len(shapes) // TASK_ROWS))
    spread = panel.repartition(tasks, entity)
    for part, (window, h) in enumerate(shapes):
        matrix = supervised_matrix(spread, entity, month, target, features, h, window)
        lags = [c for c in matrix.columns if "_lag" in c]
        added = flags(next(s for s in specs if (s.feature_window, s.h) == (window, h))) if flags else {}
        names[window, h] = [*lags, *added]
        vector = F.array(*[F.col(c) for c in lags], *[c.cast("double") for c in added.values()])
        matrices.append(matrix.select(F.lit(part).alias("part"), entity,
                                      F.col("label_month").cast("int").alias("month"), "y", vector.alias("x")))
    stacked = reduce(DataFrame.unionByName, matrices)
    # The rows stay where their entity's window left them, in order of months within each task.
    rows = materialize(stacked.sortWithinPartitions("month"), "matrices")
    # Short lists: one row per matrix and month, one per combination and timecut.
    tally = {(r["part"], r["month"]): (r["n"], r["ones"]) for r in rows.groupBy("part", "month").agg(
        F.count("*").alias("n"), F.sum("y").alias("ones")).collect()}
    cuts = reduce(DataFrame.unionByName, [timecut_windows(panel, month, s).withColumn("spec", F.lit(i))
                                          for i, s in enumerate(specs)]).collect()
    wanted, fits, scored = [], [], []
    for cut in sorted(cuts, key=lambda c: (c["spec"], -c["val_end"])):
        spec = specs[cut["spec"]]
        part = shapes.index((spec.feature_window, spec.h))
        seen = [v for (p, m), v in tally.items() if p == part and cut["train_start"] <= m <= cut["train_end"]]
        n, ones = sum(v[0] for v in seen), sum(v[1] for v in seen)
        if not n:
            continue
        for model_id, model in models.items():
            key = len(wanted)
            wanted.append((spec, int(cut["val_end"]), model_id, model is MEAN or ones in (0, n)))
            span = part, cut["val_start"], cut["val_end"]
            if wanted[-1][3]:
                scored.append(Asked(key, *span, constant=ones / n))
                continue
            known = names[spec.feature_window, spec.h]
            chosen = [c for c in known if "_lag" in c] if model.columns is None else model.columns
            fits.append(Fit(key, part, cut["train_start"], cut["train_end"],
                            tuple(known.index(c) for c in chosen), model.ridge))
            scored.append(Asked(key, *span))
    found = {f.fit.key: f for f in fit_logistic(rows, fits)}
    scored = [a if a.constant is not None else Asked(
        a.key, a.part, a.first, a.last, found[a.key].fit.columns, tuple(found[a.key].weights.tolist()))
        for a in scored]
    told = panel.sparkSession.createDataFrame(
        [(k, t, s.feature_window, s.update_freq, s.h, m, mean) for k, (s, t, m, mean) in enumerate(wanted)],
        "key int, timecut int, feature_window int, update_freq int, h int, model_id string, fallback boolean")
    # One row per combination, timecut and model.
    results = score_rows(rows, entity, scored).join(F.broadcast(told), "key").select(
        entity, F.col("month").alias("eval_month"), F.col("y").alias("ytrue"), "timecut", *_OPTIONS,
        "model_id", "p", "fallback")
    return Run(results, {wanted[k][:3]: f for k, f in found.items()}, names)
