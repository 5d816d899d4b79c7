"""Batched logistic fits and temporal experiments against Spark ML and plain arithmetic."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from postlift.operators import experiment, newton, training
from postlift.session import materialize
from postlift.sources.grid import TemporalSpec


def rows_of(spark, months, y, x, part=0):
    return spark.createDataFrame(
        [(part, int(m), int(a), [float(v) for v in b], i) for i, (m, a, b) in enumerate(zip(months, y, x))],
        "part int, month int, y int, x array<double>, who int").repartition(3)


def data(n=600, seed=0):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n), 1e5 + 3e4 * r.normal(size=n), r.integers(0, 3, n)])
    y = r.random(n) < 1 / (1 + np.exp(-(0.7 * x[:, 0] - 1e-5 * (x[:, 1] - 1e5) - 0.5)))
    return r.integers(0, 12, n), y.astype(int), x


@pytest.mark.parametrize("ridge", [0.0, 0.1])
def test_fits_equal_spark_ml(spark, ridge):
    months, y, x = data()
    rows = rows_of(spark, months, y, x)
    found = newton.fit_logistic(rows, [newton.Fit(i, 0, 0, last, cols, ridge) for i, (last, cols) in enumerate(
        [(11, (0, 1, 2)), (5, (0, 1, 2)), (11, (1,))])])
    for f in found:
        ready = training.assemble(rows.where(F.col("month") <= f.fit.last).select(
            "y", *[F.col("x")[c].alias(f"c{c}") for c in f.fit.columns]), [f"c{c}" for c in f.fit.columns])
        model = LogisticRegression(labelCol="y", regParam=ridge, maxIter=500, tol=1e-12).fit(ready)
        want = np.r_[model.intercept, model.coefficients.toArray()]
        assert f.converged and f.n == (months <= f.fit.last).sum()
        assert f.weights * np.r_[1, f.spread[1:]] == pytest.approx(want * np.r_[1, f.spread[1:]], abs=2e-5)
        assert np.abs(f.predicted - f.labelled + f.pull())[1:] == pytest.approx(0, abs=1e-4 * f.n)


def test_constant_collinear_and_separable_features(spark):
    months, y, x = data(200, 3)
    odd = np.column_stack([x[:, 0], 2 * x[:, 0], np.full(200, 4.0), y])
    rows = rows_of(spark, months, y, odd)
    flat, twin, apart, none = newton.fit_logistic(rows, [
        newton.Fit(0, 0, 0, 11, (2,)), newton.Fit(1, 0, 0, 11, (0, 1)),
        newton.Fit(2, 0, 0, 11, (3,)), newton.Fit(3, 0, 50, 60, (0,))])
    assert flat.converged and flat.weights[1] == 0
    assert 1 / (1 + np.exp(-flat.weights[0])) == pytest.approx(y.mean())
    lone = newton.fit_logistic(rows, [newton.Fit(0, 0, 0, 11, (0,))])[0]
    assert twin.weights[1] + 2 * twin.weights[2] == pytest.approx(lone.weights[1], rel=1e-6)
    p = 1 / (1 + np.exp(-(apart.weights[0] + apart.weights[1] * y)))
    assert np.abs(p - y).max() < 1e-6
    assert none.n == 0 and not none.weights.any()


def test_jobs_do_not_grow_with_fits(spark):
    months, y, x = data(300, 5)
    rows = materialize(rows_of(spark, months, y, x), "rows")

    def jobs(fits):
        spark.sparkContext.setJobGroup(f"fits {len(fits)}", "")
        found = newton.fit_logistic(rows, fits)
        count = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fits {len(fits)}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert all(f.converged for f in found)
        return count, max(f.steps for f in found)

    one, steps = jobs([newton.Fit(0, 0, 0, 11, (0, 2))])
    many, more = jobs([newton.Fit(i, 0, i % 4, 11 - i % 3, (0, 2), i * 0.01) for i in range(40)])
    assert many / more == pytest.approx(one / steps, rel=0.5) and more <= steps + 3


def test_a_sampled_start_saves_steps_and_changes_no_fit(spark, monkeypatch):
    months, y, x = data(4_000, 5)
    rows = materialize(rows_of(spark, months, y, x), "rows")
    fits = [newton.Fit(i, 0, i, 11, (0, 1, 2), i * 0.1) for i in range(3)]
    plain = newton.fit_logistic(rows, fits)
    monkeypatch.setattr(newton, "START_ROWS", 1_000)
    begun = newton.fit_logistic(rows, fits)
    for a, b in zip(plain, begun):
        assert a.converged and b.converged and a.n == b.n and b.steps < a.steps
        assert np.allclose(a.weights, b.weights, atol=1e-8)


def test_a_start_worse_than_none_is_dropped(spark):
    months, y, x = data(500, 5)
    rows = materialize(rows_of(spark, months, y, x), "rows")
    fit = newton.Fit(0, 0, 0, 11, (0, 1))
    best = newton.fit_logistic(rows, [fit])[0]
    far = newton.Fitted(fit, np.array([0.0, 500.0, -500.0]))
    found = newton._newton(rows, {0: far}, newton.STEPS, newton.SLOPE)[0]
    assert found.converged and np.allclose(found.weights, best.weights, atol=1e-8)


def test_tasks_that_make_matrices_follow_the_panel(spark, monkeypatch):
    """However large the panel, a task makes a bounded part of its matrices and no sort takes them all."""
    stored = []
    monkeypatch.setattr(experiment, "materialize", lambda df, name: stored.append(df) or materialize(df, name))
    parts = []
    for most in (1 << 18, 50):
        monkeypatch.setattr(experiment, "TASK_ROWS", most)
        experiment.run_experiment(panel(spark)[1], "user", "month", "label", ["x"], SPECS, {"m0": experiment.MEAN})
        parts.append(stored[-1].rdd.getNumPartitions())
        assert "rangepartitioning" not in stored[-1]._jdf.queryExecution().executedPlan().toString().lower()
    assert parts[1] > 2 * parts[0]


def panel(spark, entities=30, months=40, seed=1):
    r = np.random.default_rng(seed)
    pdf = pd.DataFrame([(e, 24_000 + m, float(r.integers(0, 9)), int(r.random() < 0.1 + 0.4 * (e % 3 == 0)))
                        for e in range(entities) for m in range(months) if r.random() < 0.8],
                       columns=["user", "month", "x", "label"])
    return pdf, spark.createDataFrame(pdf)


SPECS = [TemporalSpec(24_000, 24_039, 3, 6, 24, h) for h in (0, 2)]
MODELS = {"m0": experiment.MEAN, "m1": experiment.Logistic(), "m2": experiment.Logistic(("newest",), 0.0)}


def flags(spec):
    return {"newest": F.col(f"x_lag{spec.h}") > 4}


def test_experiment_rows_and_closed_forms(spark):
    pdf, df = panel(spark)
    run = experiment.run_experiment(df, "user", "month", "label", ["x"], SPECS, MODELS, flags)
    got = run.results.toPandas()
    old = training.run_timecuts(df, "user", "month", "label", ["x"], SPECS[1], {training.MEAN: {}}).toPandas()
    mean = got[(got.model_id == "m0") & (got.h == 2)]
    keys = ["user", "eval_month", "timecut"]
    both = mean.merge(old, on=keys, suffixes=("", "_old"))
    assert len(both) == len(mean) == len(old) and both.p.to_numpy() == pytest.approx(both.p_old.to_numpy())
    assert mean.fallback.all() and not got[got.model_id != "m0"].fallback.any()
    # One indicator: the prediction is the training mean of its value.
    for (spec, cut, model), f in run.fits.items():
        if model == "m2":
            seen = got[(got.model_id == "m2") & (got.timecut == cut) & (got.h == spec.h)]
            assert seen.p.round(9).nunique() <= 2
            low, high = f.labelled[1], f.total[1]
            assert round(low / high, 9) in set(seen.p.round(9)) | {round(1 / (1 + np.exp(-f.weights.sum())), 9)}
    moments = run.moments().toPandas()
    assert moments.converged.all()
    for key, f in run.fits.items():
        assert f.predicted + f.pull() == pytest.approx(f.labelled, abs=1e-6 * f.n)


def test_experiment_of_few_rows(spark):
    """An empty panel gives no rows; one class, or null labels only, give means or nothing."""
    empty = spark.createDataFrame([], "user int, month int, x double, label int, part string, p double")
    assert experiment.run_experiment(empty, "user", "month", "label", ["x"], SPECS, MODELS, flags).results.count() == 0
    calm = spark.createDataFrame([(1, 24_000 + m, None if m % 3 else 1.0, 0, "x", 0.5) for m in range(40)], empty.schema)
    run = experiment.run_experiment(calm, "user", "month", "label", ["x"], SPECS, MODELS, flags)
    rows = run.results.collect()
    assert rows and all(r.fallback and r.p == 0 for r in rows) and not run.fits
    unknown = calm.withColumn("label", F.lit(None).cast("int"))
    assert experiment.run_experiment(unknown, "user", "month", "label", ["x"], SPECS, MODELS, flags).results.count() == 0
