import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postlift.operators import splits, temporal
from postlift.sources import grid


def panel(seed=0, entities=6, months=30):
    rng = np.random.default_rng(seed)
    rows = [(e, 24000 + m, int(rng.integers(1, 9)), float(rng.integers(1, 99)),
             int(rng.random() < 0.3))
            for e in range(entities) for m in range(months) if rng.random() < 0.6]
    return pd.DataFrame(rows, columns=["entity", "month", "a", "b", "label"])


def brute_matrix(pdf, h, window):
    rows = {(r.entity, r.month): r for r in pdf.itertuples()}
    out = {}
    for (entity, month), row in rows.items():
        seen = {lag: rows.get((entity, month - lag)) for lag in range(h, h + window)}
        if any(r is not None for r in seen.values()):
            out[(entity, month)] = (row.label, *[
                0.0 if seen[lag] is None else float(getattr(seen[lag], f))
                for f in ("a", "b") for lag in range(h, h + window)])
    return out


@pytest.mark.parametrize("h,window", [(1, 1), (3, 12), (0, 4)])
def test_matrix_equals_brute_force(spark, h, window):
    pdf = panel()
    got = temporal.supervised_matrix(spark.createDataFrame(pdf), "entity", "month", "label",
                                     ["a", "b"], h, window)
    assert got.columns[3:] == [f"{f}_lag{k}" for f in "ab" for k in range(h, h + window)]
    rows = {(r.entity, r.label_month): tuple(r)[2:] for r in got.collect()}
    assert rows == brute_matrix(pdf, h, window)


def test_matrix_skips_null_labels_and_empty_windows(spark):
    df = spark.createDataFrame(
        [(1, 10, 5, 1), (1, 11, None, 0), (1, 12, 7, None), (2, 10, 1, 1)],
        "entity int, month int, a int, label int")
    got = temporal.supervised_matrix(df, "entity", "month", "label", ["a"], 1, 1).collect()
    assert [tuple(r) for r in got] == [(1, 11, 0, 5.0)]


def test_pairs_never_use_rows_newer_than_the_horizon(spark):
    pairs = temporal.lag_pairs(spark.createDataFrame(panel(1)), "entity", "month", ["a"],
                               "label", 3, 12)
    low, high = pairs.agg(F.min("lag"), F.max("lag")).first()
    assert low >= 3 and high <= 14


@pytest.mark.parametrize("h,window", [(3, 12), (0, 1), (5, 3), (0, 24), (40, 2)])
def test_pairs_equal_brute_force_from_two_copies_a_row(spark, h, window):
    pdf = panel(2, months=50)
    df = spark.createDataFrame(pdf)
    pairs = temporal.lag_pairs(df, "entity", "month", ["a"], "label", h, window)
    got = sorted((r.entity, r.feature_month, r.label_month, r.a, r.label, r.lag) for r in pairs.collect())
    rows = list(pdf.itertuples())
    want = sorted((f.entity, f.month, l.month, f.a, l.label, l.month - f.month) for f in rows for l in rows
                  if f.entity == l.entity and h <= l.month - f.month < h + window)
    assert got == want
    copies = df.select(F.explode(F.array_distinct(F.array(
        F.floor((F.col("month") + h) / window), F.floor((F.col("month") + h + window - 1) / window)))))
    assert copies.count() <= 2 * len(rows)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and plan.count("Generate explode(array_distinct(array(") == 1


def test_unique_panel_keeps_first_by_order(spark):
    df = spark.createDataFrame([(1, 5, 2, "late"), (1, 5, 1, "early")],
                               "e int, m int, o int, v string")
    assert [tuple(r) for r in temporal.unique_panel(df, "e", "m", "o").collect()] == [
        (1, 5, 1, "early")]


def test_default_features_exclude_named_columns(spark):
    df = spark.createDataFrame([(1, 2, 3.0, "x", 1)], "user int, date int, f double, s string, y int")
    assert temporal.default_features(df, "user", "date", "y") == ["f"]


def test_align_fills_absent_and_drops_extra(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "e int, a double, b double")
    assert [tuple(r) for r in temporal.align_columns(df, ["c", "b"], ["e"]).collect()] == [
        (1, 0.0, 3.0)]


def test_append_by_name_fills_zero(spark):
    a = spark.createDataFrame([(1, 2)], "k int, x int")
    b = spark.createDataFrame([(2, 3)], "k int, y int")
    got = temporal.append_by_name(a, b, ["x", "y"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 2, 0), (2, 0, 3)]


def test_timecut_windows_follow_the_calendar_rules(spark):
    months = [m for m in range(24000, 24060) if m != 24047]
    df = spark.createDataFrame([(m,) for m in months * 2], "month int")
    spec = grid.TemporalSpec(24000, 24059, feature_window=12, update_freq=6,
                             max_history_months=24, h=3)
    got = {r.val_end: r for r in temporal.timecut_windows(df, "month", spec).collect()}
    want = {}
    for end in range(24059, 24000 + 12 + 6 + 6 - 2 - 1, -6):
        start = min((m for m in months if m > end - 6), default=None)
        train_end = start - 3
        train_start = max(train_end - 24 + 1, 24000 + 12 + 3 - 1)
        n_train = sum(train_start <= m <= train_end for m in months)
        n_val = sum(start <= m <= end for m in months)
        if end in months and n_train and n_val:
            want[end] = (start, train_end, train_start, n_train, n_val)
    assert 24047 not in got
    assert {k: (r.val_start, r.train_end, r.train_start, r.n_train, r.n_val)
            for k, r in got.items()} == want


def test_no_timecuts_when_history_is_short(spark):
    spec = grid.TemporalSpec(24000, 24010)
    assert temporal.timecuts(spec) == []
    df = spark.createDataFrame([(24000,)], "month int")
    assert temporal.timecut_windows(df, "month", spec).count() == 0
    matrix = spark.createDataFrame([(1, 24000, 1)], "entity int, label_month int, y int")
    assert temporal.tag_cuts(matrix, []).count() == 0


def test_folds_are_ordered_and_disjoint(spark):
    n = 50
    df = spark.createDataFrame([(i, (i * 37) % 11) for i in range(n)], "id int, create_time int")
    rows = splits.time_folds(df).collect()
    order = sorted(range(n), key=lambda i: ((i * 37) % 11, i))
    for fold, fraction in enumerate((0.6, 0.7, 0.8, 0.9), 1):
        train = {r.id for r in rows if r.fold == fold and r.part == "train"}
        val = {r.id for r in rows if r.fold == fold and r.part == "val"}
        cut = int(n * fraction)
        assert train == set(order[:cut]) and val == set(order[cut:cut + int(n * 0.1)])


def test_empty_folds_are_skipped(spark):
    assert splits.fold_edges(5) == []
    df = spark.createDataFrame([(1, 1)], "id int, create_time int")
    assert splits.time_folds(df).count() == 0


def test_random_split_is_stable_under_partitioning(spark):
    a = {r.id: r.split for r in splits.random_split(spark.range(2000)).collect()}
    b = {r.id: r.split for r in splits.random_split(spark.range(2000).repartition(7)).collect()}
    assert a == b
    assert 0.87 < sum(v == "train" for v in a.values()) / 2000 < 0.93


def test_grid_lists_every_combination(spark):
    options = {"a": (1, 2), "b": (3, 4, 5)}
    assert [tuple(c.values()) for c in grid.combinations(options)] == list(
        itertools.product((1, 2), (3, 4, 5)))
    assert grid.with_options(spark.range(2), options).count() == 12
    assert grid.grid_table(spark, options).count() == 6
    assert grid.temporal_specs([1], [2])[0] == grid.TemporalSpec(1, 2, 12, 6, 60, 3)


def test_without_a_gap_the_first_validation_month_is_in_both_parts(spark):
    matrix = spark.createDataFrame([(e, m, 0) for e in range(2) for m in range(10)],
                                   "entity int, label_month int, y int")
    cut = {"val_end": 8, "val_start": 5, "train_end": 5, "train_start": 2}
    got = {(r.label_month, r.part) for r in temporal.tag_cuts(matrix, [cut]).collect()}
    assert got == {(m, "train") for m in range(2, 6)} | {(m, "val") for m in range(5, 9)}


def test_entity_filter_by_list_and_table(spark):
    df = spark.range(10).withColumnRenamed("id", "e")
    assert temporal.only_entities(df, "e", [1, 2]).count() == 2
    assert temporal.only_entities(df, "e", spark.range(3).withColumnRenamed("id", "e")).count() == 3
