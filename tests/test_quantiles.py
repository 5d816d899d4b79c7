import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from postlift.operators import bins, labels, quantiles, ranking

PROBS = [0.0, 0.05, 0.5, 0.95, 1.0]


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id bigint, v {kind}")


@pytest.mark.parametrize("shape", ["uniform", "heavy tail", "a third tied", "all tied"])
def test_bracketed_quantiles_are_exact(spark, shape):
    rng = np.random.default_rng(7)
    values = {"uniform": rng.random(4000), "heavy tail": np.exp(6 * rng.normal(size=4000)),
              "a third tied": np.where(rng.random(4000) < 0.34, 5.0, rng.random(4000) * 10),
              "all tied": np.full(4000, 2.5)}[shape]
    # Accuracy 100 forces brackets: 4000 rows are far above its small-group limit.
    got = quantiles.exact_quantiles(frame(spark, values.tolist()), F.col("v"), PROBS,
                                    accuracy=100).first()
    assert got["n"] == 4000
    assert got["q"] == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12)


def test_probabilities_may_come_in_any_order(spark):
    values = np.random.default_rng(4).normal(size=5000)
    probs = [0.95, 0.1, 0.6, 0.6, 0.0]
    got = quantiles.exact_quantiles(frame(spark, values.tolist()), F.col("v"), probs,
                                    accuracy=100).first()
    assert got["q"] == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12)


def test_grouped_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": np.where(rng.random(6000) < 0.4, "hot", rng.integers(0, 9, 6000)
                                      .astype(str)), "v": rng.normal(size=6000)})
    got = quantiles.exact_quantiles(spark.createDataFrame(pdf), F.col("v"), [0.25, 0.95],
                                    by=("g",), accuracy=60).collect()
    want = pdf.groupby("g")["v"].quantile([0.25, 0.95]).unstack()
    assert len(got) == len(want)
    for row in got:
        assert row["q"] == pytest.approx(want.loc[row["g"]].tolist(), rel=1e-12)


def test_null_and_nan_are_left_out(spark):
    got = quantiles.exact_quantiles(frame(spark, [1.0, None, float("nan"), 3.0]), F.col("v"),
                                    [0.5]).first()
    assert (got["n"], got["q"]) == (2, [2.0])
    assert quantiles.exact_quantiles(frame(spark, [None]), F.col("v"), [0.5]).first() is None


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_small_groups_match_numpy(spark, values):
    got = quantiles.exact_quantiles(frame(spark, values), F.col("v"), PROBS).first()["q"]
    assert got == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-9, abs=1e-9)


def test_box_whiskers_stop_at_the_fence(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = frame(spark, values).withColumn("g", F.lit("a"))
    row = quantiles.box_summary(df, "v", ("g",)).first()
    assert (row.q1, row.median, row.q3) == (2.0, 3.0, 4.0)
    assert (row.whisker_low, row.whisker_high, row.n) == (1.0, 4.0, 5)


def test_global_rank_with_ties_and_hot_key(spark):
    times = [5] * 400 + list(range(600))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id bigint, t int")
    got = {r.id: r["rank"] for r in ranking.global_rank(df, ["t", "id"]).collect()}
    order = sorted(range(1000), key=lambda i: (times[i], i))
    assert got == {i: r for r, i in enumerate(order)}


def test_hash_order_is_a_permutation(spark):
    ranks = [r["rank"] for r in ranking.hash_order(spark.range(500), "id", 1).collect()]
    assert sorted(ranks) == list(range(500))


def test_latest_by_suffix_ignores_other_names(spark):
    df = spark.createDataFrame([("a", "checkpoint-9", 1), ("a", "checkpoint-10", 2),
                                ("a", "final", 3), ("b", "x-checkpoint-7y", 4)],
                               "k string, name string, v int")
    assert [tuple(r) for r in ranking.latest_by_suffix(df, "k", "name").collect()] == [
        ("a", 10, "checkpoint-10", 2)]


def test_quantile_bins_drop_duplicate_edges(spark):
    values = [0.0] * 30 + [float(i) for i in range(1, 21)]
    binned = bins.quantile_cut(frame(spark, values), "v")
    want = pd.qcut(pd.Series(values), 5, duplicates="drop").cat.codes.tolist()
    got = {r.id: r["bin"] for r in binned.collect()}
    assert [got[i] for i in range(50)] == want


def test_fixed_bins_are_right_closed(spark):
    edges = (12, 48, 128, 256, 512, 1024)
    values = [11.9, 12.0, 48.0, 48.1, 1024.0, 1024.1]
    got = {r.id: r["bin"] for r in bins.cut(frame(spark, values), "v", edges).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 4}
    want = pd.cut(pd.Series(values), edges, include_lowest=True).cat.codes.tolist()
    assert want == [-1, 0, 0, 1, 4, -1]


def scores(spark, e, v):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(zip(e, v))],
                                 "id bigint, engagement_score double, view_velocity_score double")


def test_global_label_share_and_threshold(spark):
    rng = np.random.default_rng(3)
    e, v = rng.random(500), rng.random(500)
    df = scores(spark, e.tolist(), v.tolist())
    stats = labels.tail_stats(df)
    combined = np.round(e / e.max() + v / v.max(), 9)
    assert stats.threshold == pytest.approx(np.quantile(combined, 0.95), abs=1e-9)
    positive = labels.label_tail(df, stats).agg(F.sum("is_tail")).first()[0]
    assert positive == int((combined >= stats.threshold).sum()) == 25


def test_zero_maximum_labels_nobody(spark):
    df = scores(spark, [0.0, 0.0], [1.0, 2.0])
    labelled = labels.label_tail(df, labels.tail_stats(df))
    assert [r.is_tail for r in labelled.collect()] == [0, 0]


def test_cohort_label_ties_are_all_labelled(spark):
    df = spark.createDataFrame([("m", 7.0)] * 10 + [("n", float(i)) for i in range(100)],
                               "cohort_month string, plays double")
    got = {r.cohort_month: r.s for r in labels.label_cohorts(df, "plays").groupBy("cohort_month")
           .agg(F.sum("tail").alias("s")).collect()}
    assert got == {"m": 10, "n": 5}


def test_cohort_value_with_many_decimals_reaches_its_threshold(spark):
    values = [0.3234567896] * 2 + [0.1] * 19
    df = spark.createDataFrame([("m", v) for v in values], "cohort_month string, v double")
    assert labels.label_cohorts(df, "v").agg(F.sum("tail")).first()[0] == sum(
        v >= np.quantile(values, 0.95) for v in values) == 2


def test_flat_features_drop_nan_play_counts(spark):
    raw = spark.createDataFrame([(1, "1700000000", float("nan")), (2, "1700000000", 5.0)],
                                "id bigint, create_time string, play_count double")
    assert [r.id for r in labels.engineer_flat(raw).collect()] == [2]


def test_regression_rule_uses_given_stats(spark):
    df = spark.createDataFrame([(1, np.log1p(1.0).item(), np.log1p(1.0).item()),
                                (2, 0.0, 0.0)], "id int, le double, lv double")
    stats = labels.TailStats(2.0, 2.0, 0.999)
    got = labels.regression_rule(df, stats, "le", "lv").orderBy("id").collect()
    assert [r.prediction for r in got] == [1, 0]


def test_flat_features_drop_unusable_rows(spark):
    raw = spark.createDataFrame(
        [(1, "1700000000", 10, '["a"]', "hey", "t"), (2, None, 10, None, None, None),
         (3, "-5", 10, None, None, None), (4, "1700000000", None, None, None, None)],
        "id bigint, create_time string, play_count bigint, challenges string, desc string, "
        "user_verified string")
    rows = labels.label_table(raw).collect()
    assert len(rows) == 1
    row = rows[0].asDict()
    assert row == {"id": 1, "cohort_month": "2023-11", "tail": 1, "duration": 0.0,
                   "vq_score": 0.0, "music_original": 0, "user_verified": 1, "hashtag_count": 1,
                   "caption_length": 3, "post_hour": 22, "post_dow": 1, "engage_ratio": 0.0}


@pytest.mark.parametrize("tied", [False, True])
@pytest.mark.parametrize("groups", [1, 3])
def test_a_poor_sketch_changes_nothing(spark, monkeypatch, tied, groups):
    monkeypatch.setattr(quantiles, "SKETCH", 8)
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.integers(0, groups, 6000), "v": rng.normal(size=6000)})
    if tied:
        pdf.loc[rng.random(6000) < 0.34, "v"] = 0.25
    got = quantiles.exact_quantiles(spark.createDataFrame(pdf), F.col("v"), PROBS + [0.6], by=("g",)).collect()
    assert len(got) == groups
    for row in got:
        want = np.quantile(pdf[pdf["g"] == row["g"]]["v"], PROBS + [0.6])
        assert row["q"] == pytest.approx(want.tolist(), rel=1e-12)
    whole = quantiles.exact_quantiles(spark.createDataFrame(pdf), F.col("v"), PROBS).first()
    assert whole["q"] == pytest.approx(np.quantile(pdf["v"], PROBS).tolist(), rel=1e-12)


def test_sketches_merge_in_two_levels(spark):
    df = spark.range(0, 100_000, 1, 200).select(F.col("id").cast("double").alias("_v"))
    rows = quantiles._cuts(df, (), [0.5])
    text = rows._jdf.queryExecution().executedPlan().toString()
    # The sketches of 200 tasks meet by salt first; one task merges no more than the salts.
    assert text.index("Exchange SinglePartition") < text.index("Exchange hashpartitioning")
    assert abs(rows.first()["_e"][0] - 50_000) < 500


@pytest.mark.parametrize("shape,by,sizes", [("plain", (), (4_000, 40_000)), ("tied", ("g",), (4_000,)),
                                            ("one value beside many", (), (4_000,))])
def test_cells_stay_small_however_many_rows(spark, monkeypatch, shape, by, sizes):
    """Ten times the rows leave the rows that a task ranks below the same bound."""
    monkeypatch.setattr(quantiles, "CELL_ROWS", 60)
    monkeypatch.setattr(quantiles, "SKETCH", 64)
    rng = np.random.default_rng(3)
    for n in sizes:
        v = {"plain": rng.normal(size=n), "tied": rng.integers(0, 40, n).astype(float),
             "one value beside many": np.where(rng.random(n) < 0.9, 1.0, rng.random(n) * 1.001)}[shape]
        pdf = pd.DataFrame({"v": v, "g": rng.integers(0, 2, n)})
        df = spark.createDataFrame(pdf)
        rows = quantiles._holding_rows(df, F.col("v"), PROBS, by, 10_000)
        cells = rows.groupBy(*by, "_cell").agg(F.count_distinct("_v").alias("kinds"), F.count("*").alias("n"))
        assert all(r.n <= 60 or r.kinds == 1 for r in cells.collect())
        got = quantiles.exact_quantiles(df, F.col("v"), PROBS, by=by).collect()
        for row in got:
            own = pdf if not by else pdf[pdf["g"] == row["g"]]
            assert row["n"] == len(own)
            assert row["q"] == pytest.approx(np.quantile(own["v"], PROBS).tolist(), rel=1e-12)


def test_many_groups_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 5)
    df = spark.range(2_000).select((F.col("id") % 40).alias("g"), F.col("id").cast("double").alias("v"))
    for grouped in (labels.label_cohorts(df, "v", "g"), quantiles.box_summary(df, "v", ("g",))):
        assert "ResolvedHint" not in grouped._jdf.queryExecution().analyzed().toString()
        assert grouped.count() in (2_000, 40)
    few = labels.label_cohorts(df.where("g < 3"), "v", "g")
    assert "ResolvedHint (strategy=broadcast)" in few._jdf.queryExecution().analyzed().toString()
