import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlift.config import FEATURE_NAMES
from postlift.operators import explain, losses, metrics, ranking, reshape, scoring, tokens, training
from postlift.sources import grid


def scored(spark, probs, truths):
    return spark.createDataFrame([(i, float(p), int(t)) for i, (p, t) in
                                  enumerate(zip(probs, truths))], "id bigint, prob double, y int")


def brute_curves(probs, truths):
    pos = [p for p, t in zip(probs, truths) if t]
    neg = [p for p, t in zip(probs, truths) if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, hits = 0.0, 0
    for s in sorted(set(probs), reverse=True):
        above = [t for p, t in zip(probs, truths) if p >= s]
        ap += (sum(above) - hits) / len(pos) * sum(above) / len(above)
        hits = sum(above)
    return auc, ap


def test_scores_far_below_a_millionth_are_told_apart(spark):
    row = metrics.curve_metrics(scored(spark, [4e-7, 2e-7, 1e-7, 3e-8], [1, 1, 0, 0]), "y", "prob").first()
    assert (row.roc_auc, row.average_precision) == (1.0, 1.0)


def test_a_score_just_below_the_threshold_is_no_hit(spark):
    df = scored(spark, [0.6999996, 0.9, 0.1], [1, 1, 0])
    got, want = (f(df, "y", "prob", 0.7).first().f1 for f in (metrics.evaluate, metrics.binary_metrics))
    assert got == want == pytest.approx(2 / 3)


@pytest.mark.parametrize("seed,decimals", [(0, 1), (1, 2), (2, 6), (3, 15)])
def test_curves_equal_pair_counting(spark, seed, decimals):
    rng = np.random.default_rng(seed)
    probs = np.round(rng.random(80), decimals).tolist()
    truths = (rng.random(80) < 0.3).astype(int).tolist()
    row = metrics.curve_metrics(scored(spark, probs, truths), "y", "prob").first()
    auc, ap = brute_curves(probs, truths)
    assert row.roc_auc == pytest.approx(auc) and row.average_precision == pytest.approx(ap)


def test_curves_are_null_with_one_class(spark):
    row = metrics.curve_metrics(scored(spark, [0.1, 0.9], [0, 0]), "y", "prob").first()
    assert row.roc_auc is None and row.average_precision is None


def test_rates_are_zero_when_undefined(spark):
    row = metrics.binary_metrics(scored(spark, [0.1, 0.2], [0, 1]), "y", "prob", 0.5).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 0.5)


def test_evaluate_agrees_with_its_parts(spark):
    rng = np.random.default_rng(5)
    df = scored(spark, rng.random(200), rng.random(200) < 0.4).withColumn(
        "m", (F.col("id") % 2).cast("string"))
    both = {r.m: r for r in metrics.evaluate(df, "y", "prob", 0.5, ("m",)).collect()}
    for part in metrics.binary_metrics(df, "y", "prob", 0.5, ("m",)).collect():
        for name in ("precision", "recall", "f1", "accuracy"):
            assert both[part.m][name] == pytest.approx(part[name])


def test_fold_summary_skips_missing_metrics(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, 0.7, 0.2)], "fold int, f1 double, auc double")
    got = {r.metric: (r["mean"], r["std"]) for r in
           metrics.summarize_folds(df, "fold", ["f1", "auc"]).collect()}
    assert got["f1"] == pytest.approx((0.6, 0.1)) and got["auc"] == (0.2, 0.0)


def test_best_model_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.1), (2, 1, 0.2)],
                               "cut int, model int, f1 double")
    got = metrics.best_by_metric(df, "cut", "model", "f1").orderBy("cut").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0.5), (2, 1, 0.2)]


def plain_focal(z, y, alpha=0.95, gamma=3.0):
    p = 1 / (1 + math.exp(-z))
    p_true = p if y else 1 - p
    weight = alpha if y else 1 - alpha
    return -weight * (1 - p_true) ** gamma * math.log(p_true)


@pytest.mark.parametrize("z", [-4.0, -0.3, 0.0, 2.5])
@pytest.mark.parametrize("y", [0, 1])
def test_focal_value_and_gradient(spark, z, y):
    row = spark.createDataFrame([(z, float(y))], "z double, y double").select(
        losses.focal(F.col("z"), F.col("y")),
        training.focal_gradient(F.col("z"), F.col("y"), 0.95, 3.0)).first()
    step = 1e-6
    slope = (plain_focal(z + step, y) - plain_focal(z - step, y)) / (2 * step)
    assert row[0] == pytest.approx(plain_focal(z, y))
    assert row[1] == pytest.approx(slope, rel=1e-4, abs=1e-9)


def test_losses_stay_finite_and_reduce(spark):
    df = spark.createDataFrame([(800.0, 0.0), (-800.0, 0.0)], "z double, y double")
    loss = losses.bce_with_logits(F.col("z"), F.col("y"))
    assert losses.reduce_loss(df, loss, "sum").first()[0] == 800.0
    assert losses.reduce_loss(df, loss).first()[0] == 400.0
    assert [r.loss for r in losses.reduce_loss(df, loss, "none").collect()] == [800.0, 0.0]
    weighted = losses.weighted_bce(F.lit(0.0), F.lit(1.0))
    assert df.select(weighted).first()[0] == pytest.approx(19 * math.log(2))


def test_huber_and_multitask(spark):
    df = spark.createDataFrame([(0.5, 3.0, 0.0, 0.0, 0.0, 1)],
                               "pe double, pv double, ye double, yv double, z double, y int")
    row = losses.multitask_loss(df, ("pe", "pv"), ("ye", "yv"), "z", "y").first()
    assert row.regression_loss == pytest.approx((0.125 + 2.5) / 2)
    assert row.loss == pytest.approx(0.3 * row.regression_loss
                                     + 0.7 * plain_focal(0.0, 1))


def test_zscore_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "f01 double")
    stats = scoring.feature_stats(df, ["f01"]).first().asDict()
    got = [r.z01 for r in scoring.zscore(df, stats, ["f01"]).orderBy("f01").collect()]
    assert got == pytest.approx([-1 / (1 + 1e-6), 1 / (1 + 1e-6)])
    long = scoring.long_feature_stats(df, ["f01"]).first()
    assert (long.feature, long["mean"], long["std"]) == ("f01", 2.0, 1.0)


def test_fusion_keeps_rows_without_embedding(spark):
    df = spark.createDataFrame([(1, 0), (2, 9)], "id int, k int")
    vectors = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id int, embedding array<float>")
    got = {r.id: r.text for r in scoring.join_embeddings(df, vectors, "k", "text", 2).collect()}
    assert got == {1: [1.0, 2.0], 2: [0.0, 0.0]}


def test_linear_fusion(spark):
    posts = spark.createDataFrame([(1, 5), (2, 6)], "id int, k int")
    vectors = spark.createDataFrame([(5, [1.0, 2.0])], "k int, v array<double>")
    heads = {"engagement": [1.0, 0.0], "velocity": [0.0, 1.0], "logit": [2.0, -1.0]}
    shares = scoring.project_branch(vectors, "k", "v", heads, "text")
    joined = scoring.join_branch(posts, shares, "k", "text")
    got = {r.id: r for r in scoring.fuse_linear(joined, ["text"]).collect()}
    assert got[1].engagement == pytest.approx(math.expm1(1))
    assert got[1].velocity == pytest.approx(math.expm1(2))
    assert got[1].tail_prob == got[2].tail_prob == 0.5
    assert got[2].engagement == 0.0


def test_dense_fusion_matches_numpy(spark):
    rng = np.random.default_rng(0)
    weights = scoring.mlp_weights(3, 2, 4, 8, 1)
    rows = [(i, rng.normal(size=3).tolist(), rng.normal(size=2).tolist(),
             rng.normal(size=4).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, text array<double>, video array<double>, "
                               "tabular array<double>")
    got = {r.id: r.tail_prob for r in scoring.fuse_mlp(df, weights).collect()}
    for i, text, video, tabular in rows:
        hidden = np.array(tabular) @ weights["tab_in"]
        hidden = (hidden - hidden.mean()) / np.sqrt(hidden.var() + 1e-5)
        branch = np.maximum(hidden, 0) @ weights["tab_out"]
        common = np.maximum(np.concatenate([text, video, branch]) @ weights["fuse"], 0)
        logit = np.maximum(common @ weights["logit_in"], 0) @ weights["logit_out"]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-logit)))


def test_classify_names(spark):
    df = scored(spark, [0.69, 0.7], [0, 1])
    assert [r.prediction for r in scoring.classify(df, "prob").orderBy("id").collect()] == [
        "Rest", "Top"]


def test_decode_falls_back_to_neutral_block(spark):
    df = spark.createDataFrame([(1, bytearray(b"ab")), (2, None), (3, bytearray(b""))],
                               "id bigint, video_bytes binary")

    def decoder(data):
        return [data[0], len(data)]

    got = {r.id: (r.frames, r.decoded) for r in
           scoring.decode_media(df, decoder, [0.5, 0.5]).collect()}
    assert got == {1: ([97.0, 2.0], True), 2: ([0.5, 0.5], False), 3: ([0.5, 0.5], False)}


SLOTS = [f"z{i:02d}" for i in range(1, 20)]


def permuted(spark, n, weights):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 19)), 3)
    y = (x @ np.array(weights) + rng.normal(size=n) > 0.5).astype(int)
    rows = [(i, *map(float, r), float(r @ np.array(weights)), int(t))
            for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{s} double" for s in SLOTS)
                               + ", logit double, y int")
    found = explain.permutation_importance(df, "id", SLOTS, weights, "logit", "y")
    return x, y, {r.feature: r for r in found.collect()}


def sent_to(n, j, seed=42):
    """Where feature j's value at each rank goes: Feistel rounds in plain Python."""
    a = math.ceil(math.sqrt(n))
    b = math.ceil(n / a)

    def word(k, v):
        once = (v * 1_103_515_245 + j * 104_729 + seed * 15_485_863 + k * 1_299_709) % (2**31 - 1)
        return (once * 48_271 + 12_345) % 2_147_483_629

    def rounds(x):
        row, column = divmod(x, b)
        for k in range(0, 8, 2):
            row = (row + word(k, column)) % a
            column = (column + word(k + 1, row)) % b
        return row * b + column

    out = []
    for x in range(n):
        x = rounds(x)
        while x >= n:
            x = rounds(x)
        out.append(x)
    return out


def brute_f1(truth, predicted):
    tp = int((truth & predicted).sum())
    return 2 * tp / max(1, int(truth.sum()) + int(predicted.sum()))


@pytest.mark.parametrize("n", [1, 2, 3, 19, 60, 105])
def test_permutation_equals_brute_force(spark, n):
    weights = [0.0, 2.0] + [0.3] * 17
    x, y, found = permuted(spark, n, weights)
    order = sorted(range(n), key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())
    logit = x @ np.array(weights)

    def hits(z):
        return np.round(1 / (1 + np.exp(-z)), 6) >= 0.7

    base = brute_f1(y == 1, hits(logit))
    for j, name in enumerate(FEATURE_NAMES, 1):
        donor = np.empty(n, int)
        for place, to in enumerate(sent_to(n, j)):
            donor[order[to]] = order[place]
        z = logit + weights[j - 1] * (x[donor, j - 1] - x[:, j - 1])
        assert found[name].baseline_f1 == pytest.approx(base)
        assert found[name].shuffled_f1 == pytest.approx(brute_f1(y == 1, hits(z)))
    assert found["follower_count"].importance == 0.0  # its weight is zero


@pytest.mark.parametrize("n", [1, 2, 3, 5, 97, 100, 5_000])
def test_keyed_permutations(spark, n):
    """Every key gives a permutation; they differ and are not rotations of one another."""
    sent = spark.range(n).select("id", *[ranking.permuted(F.col("id"), n, j, 7).alias(f"p{j}") for j in (1, 2, 3)])
    rows = sent.orderBy("id").collect()
    for j in (1, 2, 3):
        assert sorted(r[f"p{j}"] for r in rows) == list(range(n))
        assert [r[f"p{j}"] for r in rows] == sent_to(n, j, 7)
    if n > 90:
        shifts = {(r.p1 - r.p2) % n for r in rows}
        assert len(shifts) > n / 3 and abs(np.corrcoef([r.p1 for r in rows], [r.p2 for r in rows])[0, 1]) < 0.25


def test_shuffles_keep_nulls_and_take_empty_tables(spark):
    schema = "id bigint, z01 double, z02 double, y int, own string"
    rows = [(i, None if i % 3 else float(i), float(-i), 1, "x") for i in range(12)]
    got = explain.shuffled(spark.createDataFrame(rows, schema), "id", ["z01", "z02"], ["y", "own"]).collect()
    assert sorted((r._d1 is None, r._d1 or 0) for r in got) == sorted((r[1] is None, r[1] or 0) for r in rows)
    assert sorted(r._d2 for r in got) == sorted(r[2] for r in rows) and {r.own for r in got} == {"x"}
    assert explain.shuffled(spark.createDataFrame([], schema), "id", ["z01", "z02"], ["y"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 97, 5_000])
def test_permutations_in_tasks_equal_those_of_columns(n):
    for j in (1, 19):
        assert ranking.permuted_numbers(np.arange(n), n, j, 7).tolist() == sent_to(n, j, 7)


def test_shuffled_values_travel_packed(spark, monkeypatch):
    """No record per value, no map per row, and blocks and batches of any size give the same rows."""
    schema = "id bigint, z01 double, z02 double, own string"
    df = spark.createDataFrame([(i, None if i % 3 else float(i), -i * 1.0, f"x{i}") for i in range(300)], schema)
    found = []
    for block, sent in ((1 << 16, 1 << 15), (7, 10), (1, 1)):
        monkeypatch.setattr(explain, "BLOCK", block)
        monkeypatch.setattr(explain, "SENT", sent)
        got = explain.shuffled(df, "id", ["z01", "z02"], ["own"])
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "collect_list" not in plan
        found.append(sorted(map(tuple, got.collect()), key=str))
    assert found[0] == found[1] == found[2] and len(found[0]) == 300


def test_vectors_do_not_travel_with_shuffled_values(spark, monkeypatch):
    """What text and video add is taken first; the logits are those of the whole network."""
    w = scoring.mlp_weights(6, 5, 2, 4, 3)
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(size=2)), i % 2, rng.normal(size=6).tolist(), rng.normal(size=5).tolist())
            for i in range(40)]
    df = spark.createDataFrame(rows, "id long, z01 double, z02 double, y int, text array<double>, video array<double>")
    tabular = df.withColumn("tabular", F.array("z01", "z02"))
    whole = scoring.variant_logits(tabular, w, ["id"], lambda v: [(v["text"], v["video"], v["tabular"])],
                                   ["text", "video", "tabular"]).collect()
    shares = scoring.branch_share(tabular, w, ["id", "tabular"], "share")
    parts = scoring.variant_logits(shares, w, ["id"], lambda v: [(None, None, v["tabular"])], ["tabular"], "share")
    assert {r.id: r.logits for r in parts.collect()} == {r.id: pytest.approx(r.logits, abs=1e-12) for r in whole}
    carried, real = [], explain.shuffled
    monkeypatch.setattr(explain, "shuffled", lambda d, k, s, c, seed: carried.extend(c) or real(d, k, s, c, seed))
    found = explain.network_importance(df, "id", ["z01", "z02"], w, "y", names=("a", "b")).collect()
    assert carried == ["share", "y"] and len(found) == 2


def test_ablation_of_an_unused_branch_changes_nothing(spark):
    df = scored(spark, [0.1, 0.6, 0.8, 0.9], [0, 1, 0, 1]).withColumn("z", F.col("prob") * 4 - 2)
    rows = {r.condition: tuple(r)[1:] for r in explain.ablate(
        df, {"full": F.col("z"), "same": F.col("z") + 0, "none": F.lit(0.0)}, "y").collect()}
    assert rows["full"] == rows["same"] == pytest.approx((0.75, 5 / 6, 0.5), abs=1e-6)
    assert rows["none"] == pytest.approx((0.5, 0.5, 0.0))


def test_examples_fall_back_by_position(spark):
    df = scored(spark, [0.9, 0.9, 0.1, 0.1], [1, 1, 0, 0])
    got = {r.category: r.id for r in explain.confusion_examples(df, "id", "y", "prob").collect()}
    assert got == {"True Positive": 0, "True Negative": 2, "Misclassification": 2}
    captions = spark.createDataFrame([(0, "c" * 99)], "id bigint, caption string")
    shown = explain.with_captions(explain.confusion_examples(df, "id", "y", "prob"), captions,
                                  "id", "caption").collect()
    assert {r.category: r.caption for r in shown} == {
        "True Positive": "c" * 80, "True Negative": "(no description)",
        "Misclassification": "(no description)"}


@pytest.mark.parametrize("heavy", [0, 1, 2])
def test_token_windows_do_not_depend_on_the_heavy_words(spark, monkeypatch, heavy):
    monkeypatch.setattr(tokens, "HEAVY", heavy)
    docs = spark.createDataFrame([(1, "b a b zzz"), (2, None)], "id int, text string")
    vocab = spark.createDataFrame([("b", 2), ("a", 3)], "token string, token_id long")
    got = {r.id: r.input_ids for r in tokens.token_windows(docs, "id", "text", vocab, 5).collect()}
    assert got == {1: [2, 3, 2, 1, 0], 2: [0] * 5}


def test_weight_norms_are_sorted(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 4.0), ("b", 6.0)], "f string, w double")
    assert [tuple(r) for r in explain.weight_norms(df, "f", "w").collect()] == [
        ("b", 6.0), ("a", 5.0)]


def test_token_windows(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, " "), (3, "a b a b c"), (4, None)],
                                 "id int, text string")
    vocab = tokens.vocabulary(docs, "text")
    assert {r.token: r.token_id for r in vocab.collect()} == {"b": 2, "a": 3, "c": 4}
    got = {r.id: r for r in tokens.token_windows(docs, "id", "text", vocab, 4).collect()}
    assert got[1].input_ids == [2, 3, 2, 0] and got[1].attention_mask == [1, 1, 1, 0]
    assert got[2].input_ids == [0] * 4 and got[4].n_tokens == 0
    assert got[3].input_ids == [3, 2, 3, 2] and got[3].attention_mask == [1] * 4
    wide = tokens.token_windows(docs, "id", "text", vocab, 5)
    assert wide.where("id = 3").first().input_ids[4] == 4  # no word is left out of the vocabulary


def test_row_accounting(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    got = {r.stage: r.n_rows for r in reshape.drop_accounting(df, {"kept": F.col("v") > 1}).collect()}
    assert got == {"read": 3, "kept": 1, "dropped": 2}


def training_rows(spark, n=400):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 1.2).astype(int)
    return spark.createDataFrame([(float(a), float(b), int(t), float(2 * a + 1))
                                  for (a, b), t in zip(x, y)],
                                 "a double, b double, y int, target double")


def test_weighted_fit_finds_the_positives(spark):
    rows = training_rows(spark)
    model = training.train_weighted(rows, ["a", "b"], "y", maxIter=30)
    scored_rows = training.probability_of_one(model.transform(training.assemble(rows, ["a", "b"])))
    assert metrics.binary_metrics(scored_rows, "y", "prob").first().recall > 0.9


def test_focal_training_lowers_the_loss(spark):
    weights, bias, history = training.train_focal(training_rows(spark), ["a", "b"], "y", steps=6)
    assert history[-1] < history[0] and weights[0] > abs(weights[1])


def test_huber_fit_recovers_a_line(spark):
    rows = training_rows(spark)
    model = training.train_huber(rows, ["a", "b"], ["target"], maxIter=50)["target"]
    assert model.coefficients.toArray() == pytest.approx([2.0, 0.0], abs=0.05)


def test_timecut_run_and_fallback(spark, tmp_path):
    rows = [(e, 24000 + m, float((e + m) % 5), int((e + m) % 5 == 0) if m < 24 else 0)
            for e in range(8) for m in range(30)]
    df = spark.createDataFrame(rows, "user bigint, month int, x double, label int")
    spec = grid.TemporalSpec(24000, 24029, feature_window=3, update_freq=6,
                             max_history_months=12, h=1)
    models = {"logistic": {"regParam": (0.1,), "maxIter": (3,)}, training.MEAN: {}}
    results = training.run_timecuts(df, "user", "month", "label", ["x"], spec, models,
                                    str(tmp_path))
    got = results.collect()
    assert {r.model_id for r in got} == {"m000", "m001"}
    per_cut = {}
    for r in got:
        per_cut.setdefault((r.timecut, r.model_id), set()).add(r.p)
    assert all(len(v) == 1 for (cut, m), v in per_cut.items() if m == "m001")
    assert any(len(v) > 1 for (cut, m), v in per_cut.items() if m == "m000")
    assert any(path.name == "m000" for path in tmp_path.glob("*/*"))
    assert all(r.fallback for r in got if r.model_id == "m001")
    # Cuts whose training rows are all of one class take the mean for every model.
    assert {len(v) == 1 for (cut, m), v in per_cut.items() if m == "m000"} == {True, False} or any(
        not r.fallback for r in got if r.model_id == "m000")
    wide = training.wide_results(results, "user", ["m000", "m001"])
    assert wide.count() * 2 == len(got)


def test_a_failing_fit_fails_the_run(spark):
    rows = [(e, 24000 + m, float((e + m) % 5), int((e + m) % 5 == 0)) for e in range(8) for m in range(30)]
    df = spark.createDataFrame(rows, "user bigint, month int, x double, label int")
    spec = grid.TemporalSpec(24000, 24029, feature_window=3, update_freq=6, max_history_months=12, h=1)
    with pytest.raises(Exception):
        training.run_timecuts(df, "user", "month", "label", ["x"], spec, {"boosted": {"maxIter": (-1,)}})


def test_saved_models_predict_the_same_after_reloading(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel
    from postlift.sources.sinks import save_model
    rows = training_rows(spark).withColumn("y", (F.col("target") > 0).cast("int"))
    model = training.train_weighted(rows, ["a", "b"], "y", maxIter=5)
    path = save_model(model, str(tmp_path), "24000", "m000")
    again = LogisticRegressionModel.load(path)
    assert again.coefficients == model.coefficients and again.intercept == model.intercept


def test_best_models_by_f1(spark):
    rows = [(1, "m000", 1, 0.9), (1, "m000", 0, 0.1), (1, "m001", 1, 0.1), (2, "m000", 1, 0.9), (2, "m001", 1, 0.9)]
    df = spark.createDataFrame(rows, "timecut int, model_id string, ytrue int, p double")
    got = {r.timecut: (r.model_id, r.f1) for r in training.best_models(df).collect()}
    assert got == {1: ("m000", 1.0), 2: ("m000", 1.0)}


def test_timecut_run_without_cuts(spark):
    df = spark.createDataFrame([(1, 24000, 1.0, 0)], "user bigint, month int, x double, label int")
    got = training.run_timecuts(df, "user", "month", "label", ["x"],
                                grid.TemporalSpec(24000, 24000), {"logistic": {"maxIter": (1,)}})
    assert got.count() == 0
