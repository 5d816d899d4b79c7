"""Standardisation, scoring, evaluation, explanation and training."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import scores
from ..operators import (experiment, explain, labels, losses, metrics, reshape, scoring, splits, training)
from ..session import materialize, scratch_path
from ..sources import grid, sinks
from . import fixtures as fx
from .oracle_ctes import sql
from .registry import ORACLES, query

_SLOTS = [f"{i:02d}" for i in range(1, 20)]
_DIM = 64


@query("q_feature_stats", sql(" UNION ALL ".join(
    f"SELECT 'f{i}' AS feature, round(m{i}, 6) AS mean, round(s{i}, 6) AS std FROM fstats"
    for i in _SLOTS), "fstats"))
def feature_stats(spark, sf):
    stored = fx.stored_features(spark, sf)
    long = scoring.long_feature_stats(stored.where("split = 'train'"))
    return long.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("q_zscore", sql("SELECT id, split, " + ", ".join(f"z{i}" for i in _SLOTS) + " FROM zed",
                       "zed"))
def zscore(spark, sf):
    return fx.standardized(spark, sf).select("id", "split", *fx.ZSLOTS)


_RATES = """
SELECT {by}round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM (
  SELECT {by}CAST(sum(CASE WHEN y AND p THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
    CAST(sum(CASE WHEN NOT y AND p THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
    CAST(sum(CASE WHEN y AND NOT p THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
    CAST(sum(CASE WHEN NOT y AND NOT p THEN 1 ELSE 0 END) AS DOUBLE) AS tn
  FROM ({rows}) GROUP BY ALL)"""


def _round_all(df, *keep):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


@query("q_binary_metrics", sql(_RATES.format(
    by="threshold, ", rows="SELECT is_tail = 1 AS y, prob >= threshold AS p, threshold "
    "FROM scored, (VALUES (0.5e0), (0.7e0)) t(threshold)"), "scored"))
def binary_metrics(spark, sf):
    rows = fx.scored(spark, sf).select("is_tail", "prob")
    cuts = grid.with_options(rows, {"threshold": (SETTINGS.confidence,
                                                  SETTINGS.analysis_confidence)})
    counts = metrics.confusion_counts(cuts, "is_tail", F.col("prob") >= F.col("threshold"),
                                      ("threshold",))
    return _round_all(metrics.rates(counts, ("threshold",)), "threshold")


_CURVE = """
points AS (SELECT {by}prob, CAST(sum(is_tail) AS DOUBLE) AS pos,
  CAST(sum(1 - is_tail) AS DOUBLE) AS neg FROM {rows} GROUP BY ALL),
curve AS (SELECT *, sum(pos) OVER ({part}ORDER BY prob DESC) AS cp,
  sum(neg) OVER ({part}ORDER BY prob DESC) AS cn FROM points)"""


@query("q_roc_auc", sql("@", "scored").replace("\n@", ","
       + _CURVE.format(by="split, ", rows="scored", part="PARTITION BY split ") + """
SELECT split, round(sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc
FROM curve GROUP BY 1"""))
def roc_auc(spark, sf):
    rows = fx.scored(spark, sf)
    return metrics.curve_metrics(rows, "is_tail", "prob", ("split",)).select(
        "split", F.round("roc_auc", 6).alias("roc_auc"))


@query("q_pr_auc", sql("@", "scored").replace("\n@", ","
       + _CURVE.format(by="split, ", rows="scored", part="PARTITION BY split ") + """
SELECT split, round(sum(pos * cp / (cp + cn)) / sum(pos), 6) AS average_precision
FROM curve GROUP BY 1"""))
def pr_auc(spark, sf):
    rows = fx.scored(spark, sf)
    return metrics.curve_metrics(rows, "is_tail", "prob", ("split",)).select(
        "split", F.round("average_precision", 6).alias("average_precision"))


# Nearly all scores lie close to 0, as they do for a rare class.
_FINE = "fine AS MATERIALIZED (SELECT split, is_tail, 1 / (1 + exp(20 - logit)) AS prob FROM scored)"


def _fine(spark, sf):
    return fx.scored(spark, sf).select("split", "is_tail", scores.logistic(
        F.col("logit") - 20).alias("prob"))


@query("q_roc_auc_fine", sql("@", "scored").replace("\n@", f",\n{_FINE},"
       + _CURVE.format(by="split, ", rows="fine", part="PARTITION BY split ") + """
SELECT split, round(sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc
FROM curve GROUP BY 1"""))
def roc_auc_fine(spark, sf):
    return metrics.curve_metrics(_fine(spark, sf), "is_tail", "prob", ("split",)).select(
        "split", F.round("roc_auc", 6).alias("roc_auc"))


@query("q_pr_auc_fine", sql("@", "scored").replace("\n@", f",\n{_FINE},"
       + _CURVE.format(by="split, ", rows="fine", part="PARTITION BY split ") + """
SELECT split, round(sum(pos * cp / (cp + cn)) / sum(pos), 6) AS average_precision
FROM curve GROUP BY 1"""))
def pr_auc_fine(spark, sf):
    return metrics.curve_metrics(_fine(spark, sf), "is_tail", "prob", ("split",)).select(
        "split", F.round("average_precision", 6).alias("average_precision"))


def _scored_folds(spark, sf):
    rows = fx.scored(spark, sf).select("id", "create_time", "is_tail", "prob")
    return splits.time_folds(materialize(rows, "scored"))


_FOLD_RATES = _RATES.format(by="fold, ", rows="SELECT is_tail = 1 AS y, prob >= 0.5 AS p, fold "
                            "FROM folds WHERE part = 'val'")


@query("q_cv_summary", sql(
    "SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM ("
    f"UNPIVOT ({_FOLD_RATES.replace(', 6)', ', 12)')}) ON precision, recall, f1, accuracy "
    "INTO NAME metric VALUE value) GROUP BY 1", "folds"))
def cv_summary(spark, sf):
    val = _scored_folds(spark, sf).where("part = 'val'")
    per_fold = metrics.binary_metrics(val, "is_tail", "prob", by=("fold",))
    return _round_all(metrics.summarize_folds(
        per_fold, "fold", ["precision", "recall", "f1", "accuracy"]), "metric")


@query("q_best_model", sql("""
SELECT fold, arg_max(model_no, (f1, -model_no)) AS model_no, max(f1) AS f1 FROM (""" + _RATES.format(
    by="fold, model_no, ", rows="SELECT is_tail = 1 AS y, prob >= threshold AS p, fold, model_no "
    "FROM folds, (VALUES (0, 0.5e0), (1, 0.7e0), (2, 0.9e0)) m(model_no, threshold) "
    "WHERE part = 'val'") + ") GROUP BY 1", "folds"))
def best_model(spark, sf):
    val = _scored_folds(spark, sf).where("part = 'val'")
    models = F.array(*[F.struct(F.lit(i).alias("model_no"), F.lit(t).alias("threshold"))
                       for i, t in enumerate((0.5, 0.7, 0.9))])
    runs = val.withColumn("m", F.explode(models)).select("*", "m.*")
    by = ("fold", "model_no")
    counts = metrics.confusion_counts(runs, "is_tail", F.col("prob") >= F.col("threshold"), by)
    return metrics.best_by_metric(_round_all(metrics.rates(counts, by), *by), "fold", "model_no",
                                  "f1")


_BCE = "greatest(logit, 0) - logit * is_tail + ln(1 + exp(-abs(logit)))"
_SIG = "(1 / (1 + exp(-logit)))"
_FOCAL = (f"(is_tail * 0.95e0 + (1 - is_tail) * 0.05e0) * pow(is_tail * (1 - {_SIG}) "
          f"+ (1 - is_tail) * {_SIG}, 3.0e0) * ({_BCE})")


@query("q_focal_loss", sql(f"""
SELECT split, count(*) AS n, round(avg({_FOCAL}), 6) AS mean_loss,
  round(sum({_FOCAL}), 6) AS sum_loss FROM scored GROUP BY 1""", "scored"))
def focal_loss(spark, sf):
    loss = losses.focal(F.col("logit"), F.col("is_tail").cast("double"))
    return fx.scored(spark, sf).groupBy("split").agg(
        F.count("*").alias("n"), F.round(F.avg(loss), 6).alias("mean_loss"),
        F.round(F.sum(loss), 6).alias("sum_loss"))


@query("q_weighted_bce", sql(f"""
SELECT split, round(avg((is_tail * 19 + (1 - is_tail)) * ({_BCE})), 6) AS loss
FROM scored GROUP BY 1""", "scored"))
def weighted_bce(spark, sf):
    loss = losses.weighted_bce(F.col("logit"), F.col("is_tail").cast("double"))
    return fx.scored(spark, sf).groupBy("split").agg(F.round(F.avg(loss), 6).alias("loss"))


_HUBER = ("CASE WHEN abs({p} - {y}) <= 1 THEN 0.5e0 * ({p} - {y}) * ({p} - {y}) "
          "ELSE abs({p} - {y}) - 0.5e0 END")


@query("q_multitask_loss", sql(f"""
SELECT round(r, 6) AS regression_loss, round(c, 6) AS classification_loss,
  round(0.3e0 * r + 0.7e0 * c, 6) AS loss FROM (
  SELECT avg(({_HUBER.format(p='0.5e0 * ye + 0.01e0', y='ye')}
    + {_HUBER.format(p='0.8e0 * yv', y='yv')}) / 2) AS r, avg({_FOCAL}) AS c
  FROM (SELECT *, ln(1 + e) AS ye, ln(1 + v) AS yv FROM scored))""", "scored"))
def multitask_loss(spark, sf):
    rows = fx.scored(spark, sf).withColumns({
        "ye": scores.log_count(F.col("engagement_score")),
        "yv": scores.log_count(F.col("view_velocity_score"))}).withColumns({
            "pe": F.col("ye") * 0.5 + 0.01, "pv": F.col("yv") * 0.8})
    return _round_all(losses.multitask_loss(rows, ("pe", "pv"), ("ye", "yv"), "logit", "is_tail"))


@query("q_classify", sql("""
SELECT id, prob, CASE WHEN prob >= 0.7 THEN 'Top' ELSE 'Rest' END AS prediction
FROM scored""", "scored"))
def classify(spark, sf):
    return scoring.classify(fx.scored(spark, sf).select("id", "prob"), "prob")


@query("q_regression_rule", sql("""
SELECT id, CAST(CASE WHEN round((exp(le) - 1) / tme + (exp(lv) - 1) / tmv, 9) >= tt
  THEN 1 ELSE 0 END AS BIGINT) AS prediction
FROM (SELECT id, round(ln(1 + e) * (1 + 0.1e0 * sin(id)), 6) AS le,
    round(ln(1 + v) * (1 - 0.1e0 * cos(id)), 6) AS lv FROM feat),
  (SELECT max(e) AS tme, max(v) AS tmv FROM feat WHERE split = 'train') tm,
  (SELECT round(quantile_cont(round(e / ame + v / amv, 9), 0.95), 9) AS tt FROM feat,
    (SELECT max(e) AS ame, max(v) AS amv FROM feat WHERE split = 'train')
    WHERE split = 'train') tq""", "feat"))
def regression_rule(spark, sf):
    rows = splits.random_split(fx.stored_scores(spark, sf))
    stats = labels.tail_stats(rows.where("split = 'train'"))
    e, v = (scores.log_count(F.col(c)) for c in ("engagement_score", "view_velocity_score"))
    guesses = rows.select("id", F.round(e * (1 + 0.1 * F.sin("id")), 6).alias("le"),
                          F.round(v * (1 - 0.1 * F.cos("id")), 6).alias("lv"))
    return labels.regression_rule(guesses, stats, "le", "lv").select("id", "prediction")


def _head_weights(head, n, shift):
    return [math.sin((head + 1) * (i + shift)) / 8 for i in range(1, n + 1)]


_HEADS = scoring.HEADS
_BRANCHES = {
    "text": {h: _head_weights(k, _DIM, 0) for k, h in enumerate(_HEADS)},
    "video": {h: _head_weights(k, _DIM, 100) for k, h in enumerate(_HEADS)},
    "tabular": {h: _head_weights(k, 19, 200) for k, h in enumerate(_HEADS)},
}


def _keyed(spark, sf, *columns):
    """Standardised posts with the keys of their text and video vectors."""
    n = fx.count_of(spark, sf, "embeddings")
    return fx.standardized(spark, sf).select(
        "id", "is_tail", *columns, (F.col("id") % n).alias("_text"),
        ((F.col("id") * 7 + 3) % n).alias("_video"))


def _branch_shares(spark, sf):
    """Posts with every branch's share of every head."""
    tabular = [scoring.dot(fx.ZSLOTS, _BRANCHES["tabular"][h]).alias(f"tabular_{h}")
               for h in _HEADS]
    posts = _keyed(spark, sf, *tabular)
    for branch in ("text", "video"):
        shares = scoring.project_branch(
            fx.table(spark, sf, "embeddings").withColumnRenamed("vec_id", f"_{branch}"),
            f"_{branch}", "embedding", _BRANCHES[branch], branch)
        posts = scoring.join_branch(posts, shares, f"_{branch}", branch)
    return posts


def _modalities(spark, sf, *columns):
    """Posts with a text, a video and a tabular vector each."""
    keyed = _keyed(spark, sf, *columns, F.array(*fx.ZSLOTS).alias("tabular"))
    vectors = fx.table(spark, sf, "embeddings")
    texted = scoring.join_embeddings(keyed, vectors, "_text", "text", _DIM)
    return scoring.join_embeddings(texted, vectors, "_video", "video", _DIM)


def _branch_sql(column, shift, head):
    return (f"list_sum(list_transform({column}, lambda x, i: CAST(x AS DOUBLE) "
            f"* sin({head + 1} * (i + {shift})) / 8))")


_FUSED = ("SELECT s.*, "
          + ", ".join(f"{_branch_sql('t.embedding', 0, k)} AS {h}_text, "
                      f"{_branch_sql('w.embedding', 100, k)} AS {h}_video, "
                      f"{_branch_sql('s.tabular', 200, k)} AS {h}_tabular"
                      for k, h in enumerate(_HEADS))
          + " FROM (SELECT id, is_tail, [" + ", ".join(f"z{i}" for i in _SLOTS) + "] AS tabular "
          "FROM zed) s JOIN embeddings t ON t.vec_id = s.id % (SELECT count(*) FROM embeddings) "
          "JOIN embeddings w ON w.vec_id = (7 * s.id + 3) % (SELECT count(*) FROM embeddings)")


@query("q_late_fusion", sql(f"""
SELECT id, round(exp(engagement_text + engagement_video + engagement_tabular) - 1, 6) AS engagement,
  round(exp(velocity_text + velocity_video + velocity_tabular) - 1, 6) AS velocity,
  round(1 / (1 + exp(-(logit_text + logit_video + logit_tabular))), 6) AS tail_prob
FROM ({_FUSED})""", "zed"))
def late_fusion(spark, sf):
    fused = scoring.fuse_linear(_branch_shares(spark, sf), ["text", "video", "tabular"])
    return _round_all(fused.select("id", "engagement", "velocity", "tail_prob"), "id")


# Sine weights of the dense layers: rows and columns of each, in a fixed order.
_HIDDEN = 8
_LAYERS = {"tab_in": (19, _HIDDEN), "tab_out": (_HIDDEN, _HIDDEN),
           "fuse": (2 * _DIM + _HIDDEN, _HIDDEN),
           **{f"{h}_{part}": (_HIDDEN, _HIDDEN // 2) if part == "in" else (_HIDDEN // 2, 1)
              for h in _HEADS for part in ("in", "out")}}


def _network():
    """The network's weights: sin(k * row + 0.37 * column) over the root of the rows."""
    w = {}
    for k, (name, (rows, cols)) in enumerate(_LAYERS.items(), 1):
        i, j = np.arange(1, rows + 1)[:, None], np.arange(1, cols + 1)[None, :]
        w[name] = np.sin(k * i + 0.37 * j) / math.sqrt(rows)
        if cols == 1:
            w[name] = w[name][:, 0]
    return w | {"tab_in_b": np.zeros(_HIDDEN), "norm_scale": np.ones(_HIDDEN),
                "norm_shift": np.zeros(_HIDDEN), "tab_out_b": np.zeros(_HIDDEN),
                "fuse_b": np.zeros(_HIDDEN)}


def _layer_sql(name):
    """DuckDB: the layer as one list of input weights per output."""
    k, (rows, cols) = list(_LAYERS).index(name) + 1, _LAYERS[name]
    return (f"(SELECT list(w ORDER BY j) FROM (SELECT j, list(sin({k} * i + 0.37e0 * j) "
            f"/ sqrt({rows}.0e0) ORDER BY i) AS w FROM range(1, {rows + 1}) a(i), "
            f"range(1, {cols + 1}) b(j) GROUP BY j)) AS {name}")


_NET = ("net AS MATERIALIZED (SELECT " + ", ".join(map(_layer_sql, _LAYERS)) + "), "
        f"late AS MATERIALIZED (SELECT * EXCLUDE (fuse), list_transform(fuse, lambda w: "
        f"w[{2 * _DIM + 1}:]) AS fuse_tab FROM net)")


def _dense(x, layer):
    return f"list_transform({layer}, lambda w: list_dot_product({x}, w))"


def _relu(x):
    return f"list_transform({x}, lambda r: greatest(r, 0.0e0))"


def _base_sql(source):
    """DuckDB: ``source`` with what text and video (null: left out) add to the fused layer."""
    zero = f"list_transform(range({_DIM}), lambda q: 0.0e0)"
    joined = f"list_concat(coalesce(text, {zero}), coalesce(video, {zero}))"
    part = f"list_transform(fuse, lambda w: list_dot_product({joined}, w[1:{2 * _DIM}]))"
    return f"(SELECT {source}.* EXCLUDE (text, video), {part} AS base FROM {source}, net)"


def _steps_sql(source, last):
    """DuckDB: ``source`` (base, tabular; null leaves out) through the network up to ``last``."""
    added = ("list_transform(fuse_tab, lambda w, k: base[k] + CASE WHEN tabular IS NULL THEN 0 "
             "ELSE 1 END * list_dot_product(branch, w))")
    return f"""(SELECT *, {last} FROM (SELECT *, {_relu(added)} AS common
    FROM (SELECT *, {_dense(_relu(
        'list_transform(h, lambda c: (c - mu) / sqrt(va + 1e-5))'), 'tab_out')} AS branch
    FROM (SELECT *, list_avg(list_transform(h, lambda c: (c - mu) * (c - mu))) AS va
    FROM (SELECT *, list_avg(h) AS mu FROM (SELECT *, {_dense('coalesce(tabular, list_transform(range(19), lambda q: 0.0e0))', 'tab_in')} AS h
    FROM {source}, late))))))"""


def _head_sql(head):
    return f"list_dot_product({_relu(_dense('common', f'{head}_in'))}, {head}_out[1]) AS {head}"


_TRIPLES = """triples AS MATERIALIZED (SELECT s.id, s.is_tail, r, n,
  list_transform(t.embedding, lambda x: CAST(x AS DOUBLE)) AS text,
  list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)) AS video, tabular FROM (
  SELECT id, is_tail, [""" + ", ".join(f"z{i}" for i in _SLOTS) + """] AS tabular,
    row_number() OVER (ORDER BY md5(concat(id, '|42'))) - 1 AS r, count(*) OVER () AS n
  FROM zed) s
  JOIN embeddings t ON t.vec_id = s.id % (SELECT count(*) FROM embeddings)
  JOIN embeddings v ON v.vec_id = (7 * s.id + 3) % (SELECT count(*) FROM embeddings))"""


@query("q_late_fusion_mlp", sql("@", "zed").replace("\n@", f""",
{_NET}, {_TRIPLES}
SELECT id, round(exp(engagement) - 1, 6) AS engagement, round(exp(velocity) - 1, 6) AS velocity,
  round(1 / (1 + exp(-logit)), 6) AS tail_prob
FROM {_steps_sql(_base_sql('triples'), ', '.join(map(_head_sql, _HEADS)))}"""))
def late_fusion_mlp(spark, sf):
    return _round_all(scoring.fuse_mlp(_modalities(spark, sf), _network()), "id")


_ABLATED = {"Full Model": ("text", "video", "tabular"), "Zero Text": ("video", "tabular"),
            "Zero Video": ("text", "tabular"), "Zero Tabular": ("text", "video")}


@query("q_ablation", sql("@", "zed").replace("\n@", f""",
fused AS MATERIALIZED ({_FUSED}),
cases AS MATERIALIZED (""" + " UNION ALL ".join(
    f"SELECT '{name}' AS condition, is_tail, 1 / (1 + exp(-round("
    + " + ".join(f"logit_{b}" for b in kept) + ", 9))) AS prob FROM fused"
    for name, kept in _ABLATED.items()) + ")," + _CURVE.format(
        by="condition, ", rows="cases", part="PARTITION BY condition ") + """
SELECT condition, round(roc, 6) AS roc_auc, round(ap, 6) AS average_precision, f1 FROM (
  SELECT condition, sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)) AS roc,
    sum(pos * cp / (cp + cn)) / sum(pos) AS ap FROM curve GROUP BY 1)
JOIN (SELECT condition, f1 FROM (""" + _RATES.format(
        by="condition, ", rows="SELECT condition, is_tail = 1 AS y, prob >= 0.7 AS p FROM cases")
    + ")) USING (condition)"))
def ablation(spark, sf):
    # The scorer's logits are defined at nine decimals; nothing is rounded after that.
    conditions = {name: F.round(sum((F.col(f"{b}_logit") for b in kept[1:]),
                                    F.col(f"{kept[0]}_logit")), 9)
                  for name, kept in _ABLATED.items()}
    found = explain.ablate(_branch_shares(spark, sf), conditions, "is_tail")
    return _round_all(found, "condition")


@query("q_ablation_wide", " UNION ALL ".join(
    f"SELECT '{metric}' AS metric, " + ", ".join(
        f"max(CASE WHEN condition = '{name}' THEN {metric} END) AS \"{name}\""
        for name in _ABLATED) + f" FROM ({ORACLES['q_ablation']})"
    for metric in ("roc_auc", "average_precision", "f1")))
def ablation_wide(spark, sf):
    long = ablation(spark, sf).unpivot(["condition"], ["roc_auc", "average_precision", "f1"],
                                       "metric", "value")
    return reshape.pivot_metrics(long, "metric", "condition", "value", list(_ABLATED))


def _sent_sql(x):
    """Where the permutation of key j over the grid of a x b numbers sends x.

    Eight turns move row and column by turns; the two are one number, the row times 2**32.
    """
    two = 4294967296
    row, column = f"(s // {two})", f"(s % {two})"
    word = ("((({v} * 1103515245 + j * 104729 + 42 * 15485863 + k * 1299709) % 2147483647 * 48271 + 12345) "
            "% 2147483629)")
    return f"""list_transform([list_reduce(list_concat([CAST({x} AS BIGINT) // b * {two} + CAST({x} AS BIGINT) % b],
      range(8)), lambda s, k: CASE WHEN k % 2 = 0 THEN ({row} + {word.format(v=column)}) % a * {two} + {column}
        ELSE {row} * {two} + ({column} + {word.format(v=row)}) % b END)], lambda s: {row} * b + {column})[1]"""


# (j, r, to): the rank to which the value of feature j at rank r goes, sent on while beyond the last.
_SHUFFLE = f""",
ordered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5(concat(id, '|42'))) - 1 AS r,
  count(*) OVER () AS n FROM @),
grid AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT max(n) AS n, CAST(ceil(sqrt(max(n))) AS BIGINT) AS a FROM ordered)),
once AS MATERIALIZED (SELECT j, r, n, a, b, {_sent_sql('r')} AS x FROM ordered, (SELECT a, b FROM grid), range(1, 20) t(j)),
walk AS (SELECT j, r, n, a, b, x FROM once WHERE x >= n
  UNION ALL SELECT j, r, n, a, b, {_sent_sql('x')} FROM walk WHERE x >= n),
places AS MATERIALIZED (SELECT j, r, x AS "to" FROM once WHERE x < n UNION ALL SELECT j, r, x FROM walk WHERE x < n),
"""


@query("q_permutation_importance", sql("@", "scored").replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "\n@", _SHUFFLE.replace("@", "scored") + """
cases AS MATERIALIZED (SELECT 0 AS j, is_tail = 1 AS y, 1 / (1 + exp(-logit)) >= 0.7 AS p
  FROM ordered UNION ALL
""" + " UNION ALL ".join(
    f"SELECT {int(i)}, a.is_tail = 1, 1 / (1 + exp(-(a.logit + sin({int(i)}) "
    f"* (b.z{i} - a.z{i})))) >= 0.7 FROM ordered a JOIN places ON j = {int(i)} AND \"to\" = a.r "
    "JOIN ordered b ON b.r = places.r"
    for i in _SLOTS) + "), f AS (" + _RATES.format(by="j, ", rows="SELECT * FROM cases") + """)
SELECT name AS feature, base.f1 AS baseline_f1, f.f1 AS shuffled_f1,
  round(base.f1 - f.f1, 6) AS importance
FROM f JOIN (VALUES """ + ", ".join(
        f"({j}, '{name}')" for j, name in enumerate(explain.FEATURE_NAMES, 1)) + """) t(k, name)
  ON k = f.j, (SELECT f1 FROM f WHERE j = 0) base"""))
def permutation_importance(spark, sf):
    rows = fx.scored(spark, sf)
    found = explain.permutation_importance(rows, "id", fx.ZSLOTS, fx.WEIGHTS, "logit", "is_tail")
    rounded = found.withColumns({c: F.round(c, 6) for c in ("baseline_f1", "shuffled_f1")})
    return rounded.withColumn("importance",
                              F.round(F.col("baseline_f1") - F.col("shuffled_f1"), 6))


@query("q_confusion_examples", sql("@", "scored").replace("\n@", """,
kinds AS (SELECT id, is_tail, prob, CASE WHEN is_tail = 1 AND prob >= 0.7 THEN 'True Positive'
  WHEN is_tail = 0 AND prob < 0.7 THEN 'True Negative' ELSE 'Misclassification' END AS category
  FROM scored WHERE split = 'test'),
found AS (SELECT category, min(id) AS id FROM kinds GROUP BY 1),
spare AS (SELECT id, CASE row_number() OVER (ORDER BY id) WHEN 1 THEN 'True Positive'
  WHEN 2 THEN 'True Negative' ELSE 'Misclassification' END AS category
  FROM (SELECT id FROM kinds ORDER BY id LIMIT 3)),
picked AS (SELECT category, coalesce(found.id, spare.id) AS id FROM spare
  LEFT JOIN found USING (category))
SELECT p.category, p.id, CASE WHEN is_tail = 1 THEN 'Top' ELSE 'Rest' END AS ground_truth,
  prob AS tail_prob, CASE WHEN prob >= 0.7 THEN 'Top' ELSE 'Rest' END AS predicted,
  CASE WHEN substring(coalesce(text, ''), 1, 80) = '' THEN '(no description)'
    ELSE substring(text, 1, 80) END AS caption
FROM picked p JOIN kinds k ON k.id = p.id
  LEFT JOIN documents ON doc_id = p.id % (SELECT count(*) FROM documents)"""))
def confusion_examples(spark, sf):
    test = fx.scored(spark, sf).where("split = 'test'").select("id", "is_tail", "prob")
    picked = explain.confusion_examples(test, "id", "is_tail", "prob")
    ids = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    wanted = ids.join(F.broadcast(picked.select("id").distinct()), "id", "left_semi")
    return explain.with_captions(picked, fx.with_captions(spark, sf, wanted), "id", "description")


def _train_rows(spark, sf):
    """Training rows: stored features, standardised as they are read."""
    return fx.standardized(spark, sf).where("split = 'train'")


def _slopes(spark, rows, models):
    """(model, feature, n, gradient) from one aggregate of the named slope columns."""
    sums = rows.agg(F.count("*").alias("n"), *[
        F.round(F.avg(F.col(m) * (F.col(c) if c else F.lit(1.0))), 3).alias(f"{m}_{c or 'bias'}")
        for m in models for c in (*fx.ZSLOTS, "")])
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c or "bias").alias("feature"),
                               # Adding 0.0 takes the sign off a zero.
                               (F.col(f"{m}_{c or 'bias'}") + 0.0).alias("gradient"))
                      for m in models for c in (*fx.ZSLOTS, "")])
    return sums.select("n", F.explode(cells).alias("c")).select("n", "c.*")


def _slopes_sql(*models):
    names = [f"z{i}" for i in _SLOTS] + ["bias"]
    return sql("SELECT m AS model, f AS feature, n, 0.0e0 AS gradient FROM (SELECT count(*) AS n "
               "FROM zed WHERE split = 'train'), (VALUES "
               + ", ".join(f"('{m}', '{f}')" for m in models for f in names) + ") t(m, f)", "zed")


@query("q_train_weighted", _slopes_sql("weighted"))
def train_weighted(spark, sf):
    """A converged fit: the mean weighted gradient vanishes in every coefficient."""
    rows = _train_rows(spark, sf)
    model = training.train_weighted(rows, fx.ZSLOTS, "is_tail", maxIter=500, tol=1e-10)
    z = scoring.dot(fx.ZSLOTS, [float(c) for c in model.coefficients]) + F.lit(float(model.intercept))
    slope = training.class_weight("is_tail") * (scores.logistic(z) - F.col("is_tail"))
    return _slopes(spark, rows.withColumn("weighted", slope), ["weighted"])


@query("q_model_reload", sql(
    "SELECT split, count(*) AS n, 0.0e0 AS furthest FROM zed GROUP BY 1", "zed"))
def model_reload(spark, sf):
    """A saved model scores as before once it is loaded again."""
    rows = materialize(fx.standardized(spark, sf).select("id", "split", "is_tail", *fx.ZSLOTS), "rows")
    model = training.train_weighted(rows.where("split = 'train'"), fx.ZSLOTS, "is_tail", maxIter=10)
    path = sinks.save_model(model, scratch_path(spark, "models"), "all", "m000")
    again = type(model).load(path)
    ready = training.assemble(rows, fx.ZSLOTS)
    both = training.probability_of_one(model.transform(ready), "first").select("id", "split", "first").join(
        training.probability_of_one(again.transform(ready), "second").select("id", "second"), "id")
    return both.groupBy("split").agg(
        F.count("*").alias("n"), F.max(F.abs(F.col("first") - F.col("second"))).alias("furthest"))


_FOCAL_STEPS, _FOCAL_RATE = 10, 2.0


def _focal_sql():
    """DuckDB: the gradient steps written out, one pair of expressions a step."""
    names = [f"z{i}" for i in _SLOTS]
    parts = ["w0 AS (SELECT " + ", ".join(f"0.0e0 AS w_{c}" for c in (*names, "bias")) + ")"]
    p, lp = "(1 / (1 + exp(-u)))", "(least(u, 0) - ln(1 + exp(-abs(u))))"
    slope = (f"CASE WHEN y = 1 THEN 0.95e0 * pow(1 - {p}, 3.0e0) * (3.0e0 * {p} * {lp} - (1 - {p})) "
             f"ELSE 0.05e0 * pow({p}, 3.0e0) * ({p} - 3.0e0 * (1 - {p}) * ({lp} - u)) END")
    loss = (f"CASE WHEN y = 1 THEN -0.95e0 * pow(1 - {p}, 3.0e0) * {lp} "
            f"ELSE -0.05e0 * pow({p}, 3.0e0) * ({lp} - u) END")
    for k in range(_FOCAL_STEPS):
        parts.append(f"s{k} AS MATERIALIZED (SELECT avg({loss}) AS loss, avg({slope}) AS g_bias, "
                     + ", ".join(f"avg(({slope}) * {c}) AS g_{c}" for c in names)
                     + " FROM (SELECT " + ", ".join(names) + ", is_tail AS y, "
                     + " + ".join(f"{c} * w_{c}" for c in names) + f" + w_bias AS u FROM zed, w{k} "
                     "WHERE split = 'train'))")
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT " + ", ".join(
            f"w_{c} - {_FOCAL_RATE} * g_{c} AS w_{c}" for c in (*names, "bias")) + f" FROM w{k}, s{k})")
    last = f"w{_FOCAL_STEPS}"
    body = " UNION ALL ".join(
        [f"SELECT '{c}' AS name, round(w_{c}, 6) AS value FROM {last}" for c in (*names, "bias")]
        + [f"SELECT '{n}_loss', round(loss, 6) FROM s{k}"
           for n, k in (("first", 0), ("last", _FOCAL_STEPS - 1))])
    return sql("@", "zed").replace("\n@", ",\n" + ",\n".join(parts) + "\n" + body)


@query("q_train_focal", _focal_sql())
def train_focal(spark, sf):
    weights, bias, history = training.train_focal(
        _train_rows(spark, sf), fx.ZSLOTS, "is_tail", steps=_FOCAL_STEPS, rate=_FOCAL_RATE)
    found = [*zip([*fx.ZSLOTS, "bias"], [*weights, bias]),
             ("first_loss", history[0]), ("last_loss", history[-1])]
    return spark.createDataFrame([(n, round(float(v), 6) + 0.0) for n, v in found],
                                 "name string, value double")


@query("q_train_huber", _slopes_sql("ye", "yv"))
def train_huber(spark, sf):
    """Converged fits: the mean clipped residual vanishes against every coefficient."""
    rows = materialize(_train_rows(spark, sf).select(*fx.ZSLOTS, *[
        scores.log_count(F.col(c)).alias(n)
        for c, n in (("engagement_score", "ye"), ("view_velocity_score", "yv"))]), "targets")
    models = training.train_huber(rows, fx.ZSLOTS, ["ye", "yv"], maxIter=500, tol=1e-10)
    slopes = {}
    for target, model in models.items():
        fitted = scoring.dot(fx.ZSLOTS, [float(c) for c in model.coefficients])
        residual = (fitted + F.lit(float(model.intercept)) - F.col(target)) / F.lit(float(model.scale))
        limit = float(model.getEpsilon())
        slopes[target] = F.greatest(F.lit(-limit), F.least(F.lit(limit), residual))
    return _slopes(spark, rows.select(*fx.ZSLOTS, *[s.alias(t) for t, s in slopes.items()]), list(slopes))


@query("q_ablation_mlp", sql("@", "zed").replace("\n@", f""",
{_NET}, {_TRIPLES},
variants AS MATERIALIZED (SELECT c AS condition, is_tail,
  CASE WHEN c <> 'Zero Text' THEN text END AS text, CASE WHEN c <> 'Zero Video' THEN video END AS video,
  CASE WHEN c <> 'Zero Tabular' THEN tabular END AS tabular
  FROM triples, (VALUES {", ".join(f"('{c}')" for c in _ABLATED)}) t(c)),
cases AS MATERIALIZED (SELECT condition, is_tail, 1 / (1 + exp(-logit)) AS prob
  FROM {_steps_sql(_base_sql('variants'), _head_sql('logit'))}),""" + _CURVE.format(
        by="condition, ", rows="cases", part="PARTITION BY condition ") + """
SELECT condition, round(roc, 4) AS roc_auc, round(ap, 4) AS average_precision, f1 FROM (
  SELECT condition, sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)) AS roc,
    sum(pos * cp / (cp + cn)) / sum(pos) AS ap FROM curve GROUP BY 1)
JOIN (SELECT condition, f1 FROM (""" + _RATES.format(
        by="condition, ", rows="SELECT condition, is_tail = 1 AS y, prob >= 0.5 AS p FROM cases")
    + ")) USING (condition)"))
def ablation_mlp(spark, sf):
    # Sums in another order move logits by their last digit, which can swap near ties.
    found = explain.network_ablation(_modalities(spark, sf), _network(), "is_tail", 0.5)
    return found.select("condition", F.round("roc_auc", 4).alias("roc_auc"),
                        F.round("average_precision", 4).alias("average_precision"),
                        F.round("f1", 6).alias("f1"))


@query("q_permutation_mlp", sql("@", "zed").replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "\n@", _SHUFFLE.replace("@", "zed").rstrip().rstrip(",") + f""",
{_NET}, {_TRIPLES},
bases AS MATERIALIZED {_base_sql('triples')},
variants AS MATERIALIZED (
  SELECT 0 AS j, is_tail, base, tabular FROM bases UNION ALL
  SELECT j, a.is_tail, a.base, list_concat(list_append(a.tabular[1:j - 1], b.tabular[j]),
    a.tabular[j + 1:]) FROM bases a JOIN places p ON p."to" = a.r JOIN bases b ON b.r = p.r),
cases AS MATERIALIZED (SELECT j, is_tail = 1 AS y, 1 / (1 + exp(-logit)) >= 0.5 AS p
  FROM {_steps_sql('variants', _head_sql('logit'))}),
f AS (""" + _RATES.format(by="j, ", rows="SELECT * FROM cases") + """)
SELECT name AS feature, base.f1 AS baseline_f1, f.f1 AS shuffled_f1,
  round(base.f1 - f.f1, 6) AS importance
FROM f JOIN (VALUES """ + ", ".join(
        f"({j}, '{name}')" for j, name in enumerate(explain.FEATURE_NAMES, 1)) + """) t(k, name)
  ON k = f.j, (SELECT f1 FROM f WHERE j = 0) base"""))
def permutation_mlp(spark, sf):
    rows = _modalities(spark, sf, *fx.ZSLOTS)
    found = explain.network_importance(rows, "id", fx.ZSLOTS, _network(), "is_tail", 0.5)
    rounded = found.withColumns({c: F.round(c, 6) for c in ("baseline_f1", "shuffled_f1")})
    return rounded.withColumn("importance",
                              F.round(F.col("baseline_f1") - F.col("shuffled_f1"), 6))


_OPTIONS = {"feature_window": (6, 12), "update_freq": (6, 12), "max_history_years": (5,), "h": (0, 3)}

_RUNS = sql("@", "panel").replace("\n@", """,
ends AS (SELECT min(month) AS first, max(month) AS last FROM panel0),
months AS (SELECT DISTINCT month FROM panel0),
specs AS (SELECT fw, uf, h FROM (VALUES (6), (12)) a(fw), (VALUES (6), (12)) b(uf),
  (VALUES (0), (3)) c(h)),
cuts AS (SELECT *, CAST(unnest(generate_series(last, first + fw + 2 * h + uf - 2, -uf)) AS INTEGER)
  AS val_end FROM specs, ends),
starts AS (SELECT fw, uf, h, first, val_end, min(month) AS val_start FROM cuts
  JOIN months ON month > val_end - uf GROUP BY ALL),
windows AS (SELECT *, val_start - h AS train_end,
  greatest(val_start - h - 60 + 1, first + fw + h - 1) AS train_start FROM starts),
rows AS MATERIALIZED (SELECT DISTINCT fw, h, l.entity, l.month, l.label FROM
  (SELECT DISTINCT fw, h FROM specs), panel l JOIN panel r ON r.entity = l.entity
  WHERE l.month - r.month BETWEEN h AND h + fw - 1),
means AS (SELECT fw, uf, h, val_end, avg(label) AS p FROM windows JOIN rows USING (fw, h)
  WHERE month BETWEEN train_start AND train_end GROUP BY ALL),
runs AS MATERIALIZED (SELECT entity, month AS eval_month, label AS ytrue, val_end AS timecut,
  fw AS feature_window, uf AS update_freq, h, p
  FROM windows JOIN means USING (fw, uf, h, val_end) JOIN rows USING (fw, h)
  WHERE month BETWEEN val_start AND val_end AND val_end IN (SELECT month FROM months)
    AND EXISTS (SELECT 1 FROM months m WHERE m.month BETWEEN train_start AND train_end))
@""")


def _experiment(spark, sf, models, flags=None):
    ends = fx.panel_spec(spark, sf)
    specs = grid.temporal_specs([ends.label_start], [ends.label_end], _OPTIONS)
    panel = materialize(fx.panel(spark, sf), "panel")
    return experiment.run_experiment(panel, "entity", "month", "label", ["n_orders", "max_price"], specs,
                                     models, flags)


@query("q_timecut_results", _RUNS.replace("\n@", """
SELECT entity, eval_month, ytrue, timecut, feature_window, update_freq, h, round(p, 6) AS p,
  true AS fallback FROM runs"""))
def timecut_results(spark, sf):
    return _experiment(spark, sf, {"m000": experiment.MEAN}).results.select(
        "entity", "eval_month", "ytrue", "timecut", "feature_window", "update_freq", "h",
        F.round("p", 6).alias("p"), "fallback")


_FITS = {"m000": experiment.MEAN, "m001": experiment.Logistic(), "m002": experiment.Logistic(ridge=0.1)}


@query("q_timecut_fits", _RUNS.replace("\n@", """
SELECT entity, eval_month, ytrue, timecut, feature_window, update_freq, h, model_id,
  model_id = 'm000' OR p IN (0, 1) AS fallback,
  CASE WHEN model_id = 'm000' OR p IN (0, 1) THEN round(p, 6) END AS mean, true AS sound
FROM runs, (VALUES ('m000'), ('m001'), ('m002')) m(model_id)"""))
def timecut_fits(spark, sf):
    """The logistic grid beside the mean, every option, timecut and month of the whole panel.

    SQL says the rows, which of them a model was fitted for, and the means;
    ``q_timecut_gradients`` checks the fits themselves.
    """
    runs = _experiment(spark, sf, _FITS).results
    return runs.select(
        "entity", "eval_month", "ytrue", "timecut", "feature_window", "update_freq", "h", "model_id",
        "fallback", F.when(F.col("fallback"), F.round("p", 6)).alias("mean"),
        F.col("p").between(0.0, 1.0).alias("sound"))


_TRAINED = """,
trained AS MATERIALIZED (SELECT * FROM windows WHERE val_end IN (SELECT month FROM months)
  AND EXISTS (SELECT 1 FROM months m WHERE m.month BETWEEN train_start AND train_end))"""


@query("q_timecut_gradients", _RUNS.replace("\n@", _TRAINED + """,
base AS MATERIALIZED (SELECT fw, uf, h, val_end, count(*) AS n, avg(label) AS m FROM trained
  JOIN rows USING (fw, h) WHERE month BETWEEN train_start AND train_end
  GROUP BY ALL HAVING avg(label) NOT IN (0, 1)),
lagged AS (SELECT t.fw, uf, t.h, val_end, l.month - r.month AS lag,
  sum(r.n_orders) AS o, sum(r.n_orders * l.label) AS oy, sum(r.max_price) AS p, sum(r.max_price * l.label) AS py
  FROM trained t JOIN rows l ON l.fw = t.fw AND l.h = t.h AND l.month BETWEEN train_start AND train_end
  JOIN panel r ON r.entity = l.entity AND l.month - r.month BETWEEN t.h AND t.h + t.fw - 1 GROUP BY ALL),
weighted AS (SELECT b.*, lag, o, oy, p, py FROM (SELECT *, unnest(range(h, h + fw)) AS lag FROM base) b
  LEFT JOIN lagged USING (fw, uf, h, val_end, lag)),
moments AS (SELECT fw, uf, h, val_end, n, 'bias' AS feature, m AS moment FROM base
  UNION ALL SELECT fw, uf, h, val_end, n, 'n_orders_lag' || lag, oy / o FROM weighted
  UNION ALL SELECT fw, uf, h, val_end, n, 'max_price_lag' || lag, py / p FROM weighted)
SELECT fw AS feature_window, uf AS update_freq, h, val_end AS timecut, model_id, feature, n AS n_train,
  round(coalesce(moment, 0), 6) AS moment, true AS converged
FROM moments, (VALUES ('m001'), ('m002')) m(model_id)"""))
def timecut_gradients(spark, sf):
    """Every weight of every fit is at its optimum.

    There the mean prediction weighted by a feature (and the penalty's share) is the mean
    label weighted alike, which SQL takes from the panel.
    """
    found = _experiment(spark, sf, _FITS).moments()
    return found.withColumn("moment", F.round("moment", 6))


# Indicators of a row's lags: active in the newest month, ever dear, busy on the whole.
def _flags(spec):
    lags = range(spec.h, spec.h + spec.feature_window)
    orders = sum((F.col(f"n_orders_lag{k}") for k in lags), F.lit(0))
    return {"seen": F.col(f"n_orders_lag{spec.h}") > 0,
            "dear": F.greatest(*[F.col(f"max_price_lag{k}") for k in lags]) >= 250_000, "busy": orders >= 4}


_FLAG_MODELS = {"0": experiment.MEAN, **{str(i): experiment.Logistic((name,))
                                         for i, name in enumerate(("seen", "dear", "busy"), 1)}}


@query("q_best_timecut_model", _RUNS.replace("\n@", _TRAINED + """,
flags AS MATERIALIZED (SELECT l.fw, l.h, l.entity, l.month, l.label,
  max(l.month - r.month = l.h) FILTER (r.month IS NOT NULL) AS f1, max(r.max_price) >= 250000 AS f2,
  sum(r.n_orders) >= 4 AS f3 FROM rows l
  JOIN panel r ON r.entity = l.entity AND l.month - r.month BETWEEN l.h AND l.h + l.fw - 1
  WHERE l.label IS NOT NULL GROUP BY ALL),
long AS MATERIALIZED (SELECT fw, h, entity, month, label, unnest([0, 1, 2, 3]) AS model,
  unnest([true, coalesce(f1, false), f2, f3]) AS flag FROM flags),
rates AS (SELECT fw, uf, h, val_end, model, flag, avg(label) AS p FROM trained JOIN long USING (fw, h)
  WHERE month BETWEEN train_start AND train_end GROUP BY ALL),
predicted AS (SELECT t.val_end AS timecut, l.label AS ytrue, round(coalesce(r.p, m.p), 6) AS p,
  printf('m%03d', CAST(((CASE t.fw WHEN 6 THEN 0 ELSE 1 END * 2 + CASE t.uf WHEN 6 THEN 0 ELSE 1 END) * 2
    + CASE t.h WHEN 0 THEN 0 ELSE 1 END) * 4 + l.model AS INTEGER)) AS model_id
  FROM trained t JOIN means m USING (fw, uf, h, val_end)
  JOIN long l ON l.fw = t.fw AND l.h = t.h AND l.month BETWEEN val_start AND val_end
  LEFT JOIN rates r ON r.fw = t.fw AND r.uf = t.uf AND r.h = t.h AND r.val_end = t.val_end
    AND r.model = l.model AND r.flag = l.flag)
SELECT timecut, arg_max(model_id, (f1, -CAST(substr(model_id, 2) AS INTEGER))) AS model_id, max(f1) AS f1
FROM (""" + _RATES.format(by="timecut, model_id, ", rows="""SELECT ytrue = 1 AS y,
  p >= 0.05 AS p, timecut, model_id FROM predicted""") + ") GROUP BY 1"))
def best_timecut_model(spark, sf):
    """Per timecut the best of all option combinations and models, fitted ones among them.

    A logistic model of one indicator predicts the mean label of either value, so SQL can
    say what each fit must predict.
    """
    number = sum(F.when(F.col(name) == values[0], 0).otherwise(1) * factor for name, values, factor in (
        ("feature_window", (6, 12), 16), ("update_freq", (6, 12), 8), ("h", (0, 3), 4)))
    runs = _experiment(spark, sf, _FLAG_MODELS, _flags).results.withColumns({
        "p": F.round("p", 6), "model_id": F.format_string("m%03d", number + F.col("model_id").cast("int"))})
    return training.best_models(runs, 0.05).withColumn("f1", F.round("f1", 6))
