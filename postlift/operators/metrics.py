"""Ranking metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import SETTINGS
from ..session import materialize
from .ranking import running_sums


def _ratio(top, bottom) -> Column:
    """Ratio that is 0 when its denominator is 0."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def confusion_counts(df: DataFrame, truth: str, predicted: Column, by: tuple[str, ...] = ()
                     ) -> DataFrame:
    y, p = F.col(truth).cast("int"), predicted.cast("int")
    return df.groupBy(*by).agg(
        F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp"),
        F.sum(y * (1 - p)).alias("fn"), F.sum((1 - y) * (1 - p)).alias("tn"))


def rates(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 (0 when undefined) and accuracy from confusion counts."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by, _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def binary_metrics(df: DataFrame, truth: str, prob: str,
                   threshold: float = SETTINGS.confidence, by: tuple[str, ...] = ()
                   ) -> DataFrame:
    return rates(confusion_counts(df, truth, F.col(prob) >= threshold, by), by)


def curve_points(df: DataFrame, truth: str, prob: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Per distinct score, from high to low: positives, negatives and running counts.

    Tied rows move together.  Points are ranged by group and score, so the running
    counts are split evenly however the scores are spread (with a rare class nearly
    all lie close to 0); the range number is written down with the rows, since both
    passes of the running counts must see the same ranges.
    """
    y = F.col(truth).cast("bigint")
    points = (df.select(*by, F.col(prob).cast("double").alias("score"), y.alias("_y"))
              .groupBy(*by, "score").agg(F.sum("_y").alias("pos"),
                                         F.sum(1 - F.col("_y")).alias("neg")))
    ranged = points.repartitionByRange(*by, F.desc("score")).withColumn(
        "_range", F.spark_partition_id())
    return running_sums(materialize(ranged, "points"), F.col("_range"), [F.desc("score")],
                        {"cum_pos": "pos", "cum_neg": "neg"}, by=by)


def curve_metrics(df: DataFrame, truth: str, prob: str, by: tuple[str, ...] = ()) -> DataFrame:
    """ROC-AUC (trapezoid) and average precision (step sum); null with one class only."""
    return curve_points(df, truth, prob, by).groupBy(*by).agg(*_areas())


def _areas() -> list[Column]:
    """Both curve areas over the rows of ``curve_points``."""
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    steps = F.sum(F.col("pos") * F.col("cum_pos")
                  / (F.col("cum_pos") + F.col("cum_neg")).cast("double"))
    positives, negatives = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return [F.try_divide(area, positives * negatives).alias("roc_auc"),
            F.try_divide(steps, positives).alias("average_precision")]


def evaluate(df: DataFrame, truth: str, prob: str, threshold: float = SETTINGS.confidence,
             by: tuple[str, ...] = ()) -> DataFrame:
    """Curve areas and threshold rates together, from one pass over the rows.

    The points already count positives and negatives per score, so the confusion
    counts are sums over the points on either side of the threshold.
    """
    points = curve_points(df, truth, prob, by)
    hit = (F.col("score") >= threshold).cast("int")
    both = points.groupBy(*by).agg(
        *_areas(), F.sum(F.col("pos") * hit).alias("tp"), F.sum(F.col("neg") * hit).alias("fp"),
        F.sum(F.col("pos") * (1 - hit)).alias("fn"), F.sum(F.col("neg") * (1 - hit)).alias("tn"))
    return rates(both, (*by, "roc_auc", "average_precision"))


def summarize_folds(metrics: DataFrame, fold: str, names: list[str]) -> DataFrame:
    """Mean and population deviation per metric over the folds that report it."""
    long = metrics.unpivot([fold], names, "metric", "value").where("value is not null")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"),
                                      F.stddev_pop("value").alias("std"))


def best_by_metric(results: DataFrame, group: str, model: str, metric: str) -> DataFrame:
    """Per group the model with the greatest metric; ties go to the smallest model id."""
    order = F.struct(F.col(metric), -F.col(model))
    return results.groupBy(group).agg(F.max_by(model, order).alias(model),
                                      F.max(metric).alias(metric))
