"""Training losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import SETTINGS
from ..functions.scores import logistic


def bce_with_logits(z: Column, y: Column) -> Column:
    """Binary cross-entropy that stays finite for large logits."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def focal(z: Column, y: Column, alpha: float = SETTINGS.focal_alpha,
          gamma: float = SETTINGS.focal_gamma) -> Column:
    """Cross-entropy weighted by class and by how wrong the prediction is."""
    p = logistic(z)
    miss = y * (1 - p) + (1 - y) * p
    weight = y * alpha + (1 - y) * (1 - alpha)
    return weight * F.pow(miss, F.lit(float(gamma))) * bce_with_logits(z, y)


def weighted_bce(z: Column, y: Column, p: float = SETTINGS.tail_quantile) -> Column:
    """Cross-entropy with positives weighted p / (1 - p)."""
    return (y * (p / (1 - p)) + (1 - y)) * bce_with_logits(z, y)


def huber(predicted: Column, target: Column, delta: float = SETTINGS.huber_delta) -> Column:
    gap = F.abs(predicted - target)
    return F.when(gap <= delta, 0.5 * gap * gap).otherwise(delta * (gap - 0.5 * delta))


def reduce_loss(df: DataFrame, loss: Column, reduction: str = "mean") -> DataFrame:
    """``mean`` or ``sum`` over all rows, or ``none`` for one value per row."""
    if reduction == "mean":
        return df.agg(F.avg(loss).alias("loss"))
    if reduction == "sum":
        return df.agg(F.sum(loss).alias("loss"))
    return df.withColumn("loss", loss)


def multitask_loss(df: DataFrame, predicted: tuple[str, str], wanted: tuple[str, str],
                   logit: str, label: str, settings=SETTINGS) -> DataFrame:
    """Weighted sum of the Huber mean over both targets and the focal mean."""
    regression = sum((huber(F.col(p), F.col(w), settings.huber_delta)
                      for p, w in zip(predicted, wanted)), F.lit(0.0)) / len(predicted)
    classes = focal(F.col(logit), F.col(label).cast("double"),
                    settings.focal_alpha, settings.focal_gamma)
    means = df.agg(F.avg(regression).alias("regression_loss"),
                   F.avg(classes).alias("classification_loss"))
    share = settings.regression_share
    return means.withColumn("loss", F.col("regression_loss") * share
                            + F.col("classification_loss") * (1 - share))
