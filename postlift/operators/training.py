"""Training on tabular features: weighted, focal and Huber fits, model grids."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..config import SETTINGS
from ..functions.scores import logistic
from ..session import materialize, scratch_path
from ..sources.grid import TemporalSpec, combinations
from ..sources.sinks import save_model
from .losses import focal
from .metrics import binary_metrics
from .scoring import dot
from .temporal import mean_fallback, supervised_matrix, tag_cuts, timecut_windows

# The model that predicts the training rows' mean label.
MEAN = "mean"

# Further classifiers a grid may name.
CLASSIFIERS = {
    "logistic": LogisticRegression,
    "forest": RandomForestClassifier,
    "boosted": GBTClassifier,
}


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def class_weight(label: str, p: float = SETTINGS.tail_quantile) -> Column:
    """Weight p / (1 - p) for positives, 1 for the rest."""
    return F.when(F.col(label) == 1, p / (1 - p)).otherwise(1.0)


def train_weighted(train: DataFrame, columns: list[str], label: str, **params) -> Model:
    """Logistic regression with upweighted positives."""
    weighted = assemble(train, columns).withColumn("weight", class_weight(label))
    return LogisticRegression(labelCol=label, weightCol="weight", **params).fit(weighted)


def probability_of_one(df: DataFrame, out: str = "prob") -> DataFrame:
    return df.withColumn(out, vector_to_array("probability")[1])


def focal_gradient(z: Column, y: Column, alpha: float, gamma: float) -> Column:
    """Derivative of the focal loss by the logit."""
    p = logistic(z)
    q = 1 - p
    log_p = -F.log1p(F.exp(-F.abs(z))) + F.least(z, F.lit(0.0))
    log_q = log_p - z
    one = alpha * F.pow(q, F.lit(gamma)) * (gamma * p * log_p - q)
    zero = (1 - alpha) * F.pow(p, F.lit(gamma)) * (p - gamma * q * log_q)
    return F.when(y == 1, one).otherwise(zero)


def train_focal(train: DataFrame, columns: list[str], label: str, steps: int = 20,
                rate: float = 2.0, settings=SETTINGS) -> tuple[list[float], float, list[float]]:
    """Linear head under focal loss by full-batch gradient descent.

    A step is one aggregate over the rows: each task adds up its gradient in
    generated code and sends one short row, so nothing but the weights ever
    reaches the driver.  The rows are read once per step, so pass a stored frame.
    Returns (weights, bias, loss per step).
    """
    rows = train.select(*columns, F.col(label).cast("double").alias("_y"))
    weights, bias, history = [0.0] * len(columns), 0.0, []
    y = F.col("_y")
    for _ in range(steps):
        z = F.col("_z")
        scored = rows.withColumn("_z", dot(columns, weights) + F.lit(bias))
        pulled = scored.withColumn("_g", focal_gradient(
            z, y, settings.focal_alpha, settings.focal_gamma))
        row = pulled.agg(
            F.count("*").alias("n"),
            F.sum(focal(z, y, settings.focal_alpha, settings.focal_gamma)).alias("loss"),
            F.sum("_g").alias("bias"),
            *[F.sum(F.col("_g") * F.col(c)).alias(c) for c in columns]).first()
        n = row["n"]
        history.append(row["loss"] / n)
        weights = [w - rate * row[c] / n for w, c in zip(weights, columns)]
        bias -= rate * row["bias"] / n
    return weights, bias, history


def train_huber(train: DataFrame, columns: list[str], targets: list[str], **params
                ) -> dict[str, Model]:
    """One Huber regression per target."""
    ready = assemble(train, columns)
    return {target: LinearRegression(labelCol=target, loss="huber", predictionCol=f"{target}_hat",
                                     **params).fit(ready) for target in targets}


def model_grid(grid: dict[str, dict[str, tuple]]) -> list[tuple[str, str, dict]]:
    """(model id, classifier name, parameters), one per combination."""
    listed = [(name, params) for name, options in grid.items()
              for params in combinations(options)]
    return [(f"m{i:03d}", name, params) for i, (name, params) in enumerate(listed)]


def run_timecuts(panel: DataFrame, entity: str, month: str, target: str, features: list[str],
                 spec: TemporalSpec, grid: dict[str, dict[str, tuple]],
                 model_root: str | None = None) -> DataFrame:
    """Fit every model at every timecut and score the months that follow.

    The lagged matrix of all label months is built and stored once; a timecut is
    then only a month filter.  Result rows are (entity, eval_month, ytrue,
    timecut, model_id, p, fallback), appended per timecut to a table in the shared
    folder.  Where the training rows have one class only, p is their mean label and
    ``fallback`` is true, and so it is for the model ``mean``; a fit that fails for any
    other reason fails the run.  Class balances of all cuts come from one pass.  A job runs per
    cut and model, and the models can be saved; ``experiment.run_experiment`` fits the
    logistic ones of all cuts together.
    """
    spark = panel.sparkSession
    models = model_grid(grid)
    matrix = supervised_matrix(panel, entity, month, target, features,
                               spec.h, spec.feature_window)
    # Ordered by month first, so a month filter skips most files.
    matrix = materialize(matrix.repartitionByRange("label_month", entity)
                         .sortWithinPartitions("label_month", entity), "matrix")
    columns = [c for c in matrix.columns if "_lag" in c]
    results = scratch_path(spark, "timecut-results")
    schema = (f"{entity} {dict(matrix.dtypes)[entity]}, eval_month int, ytrue int, "
              "timecut int, model_id string, p double, fallback boolean")
    # Short lists: one row per timecut.
    cuts = timecut_windows(panel, month, spec).orderBy(F.desc("val_end")).collect()
    tagged = tag_cuts(matrix.select(entity, "label_month", "y"), cuts)
    balance = {r["timecut"]: r for r in tagged.where("part = 'train'").groupBy("timecut").agg(
        F.min("y").alias("lo"), F.max("y").alias("hi")).collect()}
    single = [c for c, r in balance.items() if r["lo"] == r["hi"]]
    # The mean of all cuts at once: for the model of that name, and for one-class cuts.
    meant = mean_fallback(tagged).select(
        entity, F.col("label_month").cast("int").alias("eval_month"),
        F.col("y").cast("int").alias("ytrue"), F.col("timecut").cast("int"), "p")
    parts = []
    for model_id, name, _ in models:
        if name == MEAN or single:
            stood_in = meant if name == MEAN else meant.where(F.col("timecut").isin(single))
            parts.append(stood_in.select(entity, "eval_month", "ytrue", "timecut",
                                         F.lit(model_id).alias("model_id"), "p",
                                         F.lit(True).alias("fallback")))
    label_month, written = F.col("label_month"), False
    for cut in cuts:
        if cut["val_end"] not in balance or cut["val_end"] in single:
            continue
        ready = assemble(matrix.where(label_month.between(cut["train_start"], cut["train_end"])),
                         columns)
        asked = assemble(matrix.where(label_month.between(cut["val_start"], cut["val_end"])),
                         columns)
        for model_id, name, params in models:
            if name == MEAN:
                continue
            model = CLASSIFIERS[name](labelCol="y", **params).fit(ready)
            if model_root:
                save_model(model, model_root, str(cut["val_end"]), model_id)
            (probability_of_one(model.transform(asked), "p")
             .select(entity, label_month.cast("int").alias("eval_month"),
                     F.col("y").cast("int").alias("ytrue"),
                     F.lit(cut["val_end"]).cast("int").alias("timecut"),
                     F.lit(model_id).alias("model_id"), F.col("p").cast("double"),
                     F.lit(False).alias("fallback"))
             .write.mode("append").parquet(results))
            written = True
    if written:
        parts.append(spark.read.schema(schema).parquet(results))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def best_models(results: DataFrame, threshold: float = SETTINGS.confidence,
                by: tuple[str, ...] = ("timecut",)) -> DataFrame:
    """Per timecut the model of the greatest F1 over its results; ties go to the least id."""
    found = binary_metrics(results, "ytrue", "p", threshold, (*by, "model_id"))
    numbered = found.withColumn("model_no", F.substring("model_id", 2, 9).cast("int"))
    order = F.struct(F.col("f1"), -F.col("model_no"))
    return numbered.groupBy(*by).agg(F.max_by("model_id", order).alias("model_id"),
                                     F.max("f1").alias("f1"))


def wide_results(results: DataFrame, entity: str, model_ids: list[str]) -> DataFrame:
    """One probability column per model, joined on keys rather than by position."""
    return (results.groupBy(entity, "eval_month", "timecut", "ytrue")
            .pivot("model_id", model_ids).agg(F.first("p")))
