"""Standardisation, fused scoring and the media decode hook."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..config import SETTINGS
from ..functions.features import FEATURE_SLOTS
from ..functions.scores import logistic, untransform

# Worker functions travel with their code, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def feature_stats(df: DataFrame, slots=FEATURE_SLOTS) -> DataFrame:
    """One row: mean and population deviation of every feature."""
    return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in slots],
                  *[F.stddev_pop(c).alias(f"std_{c}") for c in slots])


def long_feature_stats(df: DataFrame, slots=FEATURE_SLOTS) -> DataFrame:
    """(feature, mean, std), one row per feature."""
    wide = feature_stats(df, slots)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean"),
                              F.col(f"std_{c}").alias("std")) for c in slots])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def zscore(df: DataFrame, stats: dict, slots=FEATURE_SLOTS,
           epsilon: float = SETTINGS.zscore_epsilon, prefix: str = "z") -> DataFrame:
    """Standardised copies (f07 -> z07) by the training rows' ``feature_stats``."""
    return df.withColumns({
        f"{prefix}{c[1:]}": (F.col(c) - F.lit(stats[f"mean_{c}"]))
        / F.lit(stats[f"std_{c}"] + epsilon) for c in slots})


def dot(columns: list[str], weights: list[float]) -> Column:
    """Weighted sum, grouped in balanced halves to keep the expression shallow."""
    terms = [F.col(c) * F.lit(float(w)) for c, w in zip(columns, weights)]
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i]
                 for i in range(0, len(terms), 2)]
    return terms[0]


def array_dot(values: Column, weights: list[float]) -> Column:
    """Inner product of an array column with constant weights."""
    products = F.zip_with(values.cast("array<double>"),
                          F.lit([float(w) for w in weights]), lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def classify(df: DataFrame, prob: str, threshold: float = SETTINGS.analysis_confidence,
             names=("Top", "Rest"), out: str = "prediction") -> DataFrame:
    return df.withColumn(out, F.when(F.col(prob) >= threshold, names[0]).otherwise(names[1]))


def join_embeddings(df: DataFrame, embeddings: DataFrame, key: str, out: str, width: int
                    ) -> DataFrame:
    """Attach a precomputed vector by ``key`` (unique in ``embeddings``).

    A row without a vector gets zeros, so no post is lost.
    """
    vectors = embeddings.select(F.col("vec_id").alias(key), F.col("embedding").alias(out))
    neutral = F.array_repeat(F.lit(0.0).cast("float"), width)
    return df.join(vectors, key, "left").withColumn(out, F.coalesce(out, neutral))


HEADS = ("engagement", "velocity", "logit")


def project_branch(vectors: DataFrame, key: str, column: str, weights: dict[str, list[float]],
                   branch: str) -> DataFrame:
    """One branch's share of every head, per vector: (key, <branch>_<head>...).

    The fusion is linear, so the product can be taken below the join: three
    numbers per vector are shuffled instead of the vector itself.
    """
    return vectors.select(key, *[
        array_dot(F.col(column), weights[head]).alias(f"{branch}_{head}") for head in HEADS])


def join_branch(df: DataFrame, projected: DataFrame, key: str, branch: str) -> DataFrame:
    """Attach a branch by ``key``; a post without a vector gets a zero share."""
    joined = df.join(projected, key, "left")
    return joined.withColumns({f"{branch}_{head}": F.coalesce(f"{branch}_{head}", F.lit(0.0))
                               for head in HEADS})


def fuse_linear(df: DataFrame, branches: list[str]) -> DataFrame:
    """Add up the branches' shares per head; undo the targets' log for the two
    scores and apply the logistic for the class probability."""
    totals = {head: sum((F.col(f"{b}_{head}") for b in branches[1:]),
                        F.col(f"{branches[0]}_{head}")) for head in HEADS}
    return df.withColumns({"engagement": untransform(totals["engagement"]),
                           "velocity": untransform(totals["velocity"]),
                           "tail_prob": logistic(totals["logit"])})


def tabular_branch(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Linear, layer norm, ReLU, linear."""
    hidden = x @ w["tab_in"] + w["tab_in_b"]
    centred = hidden - hidden.mean(axis=1, keepdims=True)
    normed = centred / np.sqrt(hidden.var(axis=1, keepdims=True) + 1e-5)
    return np.maximum(normed * w["norm_scale"] + w["norm_shift"], 0) @ w["tab_out"] + w["tab_out_b"]


def fuse_mlp(df: DataFrame, weights: dict[str, np.ndarray], key: str = "id") -> DataFrame:
    """Late fusion with dense layers; columns text, video and tabular hold arrays of
    fixed width, whose Arrow buffers are read as matrices without a copy per row.

    The weights are model-sized, not data-sized, and are sent once per executor.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def matrix(batch, name):
        column = batch.column(name)
        return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            fused = np.concatenate([matrix(batch, "text"), matrix(batch, "video"),
                                    tabular_branch(matrix(batch, "tabular"), w)], axis=1)
            common = np.maximum(fused @ w["fuse"] + w["fuse_b"], 0)
            head = {name: np.maximum(common @ w[f"{name}_in"], 0) @ w[f"{name}_out"]
                    for name in HEADS}
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(np.expm1(head["engagement"])),
                 pa.array(np.expm1(head["velocity"])), pa.array(1 / (1 + np.exp(-head["logit"])))],
                [key, "engagement", "velocity", "tail_prob"])

    schema = f"{key} bigint, engagement double, velocity double, tail_prob double"
    return df.select(key, "text", "video", "tabular").mapInArrow(run, schema)


def branch_share(df: DataFrame, weights: dict[str, np.ndarray], keep: list[str], out: str) -> DataFrame:
    """``keep`` and what bias, text and video add to the fused layer, an array as wide as that layer."""
    shared = df.sparkSession.sparkContext.broadcast({k: weights[k] for k in ("fuse", "fuse_b", "tab_out")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        split = len(w["fuse"]) - w["tab_out"].shape[1]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            text, video = (np.asarray(batch.column(c).flatten(), dtype=float).reshape(batch.num_rows, -1)
                           for c in ("text", "video"))
            share = (w["fuse_b"] + text @ w["fuse"][:text.shape[1]]
                     + video @ w["fuse"][split - video.shape[1]:split])
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * share.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keep], pa.ListArray.from_arrays(ends, pa.array(share.ravel()))],
                names=[*keep, out])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + f", {out} array<double>"
    return df.select(*keep, "text", "video").mapInArrow(run, schema)


def variant_logits(df: DataFrame, weights: dict[str, np.ndarray], keep: list[str],
                   variants: Callable[[dict[str, np.ndarray]], list[tuple]],
                   columns: list[str], share: str | None = None) -> DataFrame:
    """``keep`` and an array of class logits, one per variant of a row's branches.

    ``variants`` gets the named array ``columns`` as matrices and returns (text, video,
    tabular branch input) triples; None leaves a branch out (its fused part is zero).
    ``share`` may name a ``branch_share`` that stands in for the bias and the branches left out.
    All variants are scored in one pass over the rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        split = len(w["fuse"]) - w["tab_out"].shape[1]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            inputs = {}
            for name in (*columns, *([share] if share else [])):
                column = batch.column(name)
                inputs[name] = np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)
            logits = []
            for text, video, tabular in variants(inputs):
                fused = inputs[share] if share else np.tile(w["fuse_b"], (batch.num_rows, 1))
                if text is not None:
                    fused = fused + text @ w["fuse"][:text.shape[1]]
                if video is not None:
                    fused = fused + video @ w["fuse"][split - video.shape[1]:split]
                if tabular is not None:
                    fused = fused + tabular_branch(tabular, w) @ w["fuse"][split:]
                logits.append(np.maximum(np.maximum(fused, 0) @ w["logit_in"], 0) @ w["logit_out"])
            flat = pa.array(np.stack(logits, 1).ravel())
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(logits))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keep], pa.ListArray.from_arrays(ends, flat)],
                names=[*keep, "logits"])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + ", logits array<double>"
    read = dict.fromkeys([*keep, *columns, *([share] if share else [])])
    return df.select(*read).mapInArrow(run, schema)


def mlp_weights(text_dim: int, video_dim: int, tab_dim: int, d_model: int, seed: int
                ) -> dict[str, np.ndarray]:
    """Seeded initial weights of the fused network (1/sqrt(fan-in) normal)."""
    rng = np.random.default_rng(seed)

    def layer(rows, cols=None):
        shape = rows if cols is None else (rows, cols)
        return rng.normal(size=shape) / np.sqrt(rows)

    w = {"tab_in": layer(tab_dim, d_model), "tab_in_b": np.zeros(d_model),
         "norm_scale": np.ones(d_model), "norm_shift": np.zeros(d_model),
         "tab_out": layer(d_model, d_model), "tab_out_b": np.zeros(d_model),
         "fuse": layer(text_dim + video_dim + d_model, d_model), "fuse_b": np.zeros(d_model)}
    for head in HEADS:
        w[f"{head}_in"] = layer(d_model, d_model // 2)
        w[f"{head}_out"] = layer(d_model // 2)
    return w


# Decoded blocks that are in memory at a time; each holds millions of numbers.
_BLOCKS = 4


def decode_media(media: DataFrame, decoder: Callable[[bytes], list[float]],
                 neutral: list[float], key: str = "id",
                 unreadable: tuple[type[Exception], ...] = (ValueError, LookupError, OSError, EOFError)
                 ) -> DataFrame:
    """Frame features per media file by a pluggable decoder.

    A missing file, or one on which the decoder raises one of ``unreadable``, gives the
    neutral block; any other error fails the job.  Blocks leave a few at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCKS):
                part, blocks, fine = batch.slice(start, _BLOCKS), [], []
                for data in part.column("video_bytes"):
                    block = None
                    if data.is_valid:
                        try:
                            block = np.asarray(decoder(data.as_py()), dtype=float)
                        except unreadable:
                            pass
                    blocks.append(np.asarray(neutral, dtype=float) if block is None else block)
                    fine.append(block is not None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(blocks, pa.list_(pa.float64())), pa.array(fine)],
                    names=[key, "frames", "decoded"])

    return media.select(key, "video_bytes").mapInArrow(
        run, f"{key} bigint, frames array<double>, decoded boolean")
