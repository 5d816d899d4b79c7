"""Ablation, permutation importance, weight magnitudes and example picking."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import FEATURE_NAMES, SETTINGS
from ..functions.scores import logistic
from ..functions.text import caption_head
from ..session import materialize
from .metrics import evaluate
from .ranking import hash_order, permuted_numbers
from .scoring import branch_share, variant_logits

# Worker functions travel with their code, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most ranks that meet in one group of a shuffle, and rows sent out at once.
BLOCK, SENT = 1 << 16, 1 << 15


def ablate(df: DataFrame, conditions: dict[str, Column], truth: str,
           threshold: float = SETTINGS.analysis_confidence) -> DataFrame:
    """ROC-AUC, average precision and F1 per condition.

    ``conditions`` maps a name to the logit with a branch left out.  All of them
    are evaluated on the same pass; rows then repeat once per condition and
    combine to one row per score before the shuffle, from which all three
    metrics follow.
    """
    cases = F.array(*[F.struct(F.lit(name).alias("condition"),
                               logistic(logit).alias("prob"))
                      for name, logit in conditions.items()])
    long = df.select(F.col(truth).alias("y"), F.explode(cases).alias("c")).select("y", "c.*")
    return evaluate(long, "y", "prob", threshold, ("condition",)).select(
        "condition", "roc_auc", "average_precision", "f1")


def shuffled(df: DataFrame, key: str, slots: list[str], carry: list[str],
             seed: int = SETTINGS.seed) -> DataFrame:
    """Rows with ``slots``, ``carry`` and donor values ``_d1`` … of an independent shuffle per feature.

    Rows have ranks in a seeded random order of a unique ``key``, and feature j of the row at
    rank r goes to the row at rank ``permuted(r, j)``.  Rows travel to the block of ``BLOCK``
    ranks that holds their own, and their values, packed by block, to those they are sent to, so
    a row's shuffled values meet without a sort per feature or a record per value.  Any
    number of rows will do; none give none.
    """
    stored = materialize(df.select(key, *slots, *carry), "shuffled")
    n = stored.count()
    # Small tables are spread over some tasks too.
    size = max(1, min(BLOCK, -(-n // 64)))
    ranked = hash_order(stored, key, seed).withColumn("rank", F.col("rank").cast("long"))
    kind = ranked.schema[slots[0]].dataType.simpleString()
    sent = ranked.select("rank", *[F.col(c).cast(kind).alias(f"_d{j}") for j, c in enumerate(slots, 1)]).mapInArrow(
        _send(n, size, seed), f"block long, at array<int>, j array<int>, value array<{kind}>")
    own = ranked.select(F.floor(F.col("rank") / size).cast("long").alias("block"), "rank", *carry, *slots)
    kinds = dict(own.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (*carry, *slots)]
                       + [f"_d{j} {kind}" for j in range(1, len(slots) + 1)])
    return own.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(
        _receive([*carry, *slots], len(slots), size), schema)


def _send(n: int, size: int, seed: int):
    """A task function: rows' values, a record per block of ranks that they are sent to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SENT:
                yield packed(pa.Table.from_batches(held))
                held = []
        if sum(b.num_rows for b in held):
            yield packed(pa.Table.from_batches(held))

    def packed(rows: pa.Table) -> pa.RecordBatch:
        rank = rows.column("rank").to_numpy()
        names = rows.column_names[1:]
        to = np.concatenate([permuted_numbers(rank, n, j, seed) for j in range(1, len(names) + 1)])
        block = to // size
        order = np.argsort(block, kind="stable")
        blocks, first = np.unique(block[order], return_index=True)
        ends = pa.array(np.append(first, len(order)).astype(np.int32))
        value = pa.concat_arrays([c for name in names for c in rows.column(name).chunks])
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks), pa.ListArray.from_arrays(ends, pa.array((to - block * size)[order].astype(np.int32))),
             pa.ListArray.from_arrays(ends, pa.array((order // len(rank)).astype(np.int32))),
             pa.ListArray.from_arrays(ends, value.take(pa.array(order)))], names=["block", "at", "j", "value"])

    return run


def _receive(keep: list[str], features: int, size: int):
    """A group function: a block's rows by rank, beside the values that were sent to them."""
    def run(own: pa.Table, sent: pa.Table) -> pa.Table:
        own = own.take(pa.array(np.argsort(own.column("rank").to_numpy())))

        def flat(name: str) -> pa.Array:
            return pa.concat_arrays([c.flatten() for c in sent.column(name).chunks])

        # Every place is met once, so the values only need sorting by feature and rank.
        order = np.argsort(flat("j").to_numpy().astype(np.int64) * size + flat("at").to_numpy())
        value = flat("value").take(pa.array(order))
        return pa.table([own.column(c) for c in keep]
                        + [value.slice(j * own.num_rows, own.num_rows) for j in range(features)],
                        names=[*keep, *[f"_d{j}" for j in range(1, features + 1)]])

    return run


def permutation_importance(df: DataFrame, key: str, slots: list[str], weights: list[float],
                           logit: str, truth: str,
                           threshold: float = SETTINGS.analysis_confidence,
                           seed: int = SETTINGS.seed, names=FEATURE_NAMES) -> DataFrame:
    """F1 lost when one feature at a time is shuffled under a linear scorer."""
    donors = shuffled(df, key, slots, [logit, truth], seed)
    logits = [F.col(logit)] + [
        F.col(logit) + F.lit(float(w)) * (F.col(f"_d{j}") - F.col(c))
        for j, (c, w) in enumerate(zip(slots, weights), 1)]
    return importance(donors, logits, truth, threshold, names)


def network_importance(df: DataFrame, key: str, slots: list[str], weights: dict, truth: str,
                       threshold: float = SETTINGS.analysis_confidence,
                       seed: int = SETTINGS.seed, names=FEATURE_NAMES) -> DataFrame:
    """F1 lost when one tabular feature at a time is shuffled under the fused network.

    ``df`` carries arrays ``text`` and ``video`` beside the features.  No variant changes
    these, so their share of the fused layer is taken first and travels in their place; the
    logits of a row and of its shuffled variants come from one pass.
    """
    shares = branch_share(df, weights, [key, *slots, truth], "share")
    donors = shuffled(shares, key, slots, ["share", truth], seed)
    shaped = donors.select(truth, "share", F.array(*slots).alias("own"), F.array(
        *[F.col(f"_d{j}") for j in range(1, len(slots) + 1)]).alias("other"))

    def variants(inputs):
        yield None, None, inputs["own"]
        for j in range(inputs["own"].shape[1]):
            changed = inputs["own"].copy()
            changed[:, j] = inputs["other"][:, j]
            yield None, None, changed

    scored = variant_logits(shaped, weights, [truth], variants, ["own", "other"], "share")
    logits = [F.col("logits")[j] for j in range(len(slots) + 1)]
    return importance(scored, logits, truth, threshold, names)


def network_ablation(df: DataFrame, weights: dict, truth: str,
                     threshold: float = SETTINGS.analysis_confidence) -> DataFrame:
    """Metrics of the fused network with one branch left out at a time."""
    names = ("Full Model", "Zero Text", "Zero Video", "Zero Tabular")

    def variants(inputs):
        t, v, x = (inputs[c] for c in ("text", "video", "tabular"))
        return [(t, v, x), (None, v, x), (t, None, x), (t, v, None)]

    scored = variant_logits(df, weights, [truth], variants, ["text", "video", "tabular"])
    return ablate(scored, {name: F.col("logits")[i] for i, name in enumerate(names)}, truth, threshold)


def importance(rows: DataFrame, logits: list[Column], truth: str, threshold: float, names
               ) -> DataFrame:
    """F1 of the first logit, of every further one, and what is lost, in one aggregate."""
    hits = [(logistic(z) >= threshold).cast("int").alias(f"_p{j}") for j, z in enumerate(logits)]
    sums = rows.select(F.col(truth).cast("int").alias("_y"), *hits).agg(
        F.sum("_y").alias("pos"), *[
            expr for j in range(len(logits)) for expr in (
                F.sum(F.col("_y") * F.col(f"_p{j}")).alias(f"tp{j}"),
                F.sum(f"_p{j}").alias(f"pp{j}"))])

    def f1(j: int) -> Column:
        return F.coalesce(F.try_divide(F.col(f"tp{j}") * 2.0, F.col("pos") + F.col(f"pp{j}")),
                          F.lit(0.0))

    found = F.array(*[F.struct(F.lit(name).alias("feature"), f1(0).alias("baseline_f1"),
                               f1(j).alias("shuffled_f1"), (f1(0) - f1(j)).alias("importance"))
                      for j, name in enumerate(names, 1)])
    return sums.select(F.explode(found).alias("r")).select("r.*")


def weight_norms(weights: DataFrame, feature: str, weight: str) -> DataFrame:
    """L2 norm per feature over a long (feature, unit, weight) table, largest first."""
    w = F.col(weight).cast("double")
    return (weights.groupBy(feature).agg(F.sqrt(F.sum(w * w)).alias("norm"))
            .orderBy(F.desc("norm"), feature))


def confusion_examples(df: DataFrame, position: str, truth: str, prob: str,
                       threshold: float = SETTINGS.analysis_confidence) -> DataFrame:
    """First true positive, true negative and misclassification in input order.

    If a category has no row, the first, second or third row stands in for it.
    """
    predicted = F.col(prob) >= threshold
    actual = F.col(truth) == 1
    kind = (F.when(actual & predicted, "True Positive")
            .when(~actual & ~predicted, "True Negative").otherwise("Misclassification"))
    shown = df.select(position, F.struct(
        F.col(position),
        F.when(actual, "Top").otherwise("Rest").alias("ground_truth"),
        F.col(prob).alias("tail_prob"),
        F.when(predicted, "Top").otherwise("Rest").alias("predicted")).alias("row"),
        kind.alias("category"))
    first = shown.groupBy("category").agg(F.min_by("row", position).alias("found"))
    # Three rows, numbered in order, give each category its stand-in.
    number = F.row_number().over(Window.orderBy(position))
    order = F.array(F.lit("True Positive"), F.lit("True Negative"), F.lit("Misclassification"))
    stand_in = (shown.orderBy(position).limit(3)
                .select(order[number - 1].alias("category"), F.col("row").alias("other")))
    return (stand_in.join(first, "category", "left")
            .select("category", F.coalesce("found", "other").alias("r")).select("category", "r.*"))


def with_captions(examples: DataFrame, captions: DataFrame, key: str, caption: str) -> DataFrame:
    """Show the first 80 characters of each example's caption.

    The examples are three rows, so it is they that travel to the caption table, and
    the few captions found travel back.
    """
    few = F.broadcast(examples.select(key).distinct())
    found = captions.select(key, caption).join(few, key, "left_semi")
    joined = examples.join(F.broadcast(found), key, "left")
    head = caption_head(F.col(caption))
    return joined.select(*examples.columns, F.when(head == "", "(no description)")
                         .otherwise(head).alias("caption"))
