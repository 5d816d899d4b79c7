"""Monthly panels: lagged feature matrices, timecuts and their windows.

Months are plain integers (year * 12 + month), so offsets are additions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.grid import TemporalSpec


def unique_panel(df: DataFrame, entity: str, month: str, order: str) -> DataFrame:
    """One row per (entity, month), the first by ``order``; a busy entity is reduced
    on the map side, and keeps at most one row per calendar month."""
    rest = F.struct(*[c for c in df.columns if c not in (entity, month)])
    return (df.groupBy(entity, month).agg(F.min_by(rest, order).alias("_row"))
            .select(entity, month, "_row.*"))


def only_entities(df: DataFrame, entity: str, wanted) -> DataFrame:
    """Keep the listed entities: a short list as a predicate, a table as a semi join."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select(entity), entity, "left_semi")
    return df.where(F.col(entity).isin(list(wanted)))


def default_features(df: DataFrame, *exclude: str) -> list[str]:
    """All numeric columns but the named ones (entity, month, target)."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [name for name, kind in df.dtypes if kind in numeric and name not in exclude]


def lag_pairs(panel: DataFrame, entity: str, month: str, features: list[str], target: str,
              h: int, window: int) -> DataFrame:
    """Feature rows paired with the label rows they may predict: h <= lag < h + window.

    The label months that a feature row serves are an interval as wide as a bucket of
    ``window`` months, so it touches one bucket or two: rows are copied twice at most
    whatever the window, meet the labels of their entity and bucket in an equi join, and the
    exact test drops what lies in a shared bucket but outside the interval.
    """
    month_, first = F.col(month), F.col(month) + h

    def bucket(value: Column) -> Column:
        return F.floor(value / window).cast("int")

    served = panel.select(
        entity, month_.alias("feature_month"), *features,
        F.explode(F.array_distinct(F.array(bucket(first), bucket(first + window - 1)))).alias("_bucket"))
    labels = panel.where(F.col(target).isNotNull()).select(
        entity, month_.alias("label_month"), target, bucket(month_).alias("_bucket"))
    lag = F.col("label_month") - F.col("feature_month")
    return (served.join(labels, [entity, "_bucket"]).where(lag.between(h, h + window - 1))
            .drop("_bucket").withColumn("lag", lag))


def supervised_matrix(panel: DataFrame, entity: str, month: str, target: str,
                      features: list[str], h: int, window: int,
                      label_months: Column | None = None) -> DataFrame:
    """Wide rows (entity, label_month, y, <feature>_lag<k>) for every label row.

    A sliding frame over each entity's months holds exactly the rows at lags
    h .. h + window - 1, so features and label meet after one shuffle, without a
    join or a pivot.  ``panel`` must be unique per (entity, month).  Rows with no
    feature value at all are left out; other gaps become 0.
    """
    frame = (Window.partitionBy(entity).orderBy(month)
             .rangeBetween(-(h + window - 1), -h))
    seen = F.collect_list(F.struct(F.col(month).alias("m"), *features)).over(frame)
    rows = panel.select(entity, F.col(month).alias("label_month"),
                        F.col(target).alias("y"), seen.alias("_seen"))
    rows = rows.where(F.col("y").isNotNull() & (F.size("_seen") > 0))
    if label_months is not None:
        rows = rows.where(label_months)
    keyed = rows.withColumn("_at", F.map_from_entries(
        F.transform("_seen", lambda r: F.struct(r["m"], r))))
    wide = keyed.select(entity, "label_month", F.col("y").cast("int").alias("y"), *[
        F.try_element_at("_at", F.col("label_month") - lag)[name].cast("double")
        .alias(f"{name}_lag{lag}")
        for name in features for lag in range(h, h + window)])
    lagged = wide.columns[3:]
    return wide.where(F.coalesce(*lagged).isNotNull()).fillna(0.0, lagged)


def align_columns(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Feature columns in the training order: extra ones go, absent ones are 0."""
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c)
                              for c in columns])


def append_by_name(first: DataFrame, second: DataFrame, fill: list[str] | None = None
                   ) -> DataFrame:
    """Union by column name; values missing on one side become 0 in ``fill`` columns."""
    both = first.unionByName(second, allowMissingColumns=True)
    return both.fillna(0, fill) if fill else both


def distinct_months(panel: DataFrame, month: str) -> DataFrame:
    return panel.select(month).distinct()


def timecuts(spec: TemporalSpec) -> list[int]:
    """End months, newest first, one per model update."""
    stop = spec.label_start + spec.feature_window + 2 * spec.h + spec.update_freq - 2
    return list(range(spec.label_end, stop - 1, -spec.update_freq))


def timecut_windows(panel: DataFrame, month: str, spec: TemporalSpec) -> DataFrame:
    """Training and validation month ranges of every usable timecut.

    The calendar of the panel is a short sorted array, one scalar for all cuts.
    A cut is dropped if its end month has no data or a side would be empty.
    """
    calendar = (distinct_months(panel, month)
                .agg(F.sort_array(F.collect_list(month)).alias("months")))
    cuts = F.array(*[F.lit(c) for c in timecuts(spec)] or [F.lit(None).cast("int")])
    one = calendar.select("months", F.explode(cuts).alias("val_end")).where("val_end is not null")
    start = F.array_min(F.filter(
        "months", lambda m: m > F.col("val_end") - spec.update_freq))
    ranged = one.withColumn("val_start", start).withColumn(
        "train_end", F.col("val_start") - spec.h).withColumn(
        "train_start", F.greatest(
            F.col("train_end") - spec.max_history_months + 1,
            F.lit(spec.label_start + spec.feature_window + spec.h - 1)))
    counted = ranged.withColumn("n_train", F.size(F.filter(
        "months", lambda m: m.between(F.col("train_start"), F.col("train_end"))))).withColumn(
        "n_val", F.size(F.filter(
            "months", lambda m: m.between(F.col("val_start"), F.col("val_end")))))
    usable = F.array_contains("months", F.col("val_end")) & (F.col("n_train") > 0) & (
        F.col("n_val") > 0)
    return counted.where(usable).drop("months")


def tag_cuts(matrix: DataFrame, cuts: list) -> DataFrame:
    """Repeat matrix rows for the timecuts and parts they take part in: timecut, part.

    One pass serves all cuts; the factor is at most twice their (small) number.  With
    no gap between the parts (h = 0) the first validation month is also a training
    month, so a row may appear in both.
    """
    month = F.col("label_month")
    if not cuts:
        return (matrix.limit(0).withColumn("timecut", F.lit(0))
                .withColumn("part", F.lit("train")))
    parts = F.array(*[
        F.when(month.between(c[f"{part}_start"], c[f"{part}_end"]), F.struct(
            F.lit(c["val_end"]).alias("timecut"), F.lit(part).alias("part")))
        for c in cuts for part in ("train", "val")])
    return (matrix.withColumn("_c", F.explode(F.array_compact(parts)))
            .select(*matrix.columns, "_c.timecut", "_c.part"))


def mean_fallback(tagged: DataFrame) -> DataFrame:
    """Validation rows scored with the training rows' mean label, per timecut."""
    means = tagged.where("part = 'train'").groupBy("timecut").agg(F.avg("y").alias("p"))
    # One row per timecut.
    return tagged.where("part = 'val'").join(F.broadcast(means), "timecut")
