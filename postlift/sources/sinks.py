"""Writers for curated tables, sidecars, results and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SETTINGS
from .published import publish


def write_shards(df: DataFrame, path: str, rows: int = SETTINGS.shard_rows, token: str | None = None) -> int:
    """Replace the table in ``path`` by files of at most ``rows`` records, written by all tasks at once.

    They count from the moment their manifest stands (``read_published``): until then, and
    if the write is killed, readers see the former table.  A ``token`` that was
    published before makes a retry do nothing.
    """
    return publish(df, path, token=token, rows=rows)


def write_label_table(df: DataFrame, path: str, by_cohort: bool = False) -> int:
    """Publish the flat labelled table; by cohort, later month filters read only their folders."""
    return publish(df, path, by=("cohort_month",) if by_cohort else ())


def write_sidecars(df: DataFrame, path: str, folder: str = "username") -> None:
    """JSON records below one folder per creator; records without any value are skipped."""
    values = [c for c in df.columns if c != folder]
    has_value = F.coalesce(*[F.col(c).cast("string") for c in values]).isNotNull()
    df.where(has_value).write.mode("overwrite").partitionBy(folder).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Text with a header; the writing tasks are not funnelled into one file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_model(model, root: str, timecut: str, model_id: str) -> str:
    """A fitted model under <root>/<timecut>/<model_id>; returns the folder."""
    path = f"{root}/{timecut}/{model_id}"
    model.write().overwrite().save(path)
    return path
