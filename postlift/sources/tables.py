"""Readers: tables, delimited files, sidecar documents and media bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ranking import global_rank

# Up to this many rows a top-k heap per task is the cheaper way to take a head.
_HEAP_ROWS = 10_000


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet table; with ``schema`` only the declared columns are read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Delimited text with a header, typed by a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def resume_after(df: DataFrame, key: str, last_key) -> DataFrame:
    """Continue behind the last processed key: a filter the scan can push down."""
    return df.where(F.col(key) > F.lit(last_key))


def _key_at(df: DataFrame, key: str, position: int) -> Column:
    """The key at a 0-based position, as a scalar subquery (null past the end)."""
    ranked = global_rank(df.select(key), [key])
    return ranked.where(F.col("rank") == position).agg(F.max(key)).scalar()


def skip_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows after the first ``n`` in order of a unique ``key``.

    Only the keys are ranked (on many tasks); the wide rows are then filtered
    against one key, which never sends them through a global limit.
    """
    return df.where(F.col(key) >= _key_at(df, key, n))


def take_first(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows in order of ``key``: nulls first, as many of a tie as there is room for."""
    if n <= _HEAP_ROWS:
        return df.orderBy(key).limit(n)
    ranked = global_rank(df.withColumn("_tie", F.monotonically_increasing_id()), [key, "_tie"], "_rank")
    return ranked.where(F.col("_rank") < n).drop("_rank", "_tie")


def read_sidecars(spark: SparkSession, glob: str, schema, multi_line: bool = True) -> DataFrame:
    """JSON documents with the folder they lie in; unreadable ones give null fields."""
    docs = spark.read.schema(schema).option("multiLine", multi_line).json(glob)
    path = F.col("_metadata.file_path")
    return docs.select("*", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("folder"),
                       F.regexp_extract(path, r"([^/]+)$", 1).alias("file_name"))


def list_assets(spark: SparkSession, root: str) -> DataFrame:
    """Paths under ``root``; the contents are not read since only ``path`` is selected."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .select("path"))


def read_media(spark: SparkSession, root: str) -> DataFrame:
    """(id, video_bytes) for files named <id>.mp4 anywhere below ``root``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.mp4").load(root))
    return files.select(
        F.regexp_extract("path", r"(\d+)\.mp4$", 1).try_cast("bigint").alias("id"),
        F.col("content").alias("video_bytes")).where("id is not null")
