"""Tables published whole: data is written aside, and a numbered manifest says what counts.

A table is a folder with ``data/<name>`` folders of Parquet files and ``_manifest/<number>``
documents.  The highest number holds: readers take the folders that it lists and nothing
else, so a write that was killed half way, or is still going on, is not seen.  A number can
be taken once, by renaming a finished document to a name that must not exist yet.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..config import SETTINGS


class Conflict(RuntimeError):
    """Another writer has published meanwhile."""


class DocumentLog:
    """Numbered JSON documents in a folder of any file system that Spark can write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.folder = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.folder.getFileSystem(self.conf)

    def latest(self) -> tuple[int, dict | None]:
        """The highest number and its document; 0 and none before the first."""
        if not self.fs.exists(self.folder):
            return 0, None
        names = [s.getPath().getName() for s in self.fs.listStatus(self.folder)]
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return 0, None
        number = max(numbers)
        place = self.jvm.org.apache.hadoop.fs.Path(self.folder, f"{number:012d}")
        stream = self.fs.open(place)
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return number, json.loads(text)

    def add(self, number: int, document: dict) -> None:
        """Store ``document`` under ``number``; raises ``Conflict`` if that is taken."""
        path = self.jvm.org.apache.hadoop.fs.Path
        aside = path(self.folder, f"aside-{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(document).encode()))
        finally:
            stream.close()
        target = path(self.folder, f"{number:012d}")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), self.conf)
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            context.rename(aside, target, self.gateway.new_array(kind, 0))
        except Py4JJavaError as error:
            self.fs.delete(aside, False)
            if self.fs.exists(target):
                raise Conflict(f"document {number} is there already") from error
            raise


def _manifest(spark: SparkSession, path: str) -> DocumentLog:
    return DocumentLog(spark, f"{path}/_manifest")


def publish(df: DataFrame, path: str, append: bool = False, token: str | None = None,
            rows: int = SETTINGS.shard_rows, by: tuple[str, ...] = ()) -> int:
    """Write ``df`` beside the table's present files and then make it count; returns the manifest's number.

    Files have at most ``rows`` records each, packed by zstd: tables may hold media, which are all they
    take on disk.  Without ``append`` the new files take the
    place of all others.  A ``token`` that the table has seen makes the call do nothing, so
    a retried write adds nothing.  Appends of several writers follow each other; a
    replacement that meets another writer raises ``Conflict``.  What a killed write leaves is
    never listed (``drop_unlisted`` removes it).
    """
    spark, log = df.sparkSession, _manifest(df.sparkSession, path)
    number, held = log.latest()
    if token is not None and token in (held or {}).get("tokens", ()):
        return number
    folder = f"data/{uuid.uuid4().hex}"
    writer = df.write.option("maxRecordsPerFile", rows).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/{folder}")
    while True:
        document = {"folders": [*(held or {}).get("folders", ()), folder] if append else [folder],
                    "tokens": [*(held or {}).get("tokens", ()), *([token] if token is not None else [])]}
        try:
            log.add(number + 1, document)
            return number + 1
        except Conflict:
            if not append:
                raise
            number, held = log.latest()
            if token is not None and token in held["tokens"]:
                return number


def read_published(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table as the newest manifest has it; a frame keeps to that state when others publish."""
    number, held = _manifest(spark, path).latest()
    if not number:
        raise FileNotFoundError(f"nothing is published in {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    parts = [reader.option("basePath", f"{path}/{f}").parquet(f"{path}/{f}") for f in held["folders"]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def drop_unlisted(spark: SparkSession, path: str) -> int:
    """Delete data folders the newest manifest does not list; none may be in writing.  Returns how many went."""
    log = _manifest(spark, path)
    listed = {f.split("/")[-1] for f in (log.latest()[1] or {"folders": ()})["folders"]}
    data = log.jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    gone = [s.getPath() for s in log.fs.listStatus(data) if s.getPath().getName() not in listed]
    for place in gone:
        log.fs.delete(place, True)
    return len(gone)


def write_ranges(df: DataFrame, path: str, key: str, ranges: int | None = None) -> None:
    """Publish ``df`` in order of a ``key`` without nulls, cut into ranges with stored bounds.

    Every range is a folder whose files hold its keys in order; the bounds, one row
    per range, stand in the manifest.  ``ranges`` defaults to the shuffle partitions.
    """
    spark, log = df.sparkSession, _manifest(df.sparkSession, path)
    number, _ = log.latest()
    dealt = df.repartitionByRange(ranges, key) if ranges else df.repartitionByRange(key)
    folder = f"data/{uuid.uuid4().hex}"
    (dealt.withColumn("_range", F.spark_partition_id()).sortWithinPartitions(key)
     .write.partitionBy("_range").parquet(f"{path}/{folder}"))
    bounds = (spark.read.schema(StructType([*df.schema, StructField("_range", IntegerType())])).parquet(f"{path}/{folder}").groupBy("_range")
              .agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n")))
    # One row per range, as texts that the key's type reads back.
    listed = bounds.select("_range", F.col("first").cast("string"), F.col("last").cast("string"), "n").collect()
    log.add(number + 1, {
        "folders": [folder], "tokens": [], "key": key, "type": df.schema[key].dataType.simpleString(),
        "schema": df.schema.json(), "ranges": [list(r) for r in sorted(listed)]})


def read_after(spark: SparkSession, path: str, after=None) -> DataFrame:
    """Rows of a ``write_ranges`` table whose key follows ``after``; ranges that end before are not opened."""
    held = _manifest(spark, path).latest()[1]
    root, kind = f"{path}/{held['folders'][0]}", held["type"]
    schema, wanted = StructType.fromJson(json.loads(held["schema"])), held["ranges"]
    if after is not None:
        ends = spark.createDataFrame([(r[0], r[2]) for r in held["ranges"]], "r int, last string")
        follows = F.col("last").cast(kind) > F.lit(after)
        kept = {r.r for r in ends.where(follows).collect()}
        wanted = [r for r in wanted if r[0] in kept]
    if not wanted:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{root}/_range={r[0]}" for r in wanted])
    return rows if after is None else rows.where(_follows(held["key"], after))


def _follows(key: str, after) -> Column:
    return F.col(key) > F.lit(after)


def save_mark(spark: SparkSession, path: str, name: str, key) -> None:
    """Remember how far the reader ``name`` of a table has come; marks never go back."""
    log = DocumentLog(spark, f"{path}/_marks/{name}")
    number, held = log.latest()
    if held is None or key > held["key"]:
        log.add(number + 1, {"key": key})


def load_mark(spark: SparkSession, path: str, name: str):
    """The last key that ``save_mark`` was given for ``name``, or none."""
    held = DocumentLog(spark, f"{path}/_marks/{name}").latest()[1]
    return held and held["key"]
