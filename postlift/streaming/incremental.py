"""Incremental composition of newly arrived base posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from ..config import SETTINGS
from ..sources.published import publish, read_published

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def seen_once(stream: DataFrame, key: str, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Rows whose ``key`` no earlier row of the stream had, over all its triggers and restarts.

    The keys are state, dealt by their hash.  With an ``event_time`` column and a
    ``delay`` they are forgotten once the watermark is that far past them, which bounds the
    state; without, every key is kept.  Rows without a key count as having one key.
    """
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def compose_stream(spark: SparkSession, source: str, schema, transform: Callable[
        [DataFrame], DataFrame], sink: str, checkpoint: str,
        rows_per_file: int = SETTINGS.shard_rows, files_per_trigger: int | None = None,
        key: str | None = None, event_time: str | None = None, delay: str | None = None,
        counts: dict[str, Column] | None = None) -> list[dict]:
    """Process every file not seen before, then stop; returns each trigger's number of rows read.

    ``counts`` are named aggregates of the arriving rows, taken on the side and returned as well.

    ``transform`` runs on each micro-batch and may join static tables (sidecars,
    asset map).  The checkpoint remembers the files already taken, which replaces
    skipping a number of rows by hand, and with ``key`` also the keys, so a row that is
    delivered again under another file name is left out (``seen_once``; the state lives in
    RocksDB, off the heap).  A batch is published under its own token: one that is
    retried after a failure adds nothing twice, and readers never see half of one.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    arriving = reader.parquet(source)
    if counts:
        arriving = arriving.observe("arrived", *[value.alias(name) for name, value in counts.items()])
    if key is not None:
        arriving = seen_once(arriving, key, event_time, delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        publish(transform(batch), sink, append=True, token=f"{stream_id}-{batch_id}", rows=rows_per_file)

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        query = (arriving.writeStream.foreachBatch(write)
                 .option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    return [{"batch": p.batchId, "read": p.numInputRows, **_observed(p)} for p in query.recentProgress]


def _observed(progress) -> dict:
    row = progress.observedMetrics.get("arrived")
    return row.asDict() if row is not None else {}


def read_shards(spark: SparkSession, sink: str) -> DataFrame:
    """All rows that streams have published in ``sink``."""
    return read_published(spark, sink)
