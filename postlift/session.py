"""Session defaults and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Paths handed out, per application, and those of the innermost ``passing`` block.
_PATHS: dict[str, list[str]] = {}
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


# A creator or entity may own a large share of all rows: oversized join partitions
# are split even where that costs another exchange.
ADAPTIVE = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Quantile sketches per month: some hundred groups fit in a task's hash table.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
    # Java leaves methods of over 8,000 bytes uncompiled; wide rows with many rules reach that in one stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# A step's shuffle files are deleted when it ends.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

# Rows that lie together by one of a join's keys need not be dealt anew by all of them.
TOGETHER = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}

# A batch that passes between a task and its Python worker is held several times over, on both
# sides; counted by rows alone, it grows with the texts.
ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": "6m"}


def prepare(spark: SparkSession, settings: dict[str, str] = ADAPTIVE) -> SparkSession:
    """Apply the runtime settings every plan here relies on where the session has others.

    They stay set: plans are lazy and read them when they run.
    """
    for key, value in settings.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "postlift", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution (skew splits included) and UTC clocks."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Recording a Python call site for every column costs more than building small plans.
    defaults = {**ADAPTIVE, "spark.python.sql.dataFrameDebugging.enabled": "false"}
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (or set on the context).

    Only a local session may run without that setting and writes beside its tables; on
    a cluster every executor must see the folder, so a missing setting is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder, remembered until it is released."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    if (own := _PASSING.get()) is not None:
        own.append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def release_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete what this application has put below the scratch folder, from the ``since``th path on.

    Frames that read those tables are void afterwards; returns how many paths went.
    """
    paths = _PATHS.get(spark.sparkContext.applicationId, [])
    gone, paths[since:] = paths[since:], []
    _delete(spark, gone)
    return len(gone)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of a block, the lineage cuts and files that were made inside it."""
    before = len(_PATHS.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release_scratch(spark, before)


@contextmanager
def holding(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Runtime settings for the steps that run inside a block; the former ones return after it."""
    former = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in former.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Keep of a block's steps nothing but what they lead to.

    Shuffle files go as each step ends, not when the driver happens to collect its garbage, and
    the lineage cuts and files made inside (by this thread) at the end of the block.  What
    outlives the block has its path from before it.
    """
    own: list[str] = []
    outer = _PASSING.set(own)
    try:
        with holding(spark, CLEANED):
            yield
    finally:
        _PASSING.reset(outer)
        _delete(spark, own)


def materialize(df: DataFrame, name: str = "stage", path: str | None = None) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder and reading it back.

    Used where several passes read the same joined rows, so the join runs once;
    the copy is columnar, so later passes still prune columns, and it outlives
    lost executors.  ``scratch_scope`` deletes it once the caller is done.  ``path`` is a
    scratch path taken earlier, for rows that outlive a ``passing`` block.
    """
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
