"""Session helpers: lineage cuts and checks on group size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names.

    A folder of our own is only made where none is named *and* the session
    runs in one process (tests); on a cluster an unset folder is an error,
    because a machine-local folder would not survive the loss of an executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if named:
            spark.sparkContext.setCheckpointDir(named)
        elif spark.sparkContext.master.startswith("local"):
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and read it back.

    A checkpoint holds rows as they lie in memory; these files are compressed by
    column, and a step that follows reads the columns it needs.
    """
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._written_to = folder
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a table from ``written`` that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within this, shuffle files go when the step that made them has ended; else they stay until the driver's
    garbage is collected. For steps that are written once and never run again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": str(1 << 20)}


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Within this, Spark broadcasts on its own only what took 1 MB when it was shuffled, and nothing on an estimate: that
    takes the compressed files of ``written`` for their rows and leaves out what an explode adds."""
    before = {name: spark.conf.get(name, None) for name in _BROADCAST}
    for name, value in _BROADCAST.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None when there are none.

    Only counts are shuffled (partial aggregation runs next to the scan). The
    answer has at most rows / limit entries and is written out once, so later
    uses do not count again.
    """
    counts = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    if counts.isEmpty():
        return None
    return cut_lineage(counts)


def split_hot(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Split rows into bounded groups and (if any) the rows of hot groups."""
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return df, None
    return join_small(df, hot, keys, "left_anti"), join_small(df, hot, keys, "left_semi")


#: Rows of one task after a shuffle, where a table has more than the session's tasks can hold at that rate.
TASK_ROWS = 300_000


def dealt(df: DataFrame, keys: list[str], part_of: DataFrame | None = None) -> DataFrame:
    """``df`` spread by ``keys`` over more tasks than the session's usual number, if it has more than TASK_ROWS rows for
    each of these, so that what a task sorts or lists does not grow with the table. Counts the rows of ``df``, or of a
    table it is part of, which should be cheap to read."""
    tasks = -(-(part_of or df).count() // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


#: A dimension table up to this many rows and bytes (written as JSON) may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def join_small(df: DataFrame, dim: DataFrame, on, how: str = "inner",
               max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a dimension table: broadcast if its rows and their bytes prove it
    small, otherwise leave the choice (and skew handling) to adaptive execution."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in dim.columns])))
    rows, size = dim.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    small = rows <= max_rows and size <= BROADCAST_BYTES
    return df.join(F.broadcast(dim) if small else dim, on, how)
