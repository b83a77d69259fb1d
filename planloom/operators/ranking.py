"""Row numbers within a key, also when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.functions.geometry import BOX
from planloom.session import split_hot, written

GROUP_LIMIT = 500_000


def rank_within(df: DataFrame, keys: list[str], order: list, name: str,
                limit: int = GROUP_LIMIT) -> DataFrame:
    """Add ``name``: 1, 2, ... per ``keys`` in ``order`` (a total order).

    Groups up to ``limit`` rows use a window. Larger ones are range-partitioned
    on (keys, order), numbered inside each partition, and shifted by the number
    of rows of the same key in earlier partitions.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    normal, hot = split_hot(df, keys, limit)
    w = Window.partitionBy(*keys).orderBy(*order)
    out = normal.withColumn(name, F.row_number().over(w).cast("long"))
    return out if hot is None else out.unionByName(_rank_by_range(hot, keys, order, name))


def _rank_by_range(df, keys, order, name) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(k) for k in keys]
    # The id is partition << 33 | position. It is written out, so that the
    # counts and the rows below see the same partitions.
    placed = written(df.repartitionByRange(parts, *cols, *order)
                     .sortWithinPartitions(*cols, *order)
                     .withColumn("_id", F.monotonically_increasing_id())
                     .withColumn("_part", F.shiftright("_id", 33)))
    counts = placed.groupBy(*keys, "_part").agg(F.min("_id").alias("_first"),
                                                F.count("*").alias("_n"))
    # at most one row per key and partition
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return (placed.join(starts, [*keys, "_part"])
            .withColumn(name, F.col("_id") - F.col("_first") + F.col("_before") + 1)
            .select(*df.columns, name))


def reading_order(df: DataFrame, on=("sheet_id",), tie=("det_idx",), name: str = "read_pos",
                  limit: int = GROUP_LIMIT) -> DataFrame:
    """Number runs top to bottom, then left to right."""
    return rank_within(df, list(on), [BOX[1], BOX[0], *tie], name, limit)
