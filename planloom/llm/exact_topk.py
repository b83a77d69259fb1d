"""Exact top-k search by inner product (operator 12), with a uniform threshold in three phases.

A node is a segment of the dimensions over a block of the candidates; a score is the sum of a candidate's
partial scores in its segments. Queries and candidates are dealt into blocks, and a task holds one block of
either: no side is broadcast, and no group grows with the data.

1. *Lists.* Every node lists its ``k`` best partial scores of each query. The ``k`` best whole scores among
   what a block's nodes list go to the query; the k-th of all these is a safe cutoff: so much have k candidates.
2. *Collection.* The cutoff goes back with the query to every node. If a whole score reaches it, at least one of
   m partial scores reaches an m-th of it, so nodes collect exactly the entries that do.
3. *Resolution.* Of the collected candidates the task, which has the other segments of its block, adds up the
   whole score. Those that reach the cutoff are sorted, and the ``k`` best of each block go to the last ranking.

Whole scores are integers: a component x counts as floor(scale * x). Products are taken in doubles while the
largest possible sum is below 2^53, in 64-bit integers below 2^63, and in Python's integers beyond.

Defined results: vectors that are null or hold a null, infinite or NaN component take no part, nor do
rows without an id; of several rows with one id the smallest vector stands for all; a shorter vector counts as
filled with zeros, an empty one scores 0; components and scores outside 64 bits are held at the limit; ties
go to the smaller id; fewer than ``k`` candidates are all returned; without candidates a query has no row.
Columns other than the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.shared import written

#: Rows of a block of queries or candidates, and segments of the dimensions.
BLOCK = 8192
SEGMENTS = 4
#: Rows that a block has at least, where there are more tasks to be had than full blocks.
LEAST_BLOCK = 512
#: Partial scores of one segment held at a time.
HELD = 1 << 20

LIMIT = 1 << 63


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, v): integer components of the vectors that take part, one row for each id."""
    vector = F.col(vector_column)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))
    kept = vectors.where(F.col(id_column).isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return kept.select(F.col(id_column).alias("id"), whole.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """Vectors as rows of ``width`` components, zeros behind shorter ones."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out.astype(kind)


def _kind(width: int, top: int) -> type:
    """The cheapest type in which sums of ``width`` products of components up to ``top`` are exact."""
    most = max(1, width) * top * top * SEGMENTS
    return np.float64 if most < 1 << 53 else np.int64 if most < LIMIT else object


def _whole(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([min(max(x, -LIMIT), LIMIT - 1) for x in scores.ravel()], np.int64).reshape(scores.shape)
    return scores.astype(np.int64)


def _parts(queries: pa.Table, candidates: pa.Table, width: int, top: int):
    """For some queries at a time: their places, their own places among the candidates, partial scores by segment."""
    kind = _kind(width, top)
    q, c = _matrix(queries["v"], width, kind), _matrix(candidates["v"], width, kind)
    segments = np.array_split(np.arange(width), max(1, min(SEGMENTS, width)))
    ids, own_ids = candidates["id"].to_numpy(), queries["id"].to_numpy()
    order = np.argsort(ids)
    found = np.minimum(np.searchsorted(ids, own_ids, sorter=order), len(ids) - 1)
    own = np.where(ids[order[found]] == own_ids, order[found], -1)
    step = max(1, HELD // len(ids))
    for at in range(0, len(q), step):
        rows = slice(at, at + step)
        yield rows, own[rows], [q[rows][:, s] @ c[:, s].T for s in segments]


def _without_own(values: np.ndarray, own: np.ndarray, low) -> np.ndarray:
    rows = np.flatnonzero(own >= 0)
    values[rows, own[rows]] = low
    return values


def _lists(k: int, width: int, top: int):
    """Phase 1: the ``k`` best whole scores of what the nodes of a block list."""
    schema = pa.schema([("query_id", pa.int64()), ("score", pa.int64())])

    def lists(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        ids, scores = [], []
        if queries.num_rows and candidates.num_rows:
            names = queries["id"].to_numpy()
            for rows, own, parts in _parts(queries, candidates, width, top):
                listed = []
                for part in parts:
                    order = _without_own(part.astype(np.float64), own, -np.inf)
                    best = min(k, order.shape[1])
                    listed.append(np.argpartition(order, -best, axis=1)[:, -best:])
                listed = np.sort(np.concatenate(listed, axis=1), axis=1)
                whole = _whole(sum(np.take_along_axis(part, listed, axis=1) for part in parts))
                again = np.zeros(listed.shape, bool)
                again[:, 1:] = listed[:, 1:] == listed[:, :-1]
                use = ~again & (listed != own[:, None])
                # the best ones first, those that don't count last
                place = np.lexsort((-whole.astype(np.float64), ~use), axis=1)[:, :k]
                use, whole = np.take_along_axis(use, place, axis=1), np.take_along_axis(whole, place, axis=1)
                ids.append(np.broadcast_to(names[rows][:, None], use.shape)[use])
                scores.append(whole[use])
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, scores)]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=schema)

    return lists


def _resolved(k: int, width: int, top: int):
    """Phases 2 and 3: the ``k`` best of a block among the candidates that reach the cutoff."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def resolved(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = [[], [], []]
        if queries.num_rows and candidates.num_rows:
            names, ids = queries["id"].to_numpy(), candidates["id"].to_numpy()
            cutoffs = queries["cutoff"].to_numpy()
            for rows, own, parts in _parts(queries, candidates, width, top):
                cutoff = cutoffs[rows]
                least = cutoff[:, None].astype(parts[0].dtype)
                collected = np.broadcast_to((cutoff == -LIMIT)[:, None], parts[0].shape).copy()
                for part in parts:
                    collected |= (part * len(parts) >= least).astype(bool)
                row, column = np.nonzero(_without_own(collected, own, False))
                whole = _whole(sum(part[row, column] for part in parts))
                reached = whole >= cutoff[row]
                row, column, whole = row[reached], column[reached], whole[reached]
                order = np.lexsort((ids[column], ~whole, row))
                row, column, whole = row[order], column[order], whole[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                row, column, whole = row[nth < k], column[nth < k], whole[nth < k]
                for values, more in zip(out, (names[rows][row], ids[column], whole), strict=True):
                    values.append(more)
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=schema)

    return resolved


def _best(scores: DataFrame, k: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def _cells(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Rows dealt into blocks by their id, one copy for each block of the other side."""
    return (df.withColumn(own, F.pmod(F.xxhash64("id", F.lit(own)), F.lit(n_own).cast("bigint")))
            .withColumn(other, F.explode(F.expr(f"sequence(0L, {n_other - 1}L)"))))


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id",
           vector_column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other vectors of each row with ``is_query``, an
    expression on the column ``id``."""
    spark = vectors.sparkSession
    all_rows = written(quantised(vectors, id_column, vector_column, scale), "vectors")
    # columns of their own, as both sides of a cogroup come from one table
    queries = all_rows.where(is_query).select(F.col("id").alias("id"), F.col("v").alias("v"))
    largest = F.coalesce(F.max(F.greatest(*[F.abs(F.coalesce(f("v"), F.lit(0)).cast("decimal(20,0)"))
                                            for f in (F.array_min, F.array_max)])), F.lit(0))
    n, n_queries, width, top = all_rows.agg(
        F.count("*"), F.count_if(is_query), F.coalesce(F.max(F.size("v")), F.lit(0)), largest).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(1, -(-n // block), min(tasks, n // LEAST_BLOCK))
    q_blocks = max(1, -(-n_queries // block))

    def paired(left: DataFrame, phase, schema: str) -> DataFrame:
        left = _cells(left, "q_block", q_blocks, "c_block", n_blocks).groupBy("q_block", "c_block")
        right = _cells(all_rows, "c_block", n_blocks, "q_block", q_blocks).groupBy("q_block", "c_block")
        return left.cogroup(right).applyInArrow(phase(k, width, int(top)), schema)

    lists = paired(queries, _lists, "query_id bigint, score bigint")
    cutoffs = written(_best(lists, k, F.desc("score")).groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("score")).alias("cutoff")), "cutoffs")
    told = (queries.join(cutoffs, F.col("id") == F.col("query_id"), "left")
            .select("id", "v", F.coalesce("cutoff", F.lit(-LIMIT).cast("bigint")).alias("cutoff")))
    found = paired(told, _resolved, "query_id bigint, vec_id bigint, score bigint")
    return _best(found, k, F.desc("score"), F.asc("vec_id")).select("query_id", "rank", "vec_id", "score")
