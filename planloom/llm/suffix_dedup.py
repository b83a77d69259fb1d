"""Removal of repeated byte strings with suffix arrays (operator 7).

A byte goes if some string of ``window`` bytes that covers it starts at another place too, in the same
or in another document. Strings do not cross documents.

Which suffixes must be compared. Every window is represented by an anchor, the gram in it with the
smallest hash (suffixes.anchors), so equal windows have the same anchor at the same distance. The windows of
one place of an anchor are one context of up to 2 * window bytes. An anchor with one place has no repeated
window. A context that occurs twice is repeated as a whole. What remains are anchors with different
contexts, each of which is fetched once.

Shards. Contexts are dealt out by anchor. A task puts contexts together to blocks of BLOCK_BYTES, sorts the
suffixes of each (Larsson-Sadakane), and takes the common prefixes of neighbours (Kasai): windows whose
neighbour shares ``window`` bytes are repeated. The contexts of an anchor with more than SHARD_CONTEXTS different ones
are dealt anew, by longer strings: the windows of a context are cut into blocks by their distance from the anchor, and the
core of a block, the bytes that all its windows have, names the new shard. Equal windows have equal distances and
equal cores. Sorted cores of all shards are merged by binary search: a block whose core stands in one context
only has no repeated window and goes; blocks that are still too many for one shard are cut further, down to single
windows, whose core is the window.

Hashes of 64 bits choose anchors and tell contexts of one anchor apart; inside blocks, bytes are compared.

Defined results: a null text is empty; texts shorter than ``window`` are kept; repeated rows remove each other's
bytes; null doc_ids are documents like others. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from planloom.llm import suffixes
from planloom.llm.shared import packed, written
from planloom.session import cut_lineage

WINDOW = 400
GRAM = 128
BLOCK_BYTES = 1_500_000
SHARD_CONTEXTS = 500

_SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
_CUT = StructType([StructField("spans", ArrayType(_SPAN)), StructField("kept", BinaryType())])

KEY = ["no_id", "doc_id", "text_key"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
                       F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))


def contexts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """KEY, anchor, context (its hash), first, last, reach: the windows of each place of an anchor in each document.

    ``reach`` is how far the anchor lies behind the first window.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            found, rows, hashes = [], [], []
            for row, text in enumerate(batch["bytes"]):
                anchor, place, first, last = suffixes.anchors(np.frombuffer(text, np.uint8), window, gram)
                if len(anchor):
                    found.append((anchor, first, last, place - first))
                    rows.append((row, len(anchor)))
                    hashes += [digest(text[a:b + window]) for a, b in zip(first.tolist(), last.tolist())]
            if not rows:
                continue
            at = np.repeat([r for r, _ in rows], [n for _, n in rows])
            made = batch[KEY].iloc[at].reset_index(drop=True)
            made["anchor"] = np.concatenate([x[0] for x in found]).view(np.int64)
            made["context"] = np.array(hashes, np.uint64).view(np.int64)
            for n, name in enumerate(("first", "last", "reach"), 1):
                made[name] = np.concatenate([x[n] for x in found])
            yield made

    kind = "no_id boolean, doc_id long, text_key long, anchor long, context long, first int, last int, reach int"
    return _keyed(docs).where(F.octet_length("bytes") >= window).mapInPandas(find, kind)


def fetched(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(anchor, context, n, reach, hot, bytes) of ``wanted``: KEY, first, last and the same columns."""
    names = ["anchor", "context", "n", "reach", "hot"]
    by_doc = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last", *names)).alias("wanted"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*[x[c] for c in names], text[x["first"]:x["last"] + window])
                    for text, many in zip(batch["bytes"], batch["wanted"]) for x in many]
            yield pd.DataFrame(rows, columns=[*names, "bytes"])

    return _keyed(docs).join(by_doc, KEY).select("bytes", "wanted").mapInPandas(
        cut, "anchor long, context long, n long, reach int, hot boolean, bytes binary")


def repeated_starts(parts: list[bytes], counts: list[int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of all ``parts``, one after the other: part, start in it, and group (-1: of its own).

    Windows of one group are equal. A window of a part that occurs twice (counts) is repeated, which is the
    caller's to see to.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    begin, n_starts = np.cumsum(sizes) - sizes, sizes - window + 1
    part = np.repeat(np.arange(len(parts)), n_starts)
    start = np.arange(len(part)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    whole = np.full(len(data), -1, np.int64)
    whole[begin[part] + start] = np.arange(len(part))
    order = suffixes.suffix_array(data, window)
    order = order[whole[order] >= 0]  # suffixes that are windows of their own part
    long = suffixes.common_prefixes(data, order, window) >= window
    group = np.full(len(part), -1, np.int64)
    group[whole[order]] = np.cumsum(~long)
    alone = ~long & ~np.concatenate((long[1:], [False]))
    group[whole[order[alone]]] = -1
    return part, start, group


def _runs(part: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of consecutive starts of one part."""
    ends = np.flatnonzero(np.concatenate(((part[1:] != part[:-1]) | (start[1:] != start[:-1] + 1), [True])))
    return np.concatenate(([0], ends[:-1] + 1)), ends


_FOUND = "anchor long, context long, from_start int, to_start int"


def _judge_block(rows: list[tuple], window: int) -> pd.DataFrame:
    """Repeated runs of starts."""
    anchor, context, offset, n, parts = map(list, zip(*rows))
    part, start, group = repeated_starts(parts, n, window)
    again = (group >= 0) | (np.array(n)[part] > 1)
    part, start = part[again], start[again]
    if not len(part):
        return pd.DataFrame(columns=[c.split()[0] for c in _FOUND.split(", ")])
    a, b = _runs(part, start)
    p, shift = part[a], np.array(offset, np.int64)[part[a]]
    return pd.DataFrame({"anchor": np.array(anchor, np.int64)[p], "context": np.array(context, np.int64)[p],
                         "from_start": start[a] + shift, "to_start": start[b] + shift})


def _judged(dealt: DataFrame, window: int) -> DataFrame:
    """Runs of repeated windows within the shards of ``dealt`` (shard, anchor, context, offset, n, bytes)."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*[batch[c].tolist() for c in ("shard", "anchor", "context", "offset", "n", "bytes")]):
                if last and row[0] != last[0] and size >= BLOCK_BYTES:
                    yield _judge_block(block, window)
                    block, size, last = [], 0, None
                if last is None or row[:4] != last[:4]:  # repeated rows fetch a context twice
                    block.append((*row[1:5], bytes(row[5])))
                    size += len(row[5])
                last = row
        if block:
            yield _judge_block(block, window)

    ordered = dealt.repartition("shard").sortWithinPartitions("shard", "anchor", "context", "offset")
    return ordered.mapInPandas(judge, _FOUND)


def block_sizes(window: int, gram: int) -> list[int]:
    """Numbers of distances in one block, from round to round; the last is one."""
    sizes = [1 << max((window - gram + 1) // 2, 1).bit_length() - 1]
    while sizes[-1] > 1:
        sizes.append(max(sizes[-1] // 4, 1))
    return sizes


def _blocks(rows: DataFrame, window: int, size: int) -> DataFrame:
    """(anchor, context, n, low, high, core, span, from_start, to_start): blocks of ``size`` distances of each row.

    ``rows`` (anchor, context, n, reach, low, high, bytes): windows at distances low to high from the anchor.
    """
    names = ["anchor", "context", "n", "low", "high", "core", "span", "from_start", "to_start"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            made = []
            for anchor, context, n, reach, low, high, text in zip(
                    *[batch[c].tolist() for c in ("anchor", "context", "n", "reach", "low", "high", "bytes")]):
                last = len(text) - window
                near, far = max(low, reach - last), min(high, reach)
                for a in range(near // size * size, far + 1, size):
                    b = a + size - 1
                    # all windows of the block, also those that the context lacks, have these bytes
                    core = digest(text[reach - a:reach - b + window], (anchor ^ a) & 0xFFFFFFFFFFFFFFFF)
                    first, final = max(reach - b, reach - far), min(reach - a, reach - near)
                    span = digest(text[first:final + window], first - reach & 0xFFFF)
                    made.append((anchor, context, n, a, b, core, span, first, final))
            table = pd.DataFrame(made, columns=names)
            for c in ("core", "span"):
                table[c] = np.array(table[c].tolist(), np.uint64).view(np.int64)
            yield table

    return rows.mapInPandas(cut, "anchor long, context long, n long, low int, high int, core long, span long, "
                                 "from_start int, to_start int")


def _holders(spans: DataFrame) -> DataFrame:
    """(core, holders): how many rows have each core. Sorted cores are counted by binary search, then over all shards."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["core"].to_numpy(np.int64)
            heads = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
            n = np.searchsorted(keys, heads, "right") - np.searchsorted(keys, heads, "left")
            yield pd.DataFrame({"core": heads, "n": n})

    counted = spans.select("core").sortWithinPartitions("core").mapInPandas(count, "core long, n long")
    return counted.groupBy("core").agg(F.sum("n").alias("holders"))


def dealt_anew(hot: DataFrame, window: int, gram: int, shard_contexts: int) -> tuple[DataFrame, DataFrame]:
    """(rows for _judged, runs of blocks that occur twice as they are) of contexts of hot anchors.

    A span of a core that occurs again is repeated as a whole; one holder of it stays, as partner for other
    spans of the core. A round leaves at most four blocks of a row, mostly one or two: blocks inside a
    shared passage have one span, those outside have a core of their own, only those on its edges are cut further.
    """
    whole = hot.withColumns({"low": F.lit(0), "high": F.lit(window - gram)})
    shards, runs = None, None
    for size in block_sizes(window, gram):
        made = written(_blocks(whole, window, size), "blocks")
        spans = cut_lineage(made.groupBy("core", "span").agg(
            F.sum("n").alias("n"), F.min(F.struct("anchor", "context", "from_start", "to_start", "low", "high")).alias("at")))
        counted = cut_lineage(spans.join(_holders(spans).where("holders > 1"), "core"))
        twice = made.join(spans.where("n > 1").select("core", "span"), ["core", "span"]).select(
            "anchor", "context", "from_start", "to_start")
        named = counted.select("core", "holders", "n", "at.*")
        few = named.where(F.col("holders") <= shard_contexts).drop("n").join(hot, ["anchor", "context"]).select(
            F.col("core").alias("shard"), "anchor", "context", F.col("from_start").alias("offset"), "n",
            F.expr(f"substring(bytes, from_start + 1, to_start - from_start + {window})").alias("bytes"))
        shards = few if shards is None else shards.unionByName(few)
        runs = twice if runs is None else runs.unionByName(twice)
        many = named.where(F.col("holders") > shard_contexts).select("anchor", "context", "low", "high")
        if many.isEmpty():
            break
        whole = many.join(hot, ["anchor", "context"])
    return shards, runs


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """KEY and (start, end) of stretches to remove; they may overlap."""
    all_places = written(contexts(docs, window, gram), "contexts")
    again = cut_lineage(all_places.groupBy("anchor").count().where("count > 1").select("anchor"))
    places = written(all_places.join(again, "anchor"), "places")
    by_context = cut_lineage(places.groupBy("anchor", "context").agg(
        F.count("*").alias("n"), F.min(F.struct(*KEY, "first", "last", "reach")).alias("at")))
    sizes = by_context.groupBy("anchor").agg(F.count("*").alias("n_contexts"))
    contested = cut_lineage(sizes.where("n_contexts > 1").select("anchor", (F.col("n_contexts") > shard_contexts).alias("hot")))
    wanted = by_context.join(contested, "anchor").select("at.*", "anchor", "context", "n", "hot")
    bytes_of = written(fetched(docs, wanted, window), "fetched")
    dealt = bytes_of.where("NOT hot").select(
        F.col("anchor").alias("shard"), "anchor", "context", F.lit(0).alias("offset"), "n", "bytes")
    twice = None
    if not contested.where("hot").isEmpty():
        anew, twice = dealt_anew(bytes_of.where("hot").drop("hot"), window, gram, shard_contexts)
        dealt = dealt.unionByName(anew)
    judged = written(_judged(dealt, window), "judged")
    runs = judged if twice is None else judged.unionByName(twice)
    within = places.join(runs, ["anchor", "context"])
    partly = within.select(*KEY, (F.col("first") + F.col("from_start")).alias("start"),
                           (F.col("first") + F.col("to_start") + window).alias("end"))
    # all places of these have one context
    wholly = places.join(contested, "anchor", "left_anti").select(
        *KEY, F.col("first").alias("start"), (F.col("last") + window).alias("end"))
    return partly.unionByName(wholly)


@F.pandas_udf(_CUT)
def _cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
    """Merged runs, and the bytes outside them; null where nothing was found."""
    spans, kept = [], []
    for text, places in zip(texts, found):
        if text is None:
            spans.append(None)
            kept.append(None)
            continue
        runs: list[list[int]] = []
        for x in places:
            if runs and x["start"] <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], x["end"])
            else:
                runs.append([x["start"], x["end"]])
        edges = [0, *[e for run in runs for e in run], len(text)]
        kept.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]))
        spans.append([{"start": a, "end": b} for a, b in runs])
    return pd.DataFrame({"spans": pd.Series(spans, dtype=object), "kept": pd.Series(kept, dtype=object)})


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """``docs`` with _spans (removed runs of bytes: array of (start, end), null: none) and _kept (the other bytes).

    What is kept need not be valid UTF-8: a run may begin or end inside a character.
    """
    spans = repeated_spans(docs, window, gram, shard_contexts).groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_found"))
    spans = spans.select(F.struct(*KEY).alias("place"), "_found")
    text = F.col("row.text")
    own = (F.col("row.doc_id").isNull(), F.coalesce("row.doc_id", F.lit(0)), F.xxhash64(text))
    same = [value == F.col(f"place.{c}") for value, c in zip(own, KEY)]
    joined = packed(docs).join(spans, same[0] & same[1] & same[2], "left")
    whole = F.coalesce(text, F.lit("")).cast("binary")
    cut = joined.withColumn("_cut", _cut(F.when(F.col("_found").isNotNull(), whole), "_found"))
    return cut.select("row.*", F.col("_cut.spans").alias("_spans"), F.coalesce("_cut.kept", whole).alias("_kept"))
