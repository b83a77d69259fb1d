"""Benchmark decontamination by greedy string tiling (operator 9).

Texts and benchmark items are lower-cased and split into words of ASCII letters and digits and of
all other characters beyond ASCII. Rolling windows of LEAST words are joined as seeds by two hashes of
64 bits. A seed says which words stand at its places in the document, so the seeds of a document and an
item are all that tiling needs: no text is shuffled, and a window has one seed for an item, however often
the item repeats it.

Tiling marks, again and again, the longest common run of words that are not yet marked on either
side, down to LEAST words. Runs are found by Karp-Rabin: rolling hashes of windows whose
length starts high and falls. Since tiles may stand in any order, a passage with its sentences
reordered is covered like the passage itself. An item is leaked if MIN_COVER of its words are covered.

A pair whose seeds cannot cover so much is left out before tiling: m seeds cover LEAST * m words at most.

Defined results: null and empty texts and items have no words; items of fewer than LEAST words are never
found; rows of equal doc_id and text are one document; null doc_ids are documents like others; null item_ids are
items like others, told apart by their texts. Other columns are ignored, and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.licenses import SEPARATOR_RUN, SEPARATORS
from planloom.llm.shared import packed
from planloom.llm.text import pieces
from planloom.session import cut_lineage, join_small

LEAST = 5
MIN_COVER = 0.5
#: Different windows of the benchmark up to which they are broadcast, after a count; beyond, the join is a shuffle of hashes.
MAX_WINDOWS = 200_000
#: Longest window that Karp-Rabin starts with; longer runs are found by extension.
START = 32

_MOD, _BASE = (1 << 61) - 1, 1_000_003


def _free_windows(tokens: list, marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(rolling hash, start) of every window without a marked or missing token."""
    top = pow(_BASE, size - 1, _MOD)
    value = run = 0
    for i, token in enumerate(tokens):
        if token is None or marked[i]:
            value = run = 0
            continue
        if run == size:
            value = (value - tokens[i - size] * top) % _MOD
            run -= 1
        value = (value * _BASE + token) % _MOD
        run += 1
        if run == size:
            yield value, i - size + 1


def _prefix_hashes(tokens: list, marked: list[bool], odd: int) -> list[int]:
    """Rolling hashes of all beginnings; marked and missing tokens are equal to nothing (numbers from ``odd`` on)."""
    out, value = [0], 0
    for i, token in enumerate(tokens):
        value = (value * _BASE + (odd + i if token is None or marked[i] else token)) % _MOD
        out.append(value)
    return out


def _matches(item: list, text: list, item_marked: list[bool], text_marked: list[bool], size: int) -> list[tuple[int, int, int]]:
    """(-length, item place, text place) of common runs of at least ``size`` words, not extendable to the left.

    Windows are paired by the token before them, so of a phrase that repeats itself on both sides only the
    pairs at the ends of the repetition are made. How far a run goes is found by bisection on rolling hashes.
    """
    def before(tokens, marked, i, none):
        return none if not i or tokens[i - 1] is None or marked[i - 1] else tokens[i - 1]

    places: dict[int, dict] = {}
    for value, j in _free_windows(text, text_marked, size):
        places.setdefault(value, {}).setdefault(before(text, text_marked, j, None), []).append(j)
    starts: dict[int, dict] = {}
    for value, i in _free_windows(item, item_marked, size):
        if value in places:
            starts.setdefault(value, {}).setdefault(before(item, item_marked, i, None), []).append(i)
    if not starts:
        return []
    top = len(item) + 1
    a, b = _prefix_hashes(item, item_marked, top), _prefix_hashes(text, text_marked, top + len(item))
    most = min(len(item), len(text))
    power = [1]
    while len(power) <= most:
        power.append(power[-1] * _BASE % _MOD)

    def same(i, j, n):
        return (a[i + n] - a[i] * power[n] - b[j + n] + b[j] * power[n]) % _MOD == 0

    found = []
    for value, by_token in starts.items():
        for token, some in by_token.items():
            for other, there in places[value].items():
                if token is not None and token == other:
                    continue
                for i in some:
                    for j in there:
                        if item[i:i + size] != text[j:j + size]:
                            continue
                        low, high = size, min(len(item) - i, len(text) - j)
                        while low < high:
                            middle = (low + high + 1) // 2
                            low, high = (middle, high) if same(i, j, middle) else (low, middle - 1)
                        found.append((-low, i, j))
    return found


def tiles(item: list, text: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(length, item place, text place) of the tiles, longest first.

    Tokens are numbers; None in ``text`` is a place no run may cross. Of equally long runs the first in the
    item, then in the text, is marked first.
    """
    item_marked, text_marked, done = [False] * len(item), [False] * len(text), []
    size = max(least, min(START, len(item)))
    while True:
        queue = sorted(_matches(item, text, item_marked, text_marked, size))
        while queue:
            taken = False
            for n, i, j in queue:
                if any(item_marked[i:i - n]) or any(text_marked[j:j - n]):
                    taken = True  # an earlier tile has part of this run; what is left of it may be shorter
                    break
                done.append((-n, i, j))
                item_marked[i:i - n] = text_marked[j:j - n] = [True] * -n
            queue = sorted(_matches(item, text, item_marked, text_marked, size)) if taken else []
        if size == least:
            return done
        size = max(least, size // 2)


def windows(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, p, h1, h2: hashes (two of 64 bits) of every window of ``k`` words of the column ``text``."""
    split = rows.select(*keys, pieces(F.lower("text"), SEPARATORS, SEPARATOR_RUN).alias("w"))
    w = F.col("w")
    hashed = lambda *first: lambda i: F.xxhash64(*first, *[F.get(w, i + j) for j in range(k)])
    both = F.transform(F.sequence(F.lit(0), F.size(w) - k),
                       lambda i: F.struct(hashed()(i).alias("h1"), hashed(F.lit(k))(i).alias("h2")))
    # the outer form keeps Spark from pushing a filter on the list's size below the splitting
    rolled = split.withColumn("h", F.when(F.size(w) >= k, both)).select(*keys, F.posexplode_outer("h").alias("p", "h"))
    return rolled.where(F.col("p").isNotNull()).select(*keys, "p", "h.h1", "h.h2")


def listed(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, text): different items under a name that is never null."""
    name = F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string"))
    return benchmark.select("item_id", "text").distinct().select(name.alias("item"), "item_id", "text")


def seeds(docs: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text_key, item, p, q, n_q): window p of a document is window q of an item and n_q - 1 later ones.

    A document's window has one row for each item, however often the item repeats it.
    """
    of_items = cut_lineage(windows(items, ["item"], least).groupBy("item", "h1", "h2").agg(
        F.min("p").alias("q"), F.count("*").alias("n_q")))
    of_docs = windows(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), ["doc_id", "text_key"], least)
    return join_small(of_docs, of_items, ["h1", "h2"], max_rows=MAX_WINDOWS).drop("h1", "h2")


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, min_cover: float = MIN_COVER) -> DataFrame:
    """(doc_id, text_key, item_id, n_words, n_covered, n_tiles) of each document and item it leaks."""
    items = cut_lineage(listed(benchmark))
    words_of = items.select("item", "item_id", pieces(F.lower("text"), SEPARATORS, SEPARATOR_RUN).alias("words"))
    pairs = seeds(docs, items, least).groupBy("doc_id", "text_key", "item").agg(
        F.sort_array(F.collect_set(F.struct("p", "q", "n_q"))).alias("seeds"))
    met = F.array_distinct(F.transform("seeds", lambda x: F.struct(x["q"], x["n_q"])))
    reach = F.aggregate(met, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n_q"]) * least
    pairs = join_small(pairs.withColumn("reach", reach), words_of, "item").where(
        F.col("reach") >= F.size("words") * F.lit(min_cover)).select(
        "doc_id", "text_key", "item_id", "words", F.transform("seeds", lambda x: x["p"]).alias("p"),
        F.transform("seeds", lambda x: x["q"]).alias("q"))

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for words, ps, qs in zip(batch["words"], batch["p"], batch["q"]):
                number: dict[str, int] = {}
                item = [number.setdefault(w, len(number) + 1) for w in words]
                text: list[int | None] = []
                filled = -1  # the last place that stands in ``text``
                for p, q in zip(ps.tolist(), qs.tolist()):
                    if p > filled + 1 and text:
                        text.append(None)
                    at = max(p, filled + 1)
                    text += item[q + at - p:q + least]
                    filled = p + least - 1
                found = tiles(item, text, least)
                rows.append((len(item), sum(n for n, _, _ in found), len(found)))
            made = pd.DataFrame(rows, columns=["n_words", "n_covered", "n_tiles"])
            yield pd.concat([batch[["doc_id", "text_key", "item_id"]].astype("Int64").reset_index(drop=True), made], axis=1)

    covered = pairs.mapInPandas(
        tile, "doc_id long, text_key long, item_id long, n_words long, n_covered long, n_tiles long")
    return covered.where(F.col("n_covered") >= min_cover * F.col("n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    found = leaks(docs, benchmark).select(F.struct("doc_id", "text_key").alias("leaked")).distinct()
    whole = packed(docs)
    same = (F.col("row.doc_id").eqNullSafe(F.col("leaked.doc_id"))
            & (F.xxhash64("row.text") == F.col("leaked.text_key")))
    return whole.join(found, same, "left_anti").select("row.*")
