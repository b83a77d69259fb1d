"""SimHash near-duplicates by multi-index hashing (operator 1).

A fingerprint is cut into two halves of 32 bits. Fingerprints that differ in at most
three bits differ in at most one bit of some half, so a ball of radius one around each
half finds every partner: the table holds each fingerprint under its two halves, and
each fingerprint asks for its halves and for those with one set bit cleared (of two
partners, that is the one with the bit; so half of each ball is enough). What comes
back is verified on all 64 bits inside the join.

Equal fingerprints are one entry of the table, with any number of documents. Only
fingerprints and links between them are shuffled, no texts.

Defined results: a null or empty text has fingerprint zero and is linked like any other;
repeated rows share a component; a null doc_id is never the smallest, and a component of
such rows only has a null component_id. Other columns are ignored by ``assign`` and kept
by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from planloom.llm.components import components
from planloom.llm.shared import packed
from planloom.session import cut_lineage

SHINGLE = 3
SEED = 42
HALF = 32

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Hashes whose bits are counted at once, which bounds the memory of a long text.
_BLOCK = 1 << 16


def shingles_of(text: str | None, shingle: int = SHINGLE) -> list[bytes]:
    """Runs of ``shingle`` lower-cased words; all words where there are fewer."""
    # bytes.split() parts at space and 0x09 to 0x0D
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < shingle:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    return [joined[a:b] for a, b in zip(starts[:len(words) - shingle + 1].tolist(), (ends[shingle - 1:] - 1).tolist())]


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as a signed 64-bit number (see the module's docstring)."""
    parts = shingles_of(text, shingle)
    if not parts:
        return 0
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(parts), _BLOCK):
        block = parts[at:at + _BLOCK]
        hashes = np.fromiter((digest(p, SEED) for p in block), np.dtype("<u8"), len(block))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(parts), bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint_of(t) for t in batch], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fingerprint) of each row, written once to the shared folder."""
    return cut_lineage(docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                                   _fingerprints("text").alias("fingerprint")))


def _half(n: int):
    whole = F.col("fingerprint")
    return F.shiftrightunsigned(whole, HALF) if n else whole.bitwiseAND(F.lit((1 << HALF) - 1))


def links(prints: DataFrame, most_bits: int = 3) -> DataFrame:
    """(u, v): pairs of different fingerprints with at most ``most_bits`` (3 or fewer) differing bits.

    A pair may come twice, once for each half.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("two halves with balls of radius one reach three differing bits")
    halves = F.explode(F.array(*[F.struct(F.lit(n).alias("half"), _half(n).alias("key")) for n in (0, 1)]))
    held = prints.select("fingerprint", halves.alias("at")).select("fingerprint", "at.half", "at.key")
    cleared = F.transform(F.sequence(F.lit(0), F.lit(HALF - 1)), lambda b: F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), b))
    ball = F.filter(cleared, lambda bit: F.col("key").bitwiseAND(bit) != 0)
    asked = held.select(F.col("fingerprint").alias("asker"), "half", "key", F.explode(F.concat(
        F.array(F.lit(0).cast("bigint")), ball)).alias("bit"))
    asked = asked.select("asker", "half", (F.col("key") - F.col("bit")).alias("key"), F.col("bit"))
    near = F.bit_count(F.col("asker").bitwiseXOR(F.col("fingerprint"))) <= most_bits
    once = (F.col("bit") != 0) | (F.col("asker") < F.col("fingerprint"))
    met = asked.join(held, (asked["half"] == held["half"]) & (asked["key"] == held["key"]) & near & once)
    return met.select(F.col("asker").alias("u"), F.col("fingerprint").alias("v"))


def _assigned(docs: DataFrame) -> DataFrame:
    """``fingerprints`` with root, the smallest fingerprint of the row's component."""
    rows = fingerprints(docs)
    prints = cut_lineage(rows.select("fingerprint").distinct())
    roots = cut_lineage(components(links(prints)).withColumnRenamed("node", "fingerprint"))
    return rows.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def assign(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row; component_id: smallest doc_id reachable."""
    rows = cut_lineage(_assigned(docs))
    smallest = cut_lineage(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rows.join(smallest, "root").select("doc_id", "fingerprint", "component_id")


def smallest_of_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the smallest of each root of ``rooted`` (doc_id, text_key, root).

    Of repeated rows one stays; of rows with equal doc_id and different texts, the one whose
    text has the smaller hash.
    """
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = rooted.groupBy("root").agg(F.min(at).alias("at")).select("at")
    same = F.col("row.doc_id").eqNullSafe(F.col("at.doc_id")) & (F.xxhash64("row.text") == F.col("at.text_key"))
    return packed(docs).join(first, same).dropDuplicates(["at"]).select("row.*")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each component, with all its columns (see ``smallest_of_each``)."""
    return smallest_of_each(docs, _assigned(docs))
