"""Best-fit packing of token sequences (operator 6).

A document is cut only if it is longer than a sequence: all its pieces are then full but the
first. Pieces go online, in the order of (doc_id, piece), into the fullest open sequence that
still has room. Open sequences are kept by their free space; the free spaces in use are the
bits of one integer, so that the best fit is its lowest set bit from the piece's length on.
At most ``open_bins`` are open: where one more is needed, the fullest is closed.

Tokenising and packing are two jobs. Only the lengths of pieces go through the second, which
is dealt out evenly to tasks of PIECES_PER_TASK pieces; each leaves at most ``open_bins``
sequences that others could have filled.

Defined results: a null or empty text has the end id alone; a document without any token
(no end id, empty text) has no piece; repeated rows are packed once each. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.tokens import encoder, ids_bytes
from planloom.session import cut_lineage

CAPACITY = 1024
OPEN_BINS = 1024
PIECES_PER_TASK = 250_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's pieces; with_ids adds their ids (4 bytes each)."""
    ending = b"" if end_id is None else ids_bytes([end_id])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        try:
            for batch in batches:
                rows = []
                for doc_id, no_id, text in zip(batch["doc_id"].tolist(), batch["no_id"].tolist(), batch["text"]):
                    ids = encode(text) + ending
                    n = len(ids) // 4
                    ends = range(n - capacity * ((n - 1) // capacity), n + 1, capacity) if n else ()
                    start = 0
                    for piece, end in enumerate(ends):
                        part = ids[4 * start:4 * end]
                        row = (None if no_id else doc_id, piece, start, end - start, zlib.crc32(part))
                        rows.append((*row, part) if with_ids else row)
                        start = end
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                made = pd.DataFrame(rows, columns=names)
                yield made.astype({"doc_id": "Int64"})
        finally:
            encoder.cache_clear()  # workers live on, and later steps need their memory

    texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(cut, PIECE + ", ids binary" * with_ids)


class BestFit:
    """Bounded-space best fit of lengths into bins of ``capacity``."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.spaces = 0  # bit f is set while an open bin has f free
        self.by_space: dict[int, list[int]] = defaultdict(list)
        self.n_open = self.n_bins = 0

    def _take(self, space: int) -> int:
        stack = self.by_space[space]
        found = stack.pop()
        if not stack:
            self.spaces &= ~(1 << space)
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens; sequences hold {self.capacity}")
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(space)
        else:
            space, chosen = self.capacity, self.n_bins
            self.n_bins += 1
        left = space - length
        if left:
            if self.n_open == self.open_bins:
                fullest = (self.spaces & -self.spaces).bit_length() - 1
                if fullest >= left:  # the one at hand is the fullest itself
                    return chosen, self.capacity - space
                self._take(fullest)
            self.by_space[left].append(chosen)
            self.spaces |= 1 << left
            self.n_open += 1
        return chosen, self.capacity - space


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``cut`` (columns of PIECE) with sequence_id and offset.

    ``cut`` is read twice, to count and to pack: pass a written table.
    """
    tasks = -(-cut.count() // pieces_per_task) or 1

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, first = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch["length"].tolist()]
            at = np.array(placed, np.int64).reshape(-1, 2)
            yield batch.assign(doc_id=batch["doc_id"].astype("Int64"), sequence_id=at[:, 0] + first, offset=at[:, 1])

    dealt = cut.repartition(tasks).sortWithinPartitions("doc_id", "piece", "length", "ids_crc32")
    return dealt.mapInPandas(fill, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut_lineage(pieces(docs, tokenizer, end_id, capacity)), capacity)


def sequences(cut_with_ids: DataFrame, packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from ``pieces(..., with_ids=True)``.

    A sequence has at most ``capacity`` tokens, so each group is small. doc_ids must be unique.
    """
    placed = packed.select("doc_id", "piece", "sequence_id", "offset")
    joined = cut_with_ids.join(placed, ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.aggregate(
        parts, F.lit(b""), lambda whole, x: F.concat(whole, x["ids"])).alias("ids"))
