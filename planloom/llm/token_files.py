"""Token ids in binary files (operator 2).

Documents are range-partitioned and sorted by doc_id, tokenised, and written in that order.
A file holds at most MOST_TOKENS ids (or one longer document) and describes itself:

    magic, number of documents, tokens, ids in use and data bytes   little-endian, 8 bytes each
    ids in use by falling frequency (rank table)                    4 bytes each
    doc_ids                                                         8 bytes each
    1 where doc_id is null                                          1 byte each
    tokens of each document                                         8 bytes each
    control bytes                                                   1 byte for 4 tokens
    data bytes                                                      1 to 4 for a token

A token is stored as its rank among the ids of its file, in as few bytes as the rank needs; two
bits of its control byte give their number less one. The ranks count every token of the file.
Reading looks all four lengths of a control byte up in a table and gathers the data by position.

File names ascend with doc_id: the number of the range partition, then of the file in it.

Defined results: a null text is empty and a document without tokens has the end id alone (nothing where
there is no end id); null doc_ids come first; rows of equal doc_id are in the order of their texts;
an empty table writes no file. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planloom.llm.shared import make_folder, new_folder, write_file
from planloom.llm.tokens import encoder, ids_bytes
from planloom.session import cut_lineage, join_small

MAGIC = 0x314B4F544D4F4F4C
MOST_TOKENS = 2_000_000

#: Byte lengths of the four values of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids in use, the place of each token's id among them, and how often each is used."""
    if len(ids) and ids.max() < 1 << 22:  # a table over all ids is small
        table = np.bincount(ids)
        used = np.flatnonzero(table)
        place = np.zeros(len(table), np.uint32)
        place[used] = np.arange(len(used), dtype=np.uint32)
        return used.astype(np.uint32), place[ids], table[used]
    return np.unique(ids, return_inverse=True, return_counts=True)


def pack(doc_ids: list[int | None], documents: list[np.ndarray]) -> list[bytes]:
    """The parts of a file (see the module's docstring); documents: arrays of unsigned 32-bit ids."""
    ids = np.concatenate([*documents, np.zeros(0, np.uint32)]).astype(np.uint32)
    used, where, counts = _counted(ids)
    by_count = np.argsort(-counts, kind="stable")
    rank_of = np.empty(len(used), np.uint32)
    rank_of[by_count] = np.arange(len(used), dtype=np.uint32)
    ranks = rank_of[where]
    extra = ((ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    quads = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    quads[:len(ids)] = extra
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    lengths = extra.astype(np.int64) + 1
    starts = np.cumsum(lengths) - lengths
    data = np.zeros(int(lengths.sum()), np.uint8)
    for byte in range(4):
        longer = extra >= byte
        data[starts[longer] + byte] = (ranks[longer] >> np.uint32(8 * byte)).astype(np.uint8)
    head = np.array([MAGIC, len(documents), len(ids), len(used), len(data)], "<u8")
    return [head.tobytes(), used[by_count].astype("<u4").tobytes(),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([len(d) for d in documents], "<u8").tobytes(), control.tobytes(), data.tobytes()]


def unpack(content: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """doc_ids and documents of a file's content."""
    magic, n_docs, n_tokens, n_used, n_data = map(int, np.frombuffer(content, "<u8", 5))
    at = 40
    if magic != MAGIC:
        raise ValueError("not a token file")

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(content, kind, n, at)
        at += found.nbytes
        return found

    used, doc_ids, no_id = take("<u4", n_used), take("<i8", n_docs), take("u1", n_docs)
    sizes, control = take("<u8", n_docs).astype(np.int64), take("u1", -(-n_tokens // 4))
    data = np.concatenate([take("u1", n_data), np.zeros(3, np.uint8)])
    if at != len(content):
        raise ValueError("a token file of another length than its head says")
    lengths = LENGTHS[control].ravel()[:n_tokens]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = data[starts].astype(np.uint32)
    for byte in range(1, 4):
        longer = np.flatnonzero(lengths > byte)
        ranks[longer] |= data[starts[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    documents = np.split(used[ranks], np.cumsum(sizes)[:-1]) if n_docs else []
    return [None if none else int(d) for d, none in zip(doc_ids, no_id)], documents


def write(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str | None = None) -> tuple[str, DataFrame]:
    """Tokenise and write ``docs``; the folder's URI and (file, n_docs, n_tokens) of each file.

    The number of partitions is the session's ``spark.sql.shuffle.partitions``.
    """
    spark = docs.sparkSession
    folder = make_folder(folder or new_folder(spark, "tokens"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ending = b"" if end_id is None else ids_bytes([end_id])

    def write_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_each, part = encoder(tokenizer).encode_each, TaskContext.get().partitionId()
        doc_ids, documents, held, number = [], [], 0, 0

        def flush() -> pd.DataFrame:
            nonlocal doc_ids, documents, held, number
            name = f"{part:08d}-{number:08d}.tok"
            write_file(folder, name, pack(doc_ids, documents))
            row = pd.DataFrame({"file": [name], "n_docs": [len(documents)], "n_tokens": [held]})
            doc_ids, documents, held, number = [], [], 0, number + 1
            return row

        for batch in batches:
            encoded = encode_each(batch["text"])
            for doc_id, no_id, ids in zip(batch["doc_id"].tolist(), batch["no_id"].tolist(), encoded):
                ids = np.frombuffer(ids + ending, "<u4")
                if documents and held + len(ids) > MOST_TOKENS:
                    yield flush()
                doc_ids.append(None if no_id else doc_id)
                documents.append(ids)
                held += len(ids)
        if documents:
            yield flush()

    sorted_docs = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
                   .repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
                   .select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text"))
    return folder, cut_lineage(sorted_docs.mapInPandas(write_partition, "file string, n_docs long, n_tokens long"))


def read(spark: SparkSession, folder: str, files: DataFrame, value: Callable[[np.ndarray], object] = np.ndarray.tobytes,
         value_type: str = "binary") -> DataFrame:
    """(doc_id, start, n_tokens, value) of every document in a folder of token files.

    ``files`` is what ``write`` returned; start counts the ids of all documents before it; value is
    computed from a document's ids where the file is decoded (without it: their bytes). Offsets come
    from a running sum over one row for each file of up to MOST_TOKENS ids.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("file_start")))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                doc_ids, found = unpack(content)
                sizes = np.array([len(d) for d in found], np.int64)
                yield pd.DataFrame({
                    "file": posixpath.basename(path), "doc_id": pd.array(doc_ids, "Int64"),
                    "in_file": np.cumsum(sizes) - sizes, "n_tokens": sizes, "value": [value(d) for d in found]})

    content = spark.read.format("binaryFile").load(folder).select("path", "content")
    rows = content.mapInPandas(
        documents, f"file string, doc_id long, in_file long, n_tokens long, value {value_type}")
    return join_small(rows, starts, "file").select(
        "doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "value")


def crc32(ids: np.ndarray) -> int:
    """Checksum of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
