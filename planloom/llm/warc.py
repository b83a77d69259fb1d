"""WARC archives: writing with segments and revisits, reading by segment reassembly (operator 10).

Writing. Of rows with equal payloads of at least LEAST_REVISIT bytes, those with the smallest
page_id are responses; the others are revisits, which name the response they refer to and carry
no payload. A response's block is an HTTP answer with chunked framing. A block longer than
SEGMENT_BYTES is cut: the first segment stays in the response record, the others follow as
continuation records with the identifier of the first and a segment number, and the last one
states the total length. Records are gzip members of their own; a task starts a new archive when
one has ARCHIVE_BYTES, so segments of one record can lie in several archives.

Reading. Records of all archives are grouped by origin identifier (their own where they are not
segmented), ordered by segment number, checked for gaps and total length, and joined; then the chunked
framing is undone. Unsegmented payloads are decoded where they are read, so only those that were
cut are shuffled. What fails a check comes out with a ``problem`` and no payload.

Defined results: a null html is empty; a null page_id is always a response; rows with equal page_id and
payload are all responses or all revisits; an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm.shared import make_folder, new_folder, write_file
from planloom.session import cut_lineage

LEAST_REVISIT = 100
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
ARCHIVE_BYTES = 8_000_000
#: Every record of a written archive has this date, so that a task that runs again writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

_RECORD = ("origin_id string, segment long, total long, record_type string, page_id long, url string, refers_to string, "
           "stated_digest string, block binary, payload binary, payload_bytes long, payload_digest string, problem string")


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    """Identifier that follows from the row, so that revisits know that of their response."""
    seed = hashlib.sha256(f"{page_id} {digest} {copy}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=seed[:16], version=4)}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Undo chunked framing; chunk extensions and trailers are read over."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk without its end")
        parts.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP answer, without its framing."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP head")
    fields = [line.partition(b":") for line in head.lower().split(b"\r\n")[1:]]
    framing = [value.strip() for name, _, value in fields if name.strip() == b"transfer-encoding"]
    return unchunked(body) if framing and framing[-1].endswith(b"chunked") else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One gzip member with a WARC record; fields without value are left out."""
    lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in fields if value is not None],
             f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None,
               copy: int, segment_bytes: int) -> Iterator[bytes]:
    """The records of one row; ``first``: the page_id of the response that it revisits."""
    own = record_id(page_id, digest, copy)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url and urllib.parse.quote(url, safe="/:?#[]@!$&'()*+,;=%~")),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page_id),
              ("Content-Type", "application/http; msgtype=response")]
    if first is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", PROFILE),
                      ("WARC-Refers-To", record_id(first, digest)), *common], HTTP_HEAD)
        return
    block = HTTP_HEAD + chunked(payload)
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    cut = len(parts) > 1
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own),
                  ("WARC-Segment-Number", 1 if cut else None), *common], parts[0])
    for number, part in enumerate(parts[1:], 2):
        last = len(block) if number == len(parts) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, digest, copy)[:-1] + f"-{number}>"),
                      ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number),
                      ("WARC-Segment-Total-Length", last), ("WARC-Date", DATE)], part)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a gzipped or plain archive."""
    if content[:2] == b"\x1f\x8b":
        parts, rest = [], content
        while rest:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(rest))
            rest = member.unused_data
        content = b"".join(parts)
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record where one should begin")
        fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        start, size = end + 4, int(fields["content-length"])
        yield fields, content[start:start + size]
        at = start + size + 4


def with_roles(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest and first, the response to refer to (null: a response).

    Digests are counted before any join; only page_ids and digests are shuffled by digest, and payloads by
    page_id and digest, so copies of one payload do not meet in one task.
    """
    # an empty html is an empty payload; 'binary' is its UTF-8
    shaped = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    shaped = shaped.withColumn("digest", F.sha2("payload", 256))
    keys = cut_lineage(shaped.where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "digest").distinct())
    firsts = cut_lineage(keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("page_id").alias("n"))
                         .where("n > 1").drop("n"))
    revisits = keys.join(firsts, "digest").where("page_id > first").select(
        F.col("page_id").alias("_page_id"), F.col("digest").alias("_digest"), "first")
    same = (F.col("page_id") == F.col("_page_id")) & (F.col("digest") == F.col("_digest"))
    # dealt out by the keys of the join, so that repeated rows meet and can be told apart by a number
    return shaped.repartition("page_id", "digest").join(revisits, same, "left").drop("_page_id", "_digest")


def write(pages: DataFrame, folder: str | None = None, segment_bytes: int = SEGMENT_BYTES,
          archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Write ``pages``; the folder's URI and (file, n_records) of each archive."""
    folder = make_folder(folder or new_folder(pages.sparkSession, "warc"))

    def write_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, size, held, last, copy = TaskContext.get().partitionId(), 0, 0, [], None, 0

        def flush() -> pd.DataFrame:
            nonlocal number, size, held
            name = f"{part:08d}-{number:08d}.warc.gz"
            write_file(folder, name, held)
            row = pd.DataFrame({"file": [name], "n_records": [len(held)]})
            number, size, held = number + 1, 0, []
            return row

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*[batch[c].tolist() for c in (
                    "page_id", "url", "payload", "digest", "first")]):
                page_id, first = (int(x) if x is not None else None for x in (page_id, first))
                copy = copy + 1 if (page_id, digest) == last else 0
                last = (page_id, digest)
                for made in records_of(page_id, url, bytes(payload), digest, first, copy, segment_bytes):
                    if held and size + len(made) > archive_bytes:
                        yield flush()
                    held.append(made)
                    size += len(made)
        if held:
            yield flush()

    # numbers as text: a null must not turn a batch's integers into floating point
    rows = with_roles(pages).sortWithinPartitions("page_id", "digest", "url").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest",
        F.col("first").cast("string").alias("first"))
    return folder, cut_lineage(rows.mapInPandas(write_partition, "file string, n_records long"))


def _decoded(block: bytes, stated: str | None) -> tuple[bytes | None, int | None, str | None, str | None]:
    """payload, its length and digest, and what is wrong with it."""
    try:
        payload = payload_of(block)
    except ValueError as exc:
        return None, None, None, str(exc)
    digest = hashlib.sha256(payload).hexdigest()
    if stated and stated != digest:
        return None, None, None, "the payload's digest is not the stated one"
    return payload, len(payload), digest, None


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def records(spark: SparkSession, folder: str, with_payload: bool) -> DataFrame:
    """All records of a folder's archives; those that need no other record are decoded."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        whole_number = {"segment": "Int64", "total": "Int64", "page_id": "Int64", "payload_bytes": "Int64"}
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for fields, block in parse(content):
                    kind = fields["warc-type"]
                    stated = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    cut = "warc-segment-number" in fields
                    payload = size = digest = problem = None
                    if kind == "response" and not cut:
                        payload, size, digest, problem = _decoded(block, stated)
                    rows.append((
                        fields.get("warc-segment-origin-id", fields["warc-record-id"]),
                        int(fields.get("warc-segment-number", 1)), _number(fields.get("warc-segment-total-length")),
                        kind, _number(fields.get("x-page-id")), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
                        stated, block if cut else None, payload if with_payload else None, size, digest, problem))
                yield pd.DataFrame(rows, columns=names).astype(whole_number)

    return spark.read.format("binaryFile").load(folder).select("content").mapInPandas(read, _RECORD)


def reassembled(found: DataFrame, with_payload: bool) -> DataFrame:
    """One row for each origin identifier, from ``records``: its segments in order, checked and decoded.

    A group holds the segments of one payload, in one row of the result.
    """
    segment = F.struct("segment", "total", "block")
    first = lambda c: F.min_by(c, F.when(F.col("record_type") != "continuation", F.col("segment"))).alias(c)
    kept = ("record_type", "page_id", "url", "refers_to", "stated_digest", "payload", "payload_bytes", "payload_digest", "problem")
    grouped = found.groupBy("origin_id").agg(
        *[first(c) for c in kept],
        F.sort_array(F.collect_list(F.when(F.col("block").isNotNull(), segment))).alias("parts"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = ("payload", "payload_bytes", "payload_digest", "problem")
        for batch in batches:
            values = {c: batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in done}
            for at, (parts, stated) in enumerate(zip(batch["parts"], batch["stated_digest"])):
                if not len(parts):
                    continue
                block = b"".join(p["block"] for p in parts)
                payload = size = digest = problem = None
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                    problem = "a segment is missing or comes twice"
                elif parts[-1]["total"] != len(block):
                    problem = "the total length is not the stated one"
                else:
                    payload, size, digest, problem = _decoded(block, stated)
                for c, value in zip(done, (payload if with_payload else None, size, digest, problem)):
                    values[c][at] = value
            batch = batch.drop(columns="parts").assign(**{c: pd.Series(v, batch.index, object) for c, v in values.items()})
            yield batch.astype({"page_id": "Int64", "payload_bytes": "Int64"})

    return grouped.mapInPandas(join, (
        "origin_id string, record_type string, page_id long, url string, refers_to string, stated_digest string, "
        "payload binary, payload_bytes long, payload_digest string, problem string"))


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, problem) of each captured page.

    refers_to: the page_id of a revisit's response, from which its payload comes as well; a revisit whose
    response is absent or has another digest has a problem.
    """
    pages = cut_lineage(reassembled(records(spark, folder, with_payload), with_payload))
    source = pages.where("record_type = 'response'").select(
        F.col("origin_id").alias("refers_to"), F.col("page_id").alias("r_page_id"), F.col("payload").alias("r_payload"),
        F.col("payload_bytes").alias("r_bytes"), F.col("payload_digest").alias("r_digest"))
    # only revisits are joined: all the others have no response to look for, and would meet under one empty key
    asks = F.coalesce((F.col("record_type") == "revisit") & F.col("refers_to").isNotNull(), F.lit(False))
    joined = pages.where(asks).join(source, "refers_to", "left").unionByName(pages.where(~asks), allowMissingColumns=True)
    revisit = F.col("record_type") == "revisit"
    lost = revisit & ~F.coalesce(F.col("r_digest") == F.col("stated_digest"), F.lit(False))
    return joined.select(
        "page_id", "url", "record_type", F.col("r_page_id").alias("refers_to"),
        F.when(revisit, F.col("r_payload")).otherwise(F.col("payload")).alias("payload"),
        F.when(revisit, F.col("r_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("r_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(lost, F.lit("no response with the stated digest")).otherwise(F.col("problem")).alias("problem"))
