import hashlib
import random

import pytest

from planloom.llm import warc
from planloom.llm.shared import make_folder, new_folder, write_file

SCHEMA = "page_id long, url string, html string, payload string"


def pages(spark):
    rng = random.Random(4)
    rows = [(i, f"http://a.example/é {i}", "".join(rng.choices("abc <é\r\n", k=rng.choice([0, 5, 99, 100, 400, 3000, 9000]))), "x")
            for i in range(40)]
    rows += [(100 + i, None, "s" * 2000, "x") for i in range(12)]          # copies, one of them segmented
    rows += [(200 + i, "u", "t" * 99, "x") for i in range(3)]              # too short to be revisited
    rows += [(300, "u", None, "x"), (301, "u", "", "x"), (None, "u", "s" * 2000, "x"), (None, "u", "n" * 700, "x")]
    rows += [(105, None, "s" * 2000, "x"), (100, None, "s" * 2000, "x")]   # repeated rows
    rows += [(7, "u", "another text " * 60, "x")]                          # page_id with two texts
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def expected(rows):
    first = {}
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        if len(payload) >= 100 and page_id is not None:
            first[payload] = min(page_id, first.get(payload, page_id))
    out = []
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        revisit = page_id is not None and page_id > first.get(payload, page_id)
        out.append((page_id, payload, hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response",
                    first[payload] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment,archive", [(700, 4000), (100, 300), (10 ** 6, 10 ** 7)])
def test_round_trip(spark, segment, archive):
    rows, df = pages(spark)
    folder, files = warc.write(df, segment_bytes=segment, archive_bytes=archive)
    got = warc.read(spark, folder).collect()
    assert sorted([(r.page_id, bytes(r.payload), r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == expected(rows)
    assert all(r.problem is None and r.payload_bytes == len(r.payload) for r in got)
    if segment < 1000:
        assert files.count() > 4


def test_empty_table(spark):
    folder, files = warc.write(pages(spark)[1].limit(0))
    assert files.count() == 0 and warc.read(spark, folder).collect() == []


def test_broken_archives_are_reported(spark):
    digest = hashlib.sha256(b"q" * 5000).hexdigest()
    parts = list(warc.records_of(1, "u", b"q" * 5000, digest, None, 0, 1000))
    cases = {
        "a segment is missing or comes twice": parts[:2] + parts[3:],
        "the total length is not the stated one": parts[:-1],
        "the payload's digest is not the stated one": list(warc.records_of(2, "u", b"q", digest, None, 0, 1000)),
        "no response with the stated digest": list(warc.records_of(4, "u", b"", digest, 3, 0, 1000)),
    }
    for problem, made in cases.items():
        folder = make_folder(new_folder(spark, "broken"))
        write_file(folder, "a.warc.gz", made[::-1])
        (row,) = warc.read(spark, folder).collect()
        assert row.problem == problem and row.payload is None


def test_framing():
    for payload in (b"", b"a", b"\r\n" * 50, bytes(range(256)) * 99):
        for size in (1, 7, 4096):
            assert warc.unchunked(warc.chunked(payload, size)) == payload
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")
