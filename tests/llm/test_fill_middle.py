import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planloom.llm import fill_middle as fm

UNITS = {"words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "lines": r"[^\n]*\n|[^\n]+"}


def brute(doc_id, text, unit, seed=42, rate=50, spm_rate=80):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or doc_id is None or any(m in text for m in fm.MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(5)
    odd = ["", None, " ", "\n\n", "a", " a", "a ", "é", "日本 語 x ", "<P>", "a <S> b", "x<M", "\x0b\x0c", "🙂 🙂🙂\n", "a\x00b c",
           "word " * 30_000, "x" * 200_000, "\n".join("é" * 5 for _ in range(5000))]
    letters = "ab é日🙂 \n\t<P>"
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(400)]


@pytest.mark.parametrize("unit", ["words", "lines"])
def test_forms_equal_brute_force(spark, unit):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b c"), (0, "twice given"), (0, "twice given")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("other")).withColumn("form", F.lit(1))
    made = fm.fill_middle(docs, rate=90, unit=unit)
    made = made.withColumn("back", fm.restored(F.col("fim_text"), F.col("form")))
    got = sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text, r.back) for r in made.collect())))
    want = sorted(map(repr, ((i, *brute(i, t, unit, rate=90), t or "") for i, t in rows)))
    assert got == want


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_chunks_do_not_matter(monkeypatch, kind):
    given = pa.array([t or "" for t in texts()], kind)[3:]
    hashes = pa.array(range(len(given)), pa.int64())
    whole = fm._found(given, hashes, hashes, "words")
    monkeypatch.setattr(fm, "CHUNK_BYTES", 50)
    assert fm._found(given, hashes, hashes, "words").equals(whole)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fm.fill_middle(docs).collect() == []


def test_wavelet_matrix_counts():
    rng = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix = fm.WaveletMatrix(symbols)
        start = rng.integers(0, size + 1, 50)
        end = np.maximum(start, rng.integers(0, size + 1, 50))
        for kind in ((0,), (3, 5), tuple(range(8))):
            want = [np.isin(symbols[a:b], kind).sum() for a, b in zip(start, end, strict=True)]
            assert matrix.count(kind, start, end).tolist() == want
            k = rng.integers(0, 20, 50)
            places = [next((p for p in range(a, b + 1) if np.isin(symbols[a:p], kind).sum() >= x), b)
                      for a, b, x in zip(start, end, k, strict=True)]
            assert matrix.behind(kind, k, start, end).tolist() == places
