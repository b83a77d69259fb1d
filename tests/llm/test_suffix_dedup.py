import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from planloom.llm import suffix_dedup, suffixes

SCHEMA = "doc_id long, text string, first int, bytes string"


@settings(deadline=None, max_examples=150)
@given(st.binary(max_size=120), st.integers(1, 40), st.integers(1, 6))
def test_suffix_array_and_common_prefixes(data, depth, letters):
    data = bytes(b % letters for b in data)
    array = np.frombuffer(data, np.uint8)
    order = suffixes.suffix_array(array, depth)
    assert sorted(order.tolist()) == list(range(len(data)))
    heads = [data[i:i + depth] for i in order]
    assert heads == sorted(heads)
    prefix = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = [0] * min(1, len(order)) + [min(prefix(data[i:], data[j:]), depth) for i, j in zip(order, order[1:])]
    assert suffixes.common_prefixes(array, order, depth).tolist() == want


@settings(deadline=None, max_examples=100)
@given(st.binary(max_size=150), st.integers(1, 3))
def test_equal_windows_have_equal_anchors(data, letters):
    data = bytes(b % letters for b in data)
    for window, gram in ((12, 5), (20, 20), (7, 1)):
        anchor, place, first, last = suffixes.anchors(np.frombuffer(data, np.uint8), window, gram)
        starts = [s for a, b in zip(first.tolist(), last.tolist()) for s in range(a, b + 1)]
        assert starts == list(range(max(0, len(data) - window + 1)))
        found = {}
        for h, p, a, b in zip(anchor.tolist(), place.tolist(), first.tolist(), last.tolist()):
            for s in range(a, b + 1):
                assert s <= p <= s + window - gram
                assert found.setdefault(data[s:s + window], (h, p - s)) == (h, p - s)


def brute(texts, window):
    """(n_removed, n_spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if count[d[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(8, 40)) for _ in range(6)]
    texts = [None, "", "short", "a" * 39, "b" * 40, "c" * 41, "d" * 500, "xy" * 300, "\x00" * 90]
    for _ in range(60):
        parts = [prose(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng.randint(0, 10))]
        texts.append("".join(parts))
    texts += [texts[20]] * 3 + [texts[21][:-3] + "!" + texts[21][-3:], texts[22] * 2]
    texts += [prose(3) + passages[0] + prose(4) for _ in range(40)]
    return texts


@pytest.mark.parametrize("block,shard", [(1_500_000, 2000), (600, 3)])
def test_equals_brute_force(spark, monkeypatch, block, shard):
    texts = corpus()
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rows = [(None if i in (15, 30) else i, t, 1, "x") for i, t in enumerate(texts)]
    rows += [rows[25], rows[25]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = suffix_dedup.dedup(docs, 40, 16, shard)
    assert found.columns == [*docs.columns, "_spans", "_kept"]
    got = [(r.doc_id, r.text, sum(s.end - s.start for s in r._spans or []), len(r._spans or []), bytes(r._kept)) for r in found.collect()]
    want = [(d, t, *x) for (d, t, *_), x in zip(rows, brute([r[1] for r in rows], 40))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(x[2] for x in want) > 2000


def test_empty(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clashing_names(spark):
    rows = [(1, "abcdefgh" * 3, 7), (2, "xx" + "abcdefgh" * 3, 8), (None, "q", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc_id int")
    docs = docs.withColumn("row", docs.doc_id).withColumn("place", docs.text).withColumn("_found", docs.doc_id)
    out = suffix_dedup.dedup(docs, window=20, gram=6).drop("_spans", "_kept")
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))


def test_hot_anchor_rows_stay_in_proportion(spark, monkeypatch):
    """A passage in 200 documents with different neighbours: equal to brute force, a few blocks for each context."""
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, near = prose(90), prose(120)
    texts = [prose(rng.randint(20, 60)) + passage + prose(rng.randint(20, 60)) for _ in range(200)]
    for _ in range(150):
        at = rng.randrange(len(near))
        texts.append(near[:at] + rng.choice("abcdefgh") + near[at + 1:])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    made = []
    blocks = suffix_dedup._blocks
    monkeypatch.setattr(suffix_dedup, "_blocks", lambda rows, *a: made.append((rows.count(), blocks(rows, *a).count())) or blocks(rows, *a))
    got = {r.doc_id: bytes(r._kept) for r in suffix_dedup.dedup(docs, 40, 16, 10).collect()}
    assert [got[i] for i in range(len(texts))] == [x[2] for x in brute(texts, 40)]
    assert len(made) > 1 and all(out <= 4 * rows for rows, out in made)
    assert made[-1][1] <= 2 * made[0][1]
