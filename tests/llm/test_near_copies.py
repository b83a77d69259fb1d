import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from planloom.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    a, b = shingles(a), shingles(b)
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    """doc_ids of the smallest document of each group, by comparing all pairs."""
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, s), (b, t) in itertools.combinations(rows, 2):
        if near(s, t):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted({find(d) for d in root})


def edited(rng, words, n):
    copy = list(words)
    for _ in range(n):
        copy[rng.randrange(len(copy))] = f"x{rng.random()}"
    return copy


def texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    made = [None, "", " \n", "one", "One", "one two"]
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(60, 200))
        made += [" ".join(edited(rng, base, rng.randint(0, 6))) for _ in range(rng.choice([1, 2, 4]))]
    passage = rng.choices(vocabulary, k=60)
    made += [" ".join(passage + rng.choices(vocabulary, k=50)) for _ in range(30)]
    base = rng.choices(vocabulary, k=150)
    made += [" ".join(edited(rng, base, rng.randint(0, 2))) for _ in range(40)]
    rng.shuffle(made)
    return list(enumerate(made))


def test_stage_links_copies_with_a_few_edits(spark):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA).repartition(4)
    kept = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    want = brute(rows)
    assert sorted(r.doc_id for r in kept.collect()) == want
    exact = len({frozenset(shingles(t)) for _, t in rows})
    assert len(want) < exact - 40


def test_long_text_is_taken_in_blocks(monkeypatch):
    hashes = near_copies.hashes_of(" ".join(f"w{i % 977} v{i % 13}" for i in range(3000)))
    whole, bits = near_copies.minima_of(hashes).tolist(), near_copies.fingerprint_of(hashes)
    monkeypatch.setattr(near_copies, "_BLOCK", 64)
    assert near_copies.minima_of(hashes).tolist() == whole and near_copies.fingerprint_of(hashes) == bits
    assert len(near_copies.bands_of(near_copies.minima_of(hashes))) == near_copies.BANDS


def test_common_members_are_counted_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 200, rng.integers(1, 90))) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for columns in (7, 64, 4096):
        monkeypatch.setattr(near_copies, "_COLUMNS", columns)
        assert near_copies._common(sets).tolist() == want


@pytest.mark.parametrize("edits", [5])
def test_one_large_group_of_near_copies(spark, edits):
    # most pairs of the group are below the threshold, so each copy has few partners among many alike
    rng = random.Random(edits)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(d, " ".join(edited(rng, base, edits))) for d in range(400)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    kept, want = near_copies.keep_one(docs).count(), len(brute(rows))
    assert kept >= want and 400 - kept >= 0.9 * (400 - want)


def test_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "WHOLE", 12)
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = [(d, " ".join(edited(rng, base, 1))) for d in range(40)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    assert [r.doc_id for r in near_copies.keep_one(docs).collect()] == brute(rows)


def test_split_buckets_are_compared_in_full(spark, monkeypatch):
    # parts of one node each, so that the rounds find no link at all
    monkeypatch.setattr(near_copies, "WHOLE", 16)
    monkeypatch.setattr(near_copies, "_parted", lambda buckets, sets, turn: buckets.withColumn(
        "key", F.xxhash64("key", "node")).withColumn("split", F.lit(True)))
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(d, " ".join(edited(rng, base, 4))) for d in range(80)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    want = brute(rows)
    assert len(want) < 75 and sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == want


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "WHOLE", 6)
    rows = [("k", n, 0 if n < 20 else n) for n in range(31)]
    met = near_copies._blocks(spark.createDataFrame(rows, "key string, node long, root long"))
    seen, largest = set(), 0
    for group in met.groupBy("key", "one", "other").agg(F.collect_list("node").alias("nodes")).collect():
        largest = max(largest, len(group.nodes))
        seen.update(itertools.combinations(sorted(group.nodes), 2))
    assert largest < 20 and all((a, b) in seen for a, b in itertools.combinations(range(31), 2) if b >= 20)


def test_clashing_names(spark):
    rows = [(1, "a b c d e f g", 5), (2, "a b c d e f g", 6), (3, "x y z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc_id long")
    docs = docs.withColumn("_key", docs.text).withColumn("row", docs.doc_id).withColumn("at", docs.doc_id)
    want = sorted(docs.where("doc_id <> 2").collect())
    assert sorted(near_copies.keep_one(docs).collect()) == want
    assert sorted(simhash.keep_one(docs).collect()) == want


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_copies.keep_one(docs).collect() == []
