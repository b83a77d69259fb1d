import itertools
import random
import re

import pytest
import xxhash

from planloom.llm import simhash

SCHEMA = "doc_id long, text string, source string, root long"


def brute(rows):
    """{doc_id: (fingerprint, component)} by comparing all pairs."""
    prints = {}
    for doc_id, text in rows:
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (f"{prints[d]:016x}", find(d)) for d in prints}


def texts(n):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgéß", k=rng.randint(1, 6))) for _ in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "A b C d"), (7, "a\x0bb c\rd")]
    while len(rows) < n:
        base = rng.choices(vocabulary, k=rng.randint(1, 400))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_components_equal_brute_force(spark):
    rows = texts(400)
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    got = {r.doc_id: (f"{r.fingerprint & (1 << 64) - 1:016x}", r.component_id) for r in simhash.assign(docs).collect()}
    want = brute(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 40
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for n in (1, 2, 3, 4):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = {frozenset((r.u, r.v)) for r in simhash.links(spark.createDataFrame(signed, "fingerprint long")).collect()}
    want = {frozenset((a, b)) for (a,), (b,) in itertools.combinations(signed, 2)
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame(signed, "fingerprint long"), 4)


def test_repeated_null_and_empty(spark):
    rows = [(None, "x y z", "a", 1), (None, "x y z", "a", 1), (7, "p q r s", "a", 2), (7, "p q r s", "b", 2), (8, None, "c", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = simhash.assign(docs).collect()
    assert len(got) == 5 and sorted(str(r.component_id) for r in got) == ["7", "7", "8", "None", "None"]
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect()) == ["7", "8", "None"]
    assert simhash.assign(docs.limit(0)).collect() == []
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_long_text_is_counted_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint_of(text)
    monkeypatch.setattr(simhash, "_BLOCK", 64)
    assert simhash.fingerprint_of(text) == whole
