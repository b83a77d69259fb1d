import hashlib
import random
import zlib

import pytest

from planloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, top string"


def brute(rows):
    original = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            original.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [t[2:] for t in sorted(x, key=lambda t: t[:2])] for c, x in original.items()}
    rebuilt = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(original.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
        leaves[p] = leaves.get(p, 0) + (p not in children)
        saved[p] = saved.get(p, 0) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        if p:
            leaves[p[:-1]] = leaves.get(p[:-1], 0) + leaves[p]
            saved[p[:-1]] = saved.get(p[:-1], 0) + saved[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def result(spark, rows, **more):
    messages = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(5)
    return sorted(repr(tuple(r)) for r in prefix_trie.trie(messages, **more).collect())


def conversations(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.randrange(1, most)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None])))
    return rows


@pytest.mark.parametrize("component", [1, 5, 20_000])
def test_equals_brute_force(spark, component):
    rows = conversations(1, 60, 12)
    assert result(spark, rows, component=component) == brute(rows)


def test_one_long_conversation_and_many_copies(spark):
    # a third of the rows are one path, another third are copies of one conversation
    rows = [(7, t, "user", str(t % 5)) for t in range(300)] + [(8, t, "user", str(t % 5)) for t in range(200)]
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(5)]
    rows += [(c + 2000, *x) for c, *x in conversations(2, 30, 8)]
    want = brute(rows)
    assert result(spark, rows, component=40) == want
    assert result(spark, rows) == want


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (3, None, None, None), (3, 1, "user", "x"), (4, -1, "user", "y"), (4, 2, "user", ""),
            (11, 1, "user", "only"), (12, 5, "us", "er"), (12, 6, "use", "r"), (13, 5, "us", "er"), (13, 6, "user", ""),
            (20, 0, "user", "long " * 30_000), (-7, 1, "user", "negative")]
    assert result(spark, rows) == brute(rows)
    again = [(5, 1, "user", "twice")] * 400 + [(5, 2, "user", "z")]
    assert result(spark, again) == brute(again)


def test_ties_have_an_order(spark):
    rows = [(15, 1, "user", x) for x in "abcd"] + [(25, 1, "user", x) for x in "dcba"]
    got = result(spark, rows)
    assert got == result(spark, rows[::-1])


def test_empty_table(spark):
    assert result(spark, []) == []
