import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from planloom.llm import decontaminate

SCHEMA = "doc_id long, text string, item_id string, w string"


def plain_tiles(item, text, least):
    """Greedy tiling by looking at all pairs of places each time."""
    item_free, text_free, done = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while (i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and text[j + n] is not None
                       and item_free[i + n] and text_free[j + n]):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return done
        done.append(best)
        for x in range(n):
            item_free[i + x] = text_free[j + x] = False


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(1, 4), max_size=30), st.lists(st.one_of(st.none(), st.integers(1, 4)), max_size=40), st.integers(2, 4))
def test_tiles_equal_plain_search(item, text, least):
    assert decontaminate.tiles(item, text, least) == plain_tiles(item, text, least)


def tokens(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())


def brute(docs, items):
    found = set()
    for doc_id, text in docs:
        for item_id, passage in items:
            item = tokens(passage)
            numbers = {w: n for n, w in enumerate(dict.fromkeys(item + tokens(text)), 1)}
            n = sum(x[0] for x in plain_tiles([numbers[w] for w in item], [numbers[w] for w in tokens(text)], 5))
            if len(item) >= 5 and n >= 0.5 * len(item):
                found.add((doc_id, item_id, len(item), n))
    return found


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ß2"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 30)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "one two three four"), (103, items[0][1])]
    docs = [(900, None), (901, "")]
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 50))
        passage = rng.choice(items[:25])[1].split()
        kind = rng.randrange(5)
        if kind == 1:
            words[3:3] = [w.upper() + "," for w in passage]
        if kind == 2:
            half = len(passage) // 2
            words = passage[half:] + words + passage[:half]
        if kind == 3:
            words[1:1] = passage[:len(passage) // 3]
        docs.append((i, " ".join(words)))
    docs += [docs[7], (None, items[3][1])]
    frame = spark.createDataFrame([(*d, "clash", "x") for d in docs], SCHEMA)
    bench = spark.createDataFrame([(*b, 1) for b in items], "item_id long, text string, doc_id int")
    got = decontaminate.leaks(frame, bench).collect()
    assert len(got) == len(set(got))
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id, r.n_words, r.n_covered) for r in got} == want and len(want) >= 15
    leaked = {d for d, *_ in want}
    kept = decontaminate.keep_clean(frame, bench)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _ in docs if d not in leaked)
    assert kept.columns == frame.columns
    assert decontaminate.leaks(frame, bench.limit(0)).collect() == []
    assert decontaminate.leaks(frame.limit(0), bench).collect() == []


def test_repeated_words_end_soon():
    # a phrase that repeats itself on both sides makes no product of places
    assert decontaminate.tiles([1] * 1000, [1] * 100_000, 5) == [(1000, 0, 0)]
    found = decontaminate.tiles([1, 2] * 400 + [3] * 5, [2, 1] * 20_000, 5)
    assert found == [(800, 0, 1)]


def test_long_repetitive_text(spark):
    docs = spark.createDataFrame([(1, "again " * 100_000), (2, "again " * 3), (3, "some thing else is said here")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "again " * 1000), (8, "again " * 7 + "some thing else is said")], "item_id long, text string")
    got = {(r.item_id, r.n_words, r.n_covered, r.n_tiles) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(7, 1000, 1000, 1), (8, 12, 7, 1)}


def test_join_without_broadcast(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i + j}" for j in range(20))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(rows[::3], "item_id long, text string")
    read = lambda: sorted(tuple(r) for r in decontaminate.leaks(docs, bench).collect())
    want = read()
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 1)
    assert read() == want and {(r[0], r[2]) for r in want} >= {(i, i) for i in range(0, 40, 3)}


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3)], "doc_id long, text string, _doc_id long, _key int, row int")
    bench = spark.createDataFrame([(7, "a b c d e f g"), (None, "v w x y z")], "item_id long, text string")
    assert decontaminate.keep_clean(docs, bench).collect() == []
    assert decontaminate.keep_clean(docs, bench.where("item_id IS NULL")).collect() == docs.collect()
