import math
import random

import pytest
from pyspark.sql import functions as F

from planloom.llm import exact_topk as tk

SCHEMA = "vec_id long, embedding array<double>, v long, id string"


def brute(rows, k, every):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [min(max(math.floor(256 * x), -2**63), 2**63 - 1) for x in v]
        if i not in vectors or whole < vectors[i]:
            vectors[i] = whole
    out = set()
    for q in vectors:
        if q % every:
            continue
        scores = sorted((-min(max(sum(a * b for a, b in zip(vectors[q], v)), -2**63), 2**63 - 1), i)
                        for i, v in vectors.items() if i != q)
        out |= {(q, rank, i, -score) for rank, (score, i) in enumerate(scores[:k], 1)}
    return out


def result(spark, rows, k=5, every=5, **more):
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    found = tk.search(vectors, F.col("id") % every == 0, k, **more).collect()
    made = {(r.query_id, r.rank, r.vec_id, r.score) for r in found}
    assert len(made) == len(found)
    return made


def random_rows(n, d, seed, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, scale) for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize("block", [7, 50, 8192])
def test_equals_brute_force(spark, block):
    rows = random_rows(150, 10, 1)
    same = [0.5] * 10
    rows += [(1000 + i, same) for i in range(60)]  # a third of the rows, one vector
    assert result(spark, rows, block=block) == brute(rows, 5, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, None), (10, []), (15, [None, 1.0]), (20, [nan]), (25, [inf, 1.0]), (30, [-1.0]), (None, [1.0, 1.0]),
            (1, [0.001, -0.001]), (2, [1.0, 2.0, 3.0]), (2, [0.0, 9.0]), (2, [1.0, 2.0, 3.0]), (35, [1.0, 2.0]), (35, [1.0, 2.0])]
    for k in (1, 3, 50):
        assert result(spark, rows, k) == brute(rows, k, 5)


@pytest.mark.parametrize("scale", [1e6, 1e8, 1e30])
def test_large_components(spark, scale):
    rows = random_rows(40, 6, 2, scale)
    assert result(spark, rows) == brute(rows, 5, 5)


def test_few_or_no_rows(spark):
    assert result(spark, []) == set()
    assert result(spark, [(0, [1.0])]) == set()
    assert result(spark, [(1, [1.0]), (2, [1.0])]) == set()
    assert result(spark, [(0, [1.0]), (2, [1.0])]) == {(0, 1, 2, 65536)}
