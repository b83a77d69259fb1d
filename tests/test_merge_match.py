"""Merge and matching: ported cases, and random cases against a slow loop."""

import random

import pytest

from planloom.operators import match, merge, spatial
from planloom.operators.match import match_one_to_one, missed_text
from planloom.operators.merge import merge_detections
from planloom.operators.ranking import rank_within

DET = "sheet_id long, det_idx long, text string, x0 double, y0 double, x1 double, y1 double, conf double"


def frame(spark, rows, schema=DET):
    return spark.createDataFrame(rows, schema)


def inter(a, b):
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def area(a):
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a, b):
    i = inter(a, b)
    return i / (area(a) + area(b) - i) if i > 0 else 0.0


def cont(a, b):
    i = inter(a, b)
    return i / min(area(a), area(b)) if i > 0 else 0.0


def slow_merge(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], -len(r[2]), r[1])):
        box = r[3:7]
        near = [k for k in kept if iou(box, k[3:7]) > 0.3 or cont(box, k[3:7]) > 0.6]
        if not near:
            kept.append(r)
        elif len(near) == 1 and len(r[2]) > len(near[0][2]):
            k = near[0]
            if r[7] > k[7] - 0.05 or (cont(k[3:7], box) > 0.9 and r[7] >= 0.85):
                kept.remove(k)
                kept.append(r)
    return {(r[0], r[1]) for r in kept}


def slow_match(truth, dets, last=False):
    out = set()
    for sheet in {t[0] for t in truth}:
        pairs = [(iou(t[2:], d[2:]), t[1], d[1]) for t in truth for d in dets
                 if t[0] == d[0] == sheet and iou(t[2:], d[2:]) >= 0.15]
        pairs.sort(reverse=True) if last else pairs.sort(key=lambda p: (-p[0], p[1], p[2]))
        ts, ds = set(), set()
        for _, t, d in pairs:
            if t not in ts and d not in ds:
                ts.add(t)
                ds.add(d)
                out.add((sheet, t, d))
    return out


MERGE_CASES = [
    ([("105", (100, 0, 130, 20), .99), ("2105", (95, 0, 135, 20), .95)], {"2105"}),
    ([("600", (0, 0, 40, 20), .97), ("300", (60, 0, 100, 20), .96), ("600300", (0, 0, 100, 20), .93)],
     {"600", "300"}),
    ([("2900", (0, 0, 40, 20), .99), ("4045", (200, 0, 240, 20), .99), ("Stue", (0, 100, 60, 130), .99)],
     {"2900", "4045", "Stue"}),
    ([("Bad", (0, 0, 60, 30), .999), ("B", (2, 2, 22, 28), .996)], {"Bad"}),
    ([("Vaer. 2", (1136, 1298, 1303, 1349), .949), ("2", (1268, 1301, 1300, 1344), 1.0)], {"Vaer. 2"}),
    ([("2", (10, 0, 30, 20), .99), ("Zgarbled9", (0, 0, 60, 20), .60)], {"2"}),
]


@pytest.mark.parametrize("limit", [2000, 0])
def test_merge_cases(spark, limit):
    rows, want = [], set()
    for sheet, (case, kept) in enumerate(MERGE_CASES):
        for i, (text, box, conf) in enumerate(case):
            rows.append((sheet, i, text, *map(float, box), conf))
        want |= {(sheet, t) for t in kept}
    got = merge_detections(frame(spark, rows), fold_limit=limit).where("kept").collect()
    assert {(r.sheet_id, r.text) for r in got} == want


def random_sheet(rng, sheet, n, span):
    rows = []
    for i in range(n):
        x, y = rng.randrange(span), rng.randrange(span)
        w, h = rng.choice([8, 12, 20, 40]), rng.choice([6, 10, 18])
        rows.append((sheet, i, "x" * rng.randrange(1, 6), float(x), float(y), float(x + w),
                     float(y + h), rng.choice([.7, .8, .86, .9, .93, .96, .99])))
    return rows


def test_merge_random_fold_and_rounds_agree_with_loop(spark):
    rng = random.Random(7)
    rows = []
    for sheet in range(30):
        rows += random_sheet(rng, sheet, rng.randrange(1, 25), rng.choice([20, 60, 200]))
    # copies of one box hold a third of the rows
    rows += [(99, i, "x" * (1 + i % 4), 5., 5., 25., 15., .9 + (i % 5) / 100) for i in range(150)]
    want = set()
    for sheet in {r[0] for r in rows}:
        want |= slow_merge([r for r in rows if r[0] == sheet])
    df = frame(spark, rows)
    for kw in ({}, {"fold_limit": 10, "cell": 16.0}):
        out = merge_detections(df, **kw)
        assert out.count() == len(rows)
        assert {(r.sheet_id, r.det_idx) for r in out.where("kept").collect()} == want


def test_boxes_of_all_sizes_meet(spark):
    rng = random.Random(23)
    def boxes(n):
        out = []
        for i in range(n):
            w, h = (10 ** rng.uniform(0, 6) for _ in "wh")
            x, y = rng.uniform(-1e5, 1e5) / rng.choice([1, 100]), rng.uniform(-1e5, 1e5) / rng.choice([1, 100])
            out.append((i % 3, i, x, y, x + w, y + h))
        return out + [(0, n, -1e12, 0., 1e12, 1.), (1, n + 1, 128., 128., 256., 256.), (1, n + 2, 256., 128., 256., 300.)]
    left, right = boxes(120), boxes(130)
    bad = [(0, 900, float("nan"), 0., 1., 1.), (0, 901, 0., 0., float("inf"), 1.), (0, 902, None, 0., 1., 1.)]
    a = spark.createDataFrame(left + bad, "s int, a int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame(right + bad, "s int, b int, r0 double, r1 double, r2 double, r3 double")
    rbox = ("r0", "r1", "r2", "r3")
    for closed in (False, True):
        meets = lambda p, q: (p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]) if closed else (  # noqa: B023, E731
            p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5])
        want = sorted((p[0], p[1], q[1]) for p in left for q in right if p[0] == q[0] and meets(p, q))
        got = spatial.box_pairs(a, b, ["s"], rbox, closed=closed)
        assert sorted((r.s, r.a, r.b) for r in got.collect()) == want
        hit = spatial.boxes_hit(a, b, ["s"], ["s", "a"], rbox, closed=closed)
        assert sorted((r.s, r.a) for r in hit.collect()) == sorted({x[:2] for x in want})
    listed = spatial.grid_cells(a, spatial.levels_of(a))
    assert listed.groupBy("s", "a", "_lvl").count().agg({"count": "max"}).first()[0] <= 4
    points = spark.createDataFrame([(s, i, rng.uniform(-2e5, 2e5), rng.uniform(-2e5, 2e5)) for i in range(200) for s in range(3)],
                                   "s int, p int, x double, y double")
    inside = sorted((r.s, r.p, q[1]) for r in points.collect() for q in right
                    if r.s == q[0] and q[2] <= r.x <= q[4] and q[3] <= r.y <= q[5])
    join = lambda how: spatial.points_join(points, b, ["s"], how, rbox).collect()
    assert sorted((r.s, r.p, r.b) for r in join("inner")) == inside
    held = {x[:2] for x in inside}
    assert sorted((r.s, r.p) for r in join("left_semi")) == sorted(held)
    assert len(join("left_anti")) == 600 - len(held) > 0


def test_wide_box_adds_few_rounds(spark, monkeypatch):
    rng = random.Random(5)
    rows = random_sheet(rng, 1, 150, 200)
    wide = (1, 1000, "w", 0., 0., 100_000., 100_000., .9)
    rounds = []
    kept_pairs = merge.box_pairs
    monkeypatch.setattr(merge, "box_pairs", lambda *a, **k: rounds.append(1) or kept_pairs(*a, **k))
    took = []
    for some in (rows, [*rows, wide]):
        rounds.clear()
        out = merge_detections(frame(spark, some), fold_limit=0)
        assert {(r.sheet_id, r.det_idx) for r in out.where("kept").collect()} == slow_merge(some)
        took.append(len(rounds))
    assert took[1] <= took[0] + 4


@pytest.mark.parametrize("ties", ["first", "last"])
def test_match_random_fold_and_rounds_agree_with_loop(spark, ties):
    rng = random.Random(11)
    truth, dets = [], []
    for sheet in range(20):
        span = rng.choice([10, 40, 120])
        truth += [(sheet, r[1], *r[3:7]) for r in random_sheet(rng, sheet, rng.randrange(1, 14), span)]
        dets += [(sheet, r[1], *r[3:7]) for r in random_sheet(rng, sheet, rng.randrange(1, 14), span)]
    truth += [(77, i, 5., 5., 25., 15.) for i in range(60)]
    dets += [(77, i, 5. + (i % 50 == 0), 5., 25., 15.) for i in range(80)]
    t = frame(spark, truth, "sheet_id long, truth_idx long, x0 double, y0 double, x1 double, y1 double")
    d = frame(spark, dets, "sheet_id long, det_idx long, x0 double, y0 double, x1 double, y1 double")
    want = slow_match(truth, dets, ties == "last")
    for kw in ({}, {"pair_limit": 20, "cell": 16.0}):
        got = match_one_to_one(t, d, ties=ties, **kw).collect()
        assert {(r.sheet_id, r.truth_idx, r.det_idx) for r in got} == want


def test_match_empty(spark):
    t = frame(spark, [(1, 0, 0., 0., 10., 10.)],
              "sheet_id long, truth_idx long, x0 double, y0 double, x1 double, y1 double")
    d = frame(spark, [(1, 0, 500., 500., 510., 510.)],
              "sheet_id long, det_idx long, x0 double, y0 double, x1 double, y1 double")
    assert match_one_to_one(t, d).count() == 0
    assert match_one_to_one(t, d, pair_limit=0).count() == 0


def test_rank_within_large_groups(spark):
    rng = random.Random(3)
    rows = [(1 if i % 3 else i % 7, rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int, id int")
    small = {tuple(r) for r in rank_within(df, ["k"], ["v", "id"], "rn").collect()}
    large = {tuple(r) for r in rank_within(df, ["k"], ["v", "id"], "rn", limit=100).collect()}
    assert small == large and len(small) == 3000


def test_missed_text(spark):
    kept = frame(spark, [(1, 0, "2", 1268., 1301., 1300., 1344., 1.0)])
    rows = [(1, 1, "Vaer. 2", 1136., 1298., 1303., 1349., .949), (1, 2, "ab", 0., 0., 9., 9., .99),
            (1, 3, "abcd", 0., 0., 9., 9., .5), (1, 4, "222", 1268., 1301., 1300., 1344., .99)]
    got = missed_text(frame(spark, rows), kept).collect()
    assert [(r.det_idx, r.flag.code, r.flag.severity) for r in got] == [(1, "possible-missed-text", "warn")]


def crossed(rng):
    """Boxes about the borders of blocks, a board of many far groups, and one under a wide box."""
    rows = [(1, i, "x" * rng.randrange(1, 6), x, y, x + rng.choice([8., 40., 300.]), y + 20., rng.choice([.8, .9, .95]))
            for i in range(120) for x, y in [(1000. + rng.randrange(60) + 5000 * rng.randrange(3), float(rng.randrange(40)))]]
    rows += [(2, i, "x" * rng.randrange(1, 6), x, 10., x + 30., 30., rng.choice([.8, .9, .95]))
             for i in range(120) for x in [2048. * (i // 4) + rng.randrange(30)]]
    rows += [(3, i, "x" * rng.randrange(1, 6), x, 10., x + 30., 30., .9) for i in range(40) for x in [500. * (i // 4) + rng.randrange(30)]]
    return rows + [(3, 40, "wide", 0., 0., 70_000., 40., .95)]


def test_blocks_of_crowded_sheets_are_folded(spark, monkeypatch):
    rows = crossed(random.Random(5))
    rounds, in_rounds = [], merge._merge_in_rounds
    monkeypatch.setattr(merge, "_merge_in_rounds", lambda df, *a: rounds.append(df.groupBy("sheet_id").count().collect()) or in_rounds(df, *a))
    out = merge_detections(frame(spark, rows), fold_limit=30)
    got = {(r.sheet_id, r.det_idx) for r in out.where("kept").collect()}
    assert out.count() == len(rows)
    assert got == set().union(*[slow_merge([r for r in rows if r[0] == s]) for s in (1, 2, 3)])
    assert [sorted(r.sheet_id for r in some) for some in rounds] == [[1, 3]]


def test_blocks_of_crowded_sheets_are_matched_by_fold(spark, monkeypatch):
    rows = crossed(random.Random(9))
    rng = random.Random(10)
    truth = [(r[0], r[1], r[3] + rng.choice([0., 3.]), r[4], r[5], r[6]) for r in rows if r[0] != 1]
    dets = [(r[0], r[1], r[3], r[4] + rng.choice([0., 2.]), r[5], r[6]) for r in rows if r[0] != 1]
    kinds = {"truth_idx": truth, "det_idx": dets}
    t, d = (frame(spark, some, f"sheet_id long, {n} long, x0 double, y0 double, x1 double, y1 double") for n, some in kinds.items())
    rounds, in_rounds = [], match._match_in_rounds
    monkeypatch.setattr(match, "_match_in_rounds", lambda t, d, *a: rounds.append(t.groupBy("sheet_id").count().collect()) or in_rounds(t, d, *a))
    got = {(r.sheet_id, r.truth_idx, r.det_idx) for r in match_one_to_one(t, d, pair_limit=150).collect()}
    assert got == slow_match(truth, dets)
    assert [sorted(r.sheet_id for r in some) for some in rounds] == [[3]]
