"""Tables that are written out between steps, numbers shared by sheets, exact percentiles."""

import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from planloom.operators import gate, merge, pixels
from planloom.plans import reading, vector_pages, verifying
from planloom.session import checkpoint_dir, forget, written
from planloom.workload import q_match
from planloom.workload.registry import QUERIES

EQUAL = ((0, 15, 243), (4, 138, 0))


def _local(spark):
    return checkpoint_dir(spark).removeprefix("file:")


def _new_rdds(spark, before):
    """Checkpoints (rdd-...) that came after ``before``."""
    return [d for d in set(os.listdir(_local(spark))) - before if d.startswith("rdd-")]


def _runs(spark):
    rows = [(1, n, "room" if n == 1 else "dimension", 300.0 * n, 20.0, 0.5 if n == 1 else 0.0) for n in range(1, 6)]
    df = spark.createDataFrame(rows, "sheet_id long, run_id long, kind string, cx_out double, cy_out double, hidden double")
    return df.withColumns({"target_along": F.lit(20.0), "target_across": F.lit(8.0), "angle_out": F.lit(0.0), "ink_width": F.lit(20.0), "ink_height": F.lit(8.0)})


def test_written_rows_come_back_and_go(spark):
    df = spark.range(5).select("id", F.struct(F.lit("a").alias("t")).alias("s"), F.when(F.col("id") > 2, F.col("id") / 3).alias("x"))
    out = written(df)
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    folder = out._written_to.removeprefix("file:")
    assert os.path.exists(folder)
    forget(out)
    assert not os.path.exists(folder)


def test_gate_keeps_no_runs_of_earlier_passes(spark):
    checkpoint_dir(spark)
    before = set(os.listdir(_local(spark)))
    runs = spark.createDataFrame([(1, 1, "a", "A", False, "dimension", 1.0, 1.0, 0.0)], "sheet_id long, run_id long, text string, font string, "
                                 "bold boolean, kind string, ink_height double, target_across double, hidden double")
    flag = F.struct(F.lit("low-confidence").alias("code"), F.lit("m").alias("message"), F.lit("warn").alias("severity"))
    result = gate.run_gate(gate.GateTables(runs.withColumn("flags", F.array(flag))), runs.select("sheet_id"))
    assert [r.passed for r in result.report.collect()] == [True]
    assert not _new_rdds(spark, before)
    # the runs as they are, and not those before the correction, are in the folder
    left = [d for d in set(os.listdir(_local(spark))) - before if d.startswith("rows-")]
    with_text = [d for d in left if "font" in spark.read.parquet(f"{_local(spark)}/{d}").columns]
    assert len(with_text) == 1


def test_place_clear_takes_only_runs_within_reach(spark, monkeypatch):
    seen, best = [], gate._best_moves

    def watched(others, movers, occupied, cell):
        seen.append(others.count())
        return best(others, movers, occupied, cell)

    monkeypatch.setattr(gate, "_best_moves", watched)
    drawn = spark.createDataFrame([(1, 290.0, 15.0, 310.0, 25.0)], "sheet_id long, x0 double, y0 double, x1 double, y1 double")
    out = gate.place_clear(_runs(spark), drawn).collect()
    assert seen == [1] and sorted(r.run_id for r in out if r.moved) == [1] and len(out) == 5


def test_dense_merge_leaves_no_rounds_behind(spark):
    checkpoint_dir(spark)
    before = set(os.listdir(_local(spark)))
    rows = [(1, n, 30.0 * n, 0.0, 30.0 * n + 25, 10.0, 0.9, "abc") for n in range(20)]
    df = spark.createDataFrame(rows, "sheet_id long, det_idx long, x0 double, y0 double, x1 double, y1 double, conf double, text string")
    out = merge.merge_detections(df, fold_limit=1)
    assert out.where("kept").count() == 20
    # the kept runs and the empty rest
    left = [d for d in set(os.listdir(_local(spark))) - before if d.startswith("rows-")]
    assert len(left) == 2


def test_dense_queries_tell_runs_with_one_number_apart(spark):
    rows = [(s, 7, 0.0, 0.0, 20.0, 10.0, 0.9, f"text {s}") for s in (2, 4, 6)]
    dets = spark.createDataFrame(rows, "sheet_id long, det_idx long, x0 double, y0 double, x1 double, y1 double, conf double, text string")
    t = SimpleNamespace(truth=dets.withColumnRenamed("det_idx", "truth_idx"), detections=dets)
    found = q_match.match.match_one_to_one
    q_match.match.match_one_to_one = lambda *a, **k: found(*a, **k, pair_limit=1)
    try:
        out = q_match._match_dense(t).collect()
    finally:
        q_match.match.match_one_to_one = found
    assert sorted((r.sheet_id, r.truth_idx, r.det_idx, r.iou) for r in out) == [(s, 7, 7, 1.0) for s in (2, 4, 6)]


def test_ink_colour_takes_equal_luma_as_equal(spark):
    # 0.114 * b + 0.587 * g + 0.299 * r differs in the last bit for the first two
    rows = [(1, 0, 0, *EQUAL[0]), (1, 0, 1, *EQUAL[1]), (1, 0, 2, 255, 255, 255)]
    out = pixels.sheet_ink_colour(spark.createDataFrame(rows, "sheet_id long, y int, x int, b int, g int, r int")).first()
    assert (out.b, out.g, out.r) == tuple((p + q) // 2 for p, q in zip(*EQUAL))


def test_long_runs_of_any_length_and_place(spark):
    rows = [(1, 5, x) for x in range(-3, 38)] + [(1, 9, x) for x in range(60, 99)] + [(1, y, 70) for y in range(13, 53)] + [(2, 0, 0)]
    dark = spark.createDataFrame(rows * 2, "sheet_id long, y int, x int")
    long = {(r.sheet_id, r.y, r.x) for r in pixels.long_runs(dark, 40).collect()}
    assert long == {(1, 5, x) for x in range(-3, 38)} | {(1, y, 70) for y in range(13, 53)}
    assert pixels.long_runs(dark, 3).count() == 41 + 39 + 40
    assert pixels.long_runs(dark, 1).count() == 41 + 39 + 40 + 1


def test_long_runs_shuffle_tiles_and_no_pixels(spark):
    rng = random.Random(3)
    pts = {(s, rng.randrange(30), rng.randrange(40)) for s in range(3) for _ in range(900)}

    def run(p, d):
        n = 1
        for by in (1, -1):
            at = [p[0], p[1] + by * d[0], p[2] + by * d[1]]
            while tuple(at) in pts:
                n, at = n + 1, [at[0], at[1] + by * d[0], at[2] + by * d[1]]
        return n

    dark = spark.createDataFrame(sorted(pts), "sheet_id long, y int, x int")
    for length in (1, 5, 9, 17):
        want = {p for p in pts if max(run(p, (0, 1)), run(p, (1, 0))) >= length}
        for limit in (10**6, 100):
            got = pixels.long_runs(dark, length, sheet_limit=limit).collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want
    lies = pixels.long_runs(dark, 9)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in lies
    assert pixels.long_runs(dark, 9)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_place_clear_leaves_broadcasts_small(spark, monkeypatch):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before, seen, best = [spark.conf.get(n, None) for n in names], [], gate._best_moves

    def watched(*args):
        seen.extend(int(spark.conf.get(n)) for n in names)
        return best(*args)

    monkeypatch.setattr(gate, "_best_moves", watched)
    drawn = spark.createDataFrame([(1, 290.0, 15.0, 310.0, 25.0)], "sheet_id long, x0 double, y0 double, x1 double, y1 double")
    assert gate.place_clear(_runs(spark), drawn).where("moved").count() == 1
    assert seen == [-1, 1 << 20] and [spark.conf.get(n, None) for n in names] == before


def test_gate_query_has_every_check_and_correction(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(gate, "run_gate", lambda t, sheets: seen.append(t) or SimpleNamespace(report=sheets))
    QUERIES["run_gate"](spark, "/root/testdata/sf0.001")
    t, = seen
    assert t.occupied is not None and t.occupied.count() == t.runs.sparkSession.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert {r.rule for f in t.fixed_violations for r in f.collect()} == {"spatial-integrity", "layer-ordering"}
    assert t.runs.where(F.exists("flags", lambda f: f["severity"] == "error")).count() > 0


@pytest.mark.parametrize("name, plan", [("compare_passes", reading), ("verify_corpus", verifying), ("mirror_traces_calibrated", vector_pages)])
def test_plans_free_the_shuffle_files_of_each_step(spark, monkeypatch, name, plan):
    freed, write = [], plan.written

    def watched(df):
        freed.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"))
        return write(df)

    monkeypatch.setattr(plan, "written", watched)
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert freed and set(freed) == {"true"}


def test_compared_passes_leave_no_reading_behind(spark):
    checkpoint_dir(spark)
    before = set(os.listdir(_local(spark)))
    QUERIES["compare_passes"](spark, "/root/testdata/sf0.001")
    # the scores of both sides
    assert len([d for d in set(os.listdir(_local(spark))) - before if d.startswith("rows-")]) == 2
