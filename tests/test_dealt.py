"""What a task of a shuffle holds, and how often rows are shuffled."""

import random

from pyspark.sql import functions as F

from planloom import session
from planloom.operators import detect
from planloom.plans import reading


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tilted(spark, n=400):
    rng = random.Random(6)
    rows = [(rng.randrange(20), i, rng.choice([0.0, 90.0, -90.0, 180.0]) + rng.choice([0.0, 1.0, -1.0]) * rng.uniform(0, 22))
            for i in range(n)]
    rows += [(0, n, None), (0, n + 1, float("nan"))]
    return spark.createDataFrame(rows, "sheet_id long, det_idx long, angle_deg double")


def test_tilts_by_sort_and_by_bins_agree(spark):
    runs = tilted(spark)
    one = detect.corroborate_tilts(runs)
    two = detect.corroborate_tilts(runs, sort_limit=5)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert one.where("angle_deg % 90 <> 0").count() not in (0, 400)


def test_tilts_of_ordinary_sheets_are_neither_copied_nor_joined(spark):
    found = plan(detect.corroborate_tilts(tilted(spark)))
    assert "Join" not in found and "Generate" not in found


def test_large_tables_are_dealt_to_more_tasks(spark, monkeypatch):
    runs = tilted(spark)
    assert session.dealt(runs, ["sheet_id"]) is runs
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    assert session.dealt(runs, ["sheet_id"]).rdd.getNumPartitions() == 9
    assert sorted(map(repr, detect.corroborate_tilts(runs).collect())) == sorted(
        map(repr, detect.corroborate_tilts(runs, sort_limit=5).collect()))


def test_corroborated_runs_are_made_distinct_once(spark):
    runs = spark.createDataFrame([(1, 1, "12", 10.0, 10.0, 60.0, 30.0, 0.0), (1, 2, "12", 400.0, 10.0, 450.0, 30.0, 0.0)],
                                 "sheet_id long, det_idx long, text string, x0 double, y0 double, x1 double, y1 double, angle_deg double")
    lines = spark.createDataFrame([(1, 0.0, 40.0, 90.0, 40.0), (1, 0.0, 45.0, 90.0, 45.0), (1, 400.0, 40.0, 410.0, 40.0)],
                                  "sheet_id long, x0 double, y0 double, x1 double, y1 double")
    found = detect.line_corroboration(runs, lines)
    assert [tuple(r) for r in found.collect()] == [(1, 1)]
    assert plan(found).count("Aggregate [") == 1


def test_passes_are_placed_once(spark):
    passes = spark.createDataFrame([(1, 1, 0, "Hall", 0.9), (1, 2, 9, "Hall", 0.9)], "sheet_id long, det_idx long, pass_id int, text string, conf double")
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    passes = passes.withColumn("quad", F.array(corner(1.0, 1.0), corner(41.0, 1.0), corner(41.0, 11.0), corner(1.0, 11.0)))
    read = reading.read_runs(passes, spark.createDataFrame([(1, 100.0, 100.0)], "sheet_id long, width double, height double"))
    assert [r.error for r in read.errors.collect()] == ["pass without an angle"] and read.runs.count() == 1
    assert "Join" not in plan(read.errors)


def test_tilts_among_some_rows_where_they_lie(spark):
    runs = tilted(spark).withColumn("kept", F.col("det_idx") % 3 > 0).repartition(3, "sheet_id")
    want = detect.corroborate_tilts(runs.where("kept")).unionByName(runs.where("NOT kept"))
    for limit in (5, 20_000):
        got = detect.corroborate_tilts(runs, sort_limit=limit, among=F.col("kept"), counted=runs)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    again = detect.corroborate_tilts(runs, among=F.col("kept"), counted=runs)
    lies = again._jdf.queryExecution().executedPlan().toString()
    assert lies.count("Exchange") == runs._jdf.queryExecution().executedPlan().toString().count("Exchange")
