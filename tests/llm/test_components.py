"""Components of links: right, in few tasks, and without files of earlier rounds."""

import os
import random
from glob import glob

from pyspark.sql import functions as F

from planloom.llm.components import components
from planloom.session import checkpoint_dir, shuffles_freed


def brute(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in pairs:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for u, v in pairs if u != v for x in (u, v)}


def table(spark, pairs):
    return spark.createDataFrame(pairs, "u long, v long")


def held(spark):
    return set(glob(checkpoint_dir(spark).removeprefix("file:").rstrip("/") + "/*"))


def test_equal_brute_force(spark):
    for seed, n in ((1, 30), (2, 60), (3, 90)):
        rng = random.Random(seed)
        pairs = [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(n)]
        assert {r.node: r.root for r in components(table(spark, pairs)).collect()} == brute(pairs)
    chain = [(i, i + 1) for i in range(40)]
    assert {r.node: r.root for r in components(table(spark, chain)).collect()} == brute(chain)
    assert components(table(spark, [])).collect() == []


def test_few_tasks_and_files(spark):
    links, before, sc = table(spark, [(0, i) for i in range(1, 9)] + [(20, i) for i in range(21, 29)]), held(spark), spark.sparkContext
    sc.setJobGroup("components", "stars")
    try:
        found = components(links)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert found.count() == 18
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    # the links are written and looked at once, in three jobs of few tasks; a round more would be four tables
    assert 0 < tasks <= 60, tasks
    assert len(held(spark) - before) == 1


def test_shuffle_files_go_at_once(spark):
    tops = os.environ.get("SPARK_LOCAL_DIRS", spark.conf.get("spark.local.dir", "/tmp")).split(",")
    files = lambda: {f for top in tops for f in glob(f"{top}/blockmgr-*/*/shuffle_*")}
    before, kept = files(), spark.range(1000).groupBy(F.col("id") % 7).count().checkpoint(eager=True)
    assert files() - before and kept.count() == 7
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    with shuffles_freed(spark):
        assert spark.range(1000).groupBy(F.col("id") % 7).count().checkpoint(eager=True).count() == 7
        assert components(table(spark, [(i, i + 1) for i in range(9)])).count() == 10
    assert not files() - before
    assert spark.conf.get(key) == was
