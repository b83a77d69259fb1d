"""Vector documents: expected text transforms, calibration, check, record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.operators import batch, vector
from planloom.session import shuffles_freed, written


@dataclass
class VectorResult:
    expected: DataFrame     # per run, with calibrated output matrix
    checks: DataFrame       # per run, failure or NULL
    documents: DataFrame    # per document: runs, failed, first failure
    records: DataFrame      # job records of documents without failures


def mirror_traces(traces: DataFrame, matrices: DataFrame, pages: DataFrame, rendered: DataFrame, axis: str,
                  flags: DataFrame | None = None, rendered_again: DataFrame | None = None) -> VectorResult:
    """Reflect every run, calibrate on a first rendering and check it.

    ``rendered`` has the measured text, ends and matrix per run,
    ``rendered_again`` the same of a rendering with the calibrated matrices,
    which is then the one that is checked. A document with an error or a
    failed run gets no record.
    """
    # each step is written out, so that its shuffle files are gone before the next one
    with shuffles_freed(traces.sparkSession):
        expected = written(vector.expected_transforms(traces, matrices, pages, axis))
        good = expected.where(F.col("error").isNull())
        calibrated = written(vector.calibrate_translations(good, rendered, axis))
        checks = (vector.verify_transforms(good, rendered) if rendered_again is None
                  else vector.verify_transforms(calibrated, rendered_again))
        bad = expected.where(F.col("error").isNotNull()).select(*vector.RUN, F.col("error").alias("failure"))
        checks = written(checks.join(bad, vector.RUN, "left_anti").unionByName(bad))
    documents = vector.verify_documents(checks)
    passed = documents.where(F.col("failed") == 0).select("doc_id")
    n = good.groupBy(*vector.PAGE).agg(F.count("*").alias("text_runs_mirrored"))
    listed = (pages.drop("text_runs_mirrored").join(passed, "doc_id", "left_semi").join(n, vector.PAGE, "left")
              .withColumn("text_runs_mirrored", F.coalesce("text_runs_mirrored", F.lit(0))))
    if flags is None:
        flags = listed.select(*vector.PAGE, *[F.lit("").alias(c) for c in ("code", "message", "severity")]).limit(0)
    jobs = passed.select("doc_id", F.lit(axis).alias("axis"), F.lit("vector").alias("route"))
    return VectorResult(calibrated, checks, documents, batch.job_records(jobs, listed, flags))
