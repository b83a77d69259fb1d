"""A batch of input files: manifest, problems, routes and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.operators import batch
from planloom.sources.files import route_by_suffix


@dataclass
class Batch:
    manifest: DataFrame
    counts: DataFrame
    summary: DataFrame


def scan_batch(listing: DataFrame, documents: DataFrame, pages: DataFrame, page_images: DataFrame,
               results: DataFrame) -> Batch:
    """``documents`` describe the accepted paths, ``results`` holds per path the
    status, error and (if reviewed) picture_labels so far."""
    manifest = batch.build_manifest(listing)
    problems = batch.classify_inputs(documents, pages, page_images)
    entry = (manifest.drop("status").join(problems.drop("doc_id"), "path", "left")
             .join(results.select("path", "status", "error", "picture_labels"), "path", "left")
             .withColumn("status", F.coalesce("status", F.lit("queued")))
             .withColumn("route", route_by_suffix(F.col("path"))))
    for c in ("badge", "reason"):
        entry = entry.withColumn(c, batch.blocking_problem(F.col(c), F.col("picture_labels")))
    return Batch(entry, batch.manifest_counts(listing, manifest, problems), batch.batch_summary(entry))
