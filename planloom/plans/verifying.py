"""Independent check of mirrored sheets against their sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import geometry as G
from planloom.operators import match, pixels as P
from planloom.operators.vocab import Vocabulary, snap_text
from planloom.session import shuffles_freed, written


@dataclass
class Verification:
    report: DataFrame
    regions: DataFrame
    issues: DataFrame
    unreadable: DataFrame   # sheets whose sizes cannot be compared


def expected_wording(dets: DataFrame, sizes: DataFrame, axis, vocab: Vocabulary = Vocabulary()) -> DataFrame:
    """What must be readable on the output: corrected text at mirrored boxes."""
    snapped = snap_text(dets.join(sizes.select("sheet_id", "width", "height"), "sheet_id"), vocab=vocab)
    box = G.mirror_box(G.box_of(), "width", "height", axis)
    return snapped.select("sheet_id", F.col("det_idx").alias("run_id"), F.col("snap.text").alias("text"),
                          F.col("text").alias("source_text"), "conf", *[c.alias(n) for c, n in zip(box, G.BOX)])


def verify_corpus(source: DataFrame, output: DataFrame, source_sizes: DataFrame, output_sizes: DataFrame,
                  source_dets: DataFrame, output_dets: DataFrame, axis,
                  vocab: Vocabulary = Vocabulary()) -> Verification:
    """Pixels outside text must be the reflected source, and text must read back.

    ``source_dets`` are detections of the source in output scale.
    """
    scales = P.align_scale(source_sizes, output_sizes)
    comparable = scales.where(F.col("scale").isNotNull()).select("sheet_id")
    sizes = output_sizes.join(comparable, "sheet_id", "left_semi")
    flipped = P.flip_pixels(P.enlarge(source, scales), sizes, axis)
    # each step is written out, so that its shuffle files are gone before the next one
    with shuffles_freed(source.sparkSession):
        diffs = written(P.diff_pixels(flipped, output.join(comparable, "sheet_id", "left_semi")))
        expected = written(expected_wording(source_dets, sizes, axis, vocab))
        outside = P.outside_boxes(diffs, expected.select("sheet_id", *G.BOX), pad=K.TEXT_EXCLUSION_PAD_PX)
        regions = written(P.diff_regions(outside))
        issues = written(match.check_wording(expected, output_dets, vocab=vocab, source_conf=True))
    return Verification(P.verify_report(sizes, diffs, regions, issues, expected), regions, issues,
                        scales.where(F.col("scale").isNull()))
