"""From raw reading passes to triaged runs, mirrored runs and job records.

Everything is keyed by sheet: the passes are one table, the geometry steps are
columns next to the scan, the merge shuffles by sheet once, and tilts, checks
and triage add counts or grid-cell joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import flags as FL, geometry as G, text as T
from planloom.operators import batch, detect, match, merge, sizes
from planloom.operators.vocab import Vocabulary
from planloom.session import forget, join_small, shuffles_freed, written


@dataclass
class Reading:
    runs: DataFrame         # triaged detections: disposition, snap, flags
    dropped: DataFrame      # rejected or merged-away candidates
    decisions: DataFrame    # per sheet: keep, upscale or refuse
    missed: DataFrame       # dropped reads nothing covers, with a flag
    errors: DataFrame       # reads that cannot be placed, with an ``error``


#: Sheet sizes beyond the sheet at which a box cannot be a read any more.
FAR = 10


def _near(low: Column, high: Column, size: Column) -> Column:
    return (low > -FAR * size) & (high < (1 + FAR) * size) & ~F.isnan(low) & ~F.isnan(high)


def place_candidates(passes: DataFrame, sheets: DataFrame) -> DataFrame:
    """Candidates in upright coordinates with box, pass angle, ``plausible``,
    final angle and ``error``. ``passes`` has pass_id and quads in frame coordinates.

    No read is left out: one of a sheet without a size, of a pass without an
    angle, without an area or farther out than FAR sheet sizes has an ``error``
    instead of a place. (A box is listed in each grid cell that it touches.)
    """
    sized = join_small(passes, sheets.select("sheet_id", "width", "height"), "sheet_id", "left")
    claimed = F.try_element_at(F.create_map(*[F.lit(v) for p in K.PASS_ANGLES for v in p]), F.col("pass_id"))
    work = detect.with_bbox(detect.unrotate_quads(sized.withColumn("pass_angle", claimed)))
    error = (F.when(F.col("width").isNull() | F.col("height").isNull(), "sheet without a size")
             .when(F.col("pass_angle").isNull(), "pass without an angle")
             .when(~F.coalesce(G.area(G.box_of()) > 0, F.lit(False)), "box without an area")
             .when(~_near(F.col("x0"), F.col("x1"), F.col("width")) | ~_near(F.col("y0"), F.col("y1"), F.col("height")),
                   "box far outside its sheet"))
    # plausibility looks at the angle of the pass, before the quad refines it
    return work.withColumns({
        # a read without a text says nothing against its place
        "plausible": F.coalesce(detect.orientation_plausible(F.col("text"), F.col("pass_angle")), F.lit(True)),
        "angle_deg": G.quad_angle("quad", F.col("pass_angle")), "error": error}).drop("width", "height")


def read_runs(passes: DataFrame, sheets: DataFrame, protected: DataFrame | None = None,
              rereads: DataFrame | None = None, segments: DataFrame | None = None,
              vocab: Vocabulary = Vocabulary(), scorer=T.similarity, quads: bool = True) -> Reading:
    """The whole reading of the passes; without ``quads``, reads keep their boxes and angles only."""
    if rereads is not None:
        passes = detect.merge_rereads(passes, rereads)
    with shuffles_freed(passes.sparkSession):
        placed = place_candidates(passes, sheets)
        return _read(placed if quads else placed.drop("quad"), sheets, protected, segments, vocab, scorer)


def _read(judged, sheets, protected, segments, vocab, scorer) -> Reading:
    # Written out once: the merge counts and reads it, and so do the errors and implausible reads.
    judged = written(judged)
    errors = judged.where(F.col("error").isNotNull())
    placed = judged.where(F.col("error").isNull()).drop("error")
    merged = merge.merge_detections(placed.where("plausible"))
    upright = F.when(F.col("kept"), detect.canonical_vertical(F.col("angle_deg"))).otherwise(F.col("angle_deg"))
    if segments is None:
        # the tilts of a sheet are sorted where the merge has left its reads
        merged = written(detect.corroborate_tilts(merged.withColumn("angle_deg", upright), among=F.col("kept"), counted=judged))
        kept, steps = merged.where("kept"), [judged, merged]
    else:
        merged = written(merged)
        kept = merged.where("kept").withColumn("angle_deg", upright)
        kept = written(detect.corroborate_tilts(kept, corroborated=detect.line_corroboration(kept, segments)))
        steps = [judged, merged, kept]
    dropped = merged.where(~F.col("kept")).unionByName(
        placed.where(~F.col("plausible")).withColumn("kept", F.lit(False)))
    # Written out once: runs and flags are read by several steps that follow.
    runs = written(detect.triage_runs(kept.drop("kept", "plausible", "pass_angle"), vocab, protected,
                                          scorer=scorer))
    dropped = written(dropped.drop("kept"))
    reading = Reading(runs, dropped, written(detect.upscale_decision(kept, sheets)),
                      written(match.missed_text(dropped, kept)), written(errors))
    for step in steps:
        forget(step)
    return reading


def mirror_runs(reading: Reading, sheets: DataFrame, axis, fonts: DataFrame | None = None) -> DataFrame:
    """Runs in output space: text, kind, mirrored box, centre and angle, flags.

    Sheets that are refused, as their text is too small to be read, have none.
    With ``fonts`` the runs carry a style (font, px_size, tracking, width_scale,
    ink_along) and equal sizes are given to labels of one size cluster.
    """
    refused = reading.decisions.where(F.col("decision") == "refuse").select("sheet_id")
    runs = reading.runs.where(F.col("disposition") == "run").join(refused, "sheet_id", "left_anti")
    runs = runs.withColumns({"text_raw": F.col("text"), "text": F.col("snap.text"), "kind": F.col("snap.kind")})
    if fonts is not None:
        runs = sizes.snap_sizes(runs, fonts)
    sized = join_small(runs, sheets.select("sheet_id", "width", "height"), "sheet_id")
    out = dict(zip(("ox0", "oy0", "ox1", "oy1"), G.mirror_box(G.box_of(), "width", "height", axis)))
    cx, cy = G.box_center(G.box_of())
    return sized.withColumns({
        **out, "cx_out": G.mirror_x(cx, "width", axis), "cy_out": G.mirror_y(cy, "height", axis),
        "angle_out": G.mirror_angle(F.col("angle_deg"), axis)}).drop("width", "height", "snap")


def page_flags(reading: Reading) -> DataFrame:
    """Flags of the page record: sheet flags, and warnings of its runs."""
    flags = reading.runs.select("sheet_id", "disposition", F.explode("flags").alias("f")).select(
        "sheet_id", "disposition", "f.*")
    missed = reading.missed.select("sheet_id", "flag.*")
    enlarged = reading.decisions.where(F.col("decision") == "upscale").select(
        "sheet_id", FL.flag("upscaled", F.format_string("Sheet enlarged %.0fx before reading (small type).", "factor"))
        .alias("f")).select("sheet_id", "f.*")
    sheet = (missed.unionByName(enlarged)
             .unionByName(flags.where(F.col("disposition") == "symbol").drop("disposition")))
    return batch.union_flags(sheet, flags.where(F.col("disposition") == "run"))


def mirror_records(reading: Reading, sheets: DataFrame, axis: str) -> DataFrame:
    """Job records of a raster corpus: one page per sheet. Refused sheets have
    no record."""
    accepted = reading.decisions.where(F.col("decision") != "refuse").select("sheet_id")
    n = (reading.runs.where(F.col("disposition") == "run").groupBy("sheet_id")
         .agg(F.count("*").alias("text_runs_mirrored")))
    pages = (sheets.join(accepted, "sheet_id", "left_semi").join(n, "sheet_id", "left")
             .select(F.col("sheet_id").alias("doc_id"), F.lit(0).alias("page_index"), "width", "height",
                     F.coalesce("text_runs_mirrored", F.lit(0)).alias("text_runs_mirrored")))
    pages = written(pages)
    flags = page_flags(reading).join(accepted, "sheet_id", "left_semi").select(
        F.col("sheet_id").alias("doc_id"), F.lit(0).alias("page_index"), "code", "message", "severity")
    jobs = pages.select("doc_id", F.lit(axis).alias("axis"), F.lit("raster").alias("route"))
    return batch.job_records(jobs, pages, flags)
