"""Lettering inside placed pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import flags as FL, geometry as G, text as T
from planloom.operators.vector import PAGE


def check_placements(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placements, refusals): pictures of documents that can be edited, and
    the first reason per refused document.

    ``images``: doc_id, page_index, img_no, xref, box, a, b, c, d, px_w, px_h.
    """
    order = F.struct("page_index", "img_no")
    first = (images.where(F.col("xref") > 0).groupBy("doc_id", "xref").agg(F.min(order).alias("_first")))
    work = images.join(first, ["doc_id", "xref"], "left").withColumn("_at", order)
    turned = (F.abs("b") > 1e-6) | (F.abs("c") > 1e-6) | (F.col("a") <= 0) | (F.col("d") <= 0)
    reason = (F.when(F.coalesce("xref", F.lit(0)) <= 0, "inline picture")
              .when(turned, "rotated or flipped picture")
              .when(F.col("_at") != F.col("_first"), "picture placed more than once"))
    work = work.withColumn("reason", reason)
    refused = (work.where(F.col("reason").isNotNull()).groupBy("doc_id")
               .agg(F.min(F.struct(F.col("_at"), "reason")).alias("m"))
               .select("doc_id", (F.col("m._at.page_index") + 1).alias("page"), F.col("m.reason").alias("reason")))
    good = work.join(refused.select("doc_id"), "doc_id", "left_anti").drop("_first", "_at", "reason")
    return good, refused


def picture_label_candidates(dets: DataFrame, placements: DataFrame,
                             min_confidence: float = K.PICTURE_LABEL_CONF) -> DataFrame:
    """Labels read in a picture, in picture pixels and page points.

    ``dets`` has doc_id, xref, text, box (on the enlarged picture), conf and
    angle_deg. Sort by page_index, page_y0, page_x0 to list them.
    """
    work = dets.join(placements.select("doc_id", "xref", "page_index", *[
        F.col(c).alias("r_" + c) for c in G.BOX], "px_w", "px_h"), ["doc_id", "xref"])
    rw, rh = F.col("r_x1") - F.col("r_x0"), F.col("r_y1") - F.col("r_y0")
    dpi = F.col("px_w") / F.greatest(rw / 72.0, F.lit(1e-6))
    factor = F.greatest(F.lit(1), F.ceil(K.OCR_DPI / F.greatest(dpi, F.lit(1.0)) - 1e-6))
    work = work.withColumn("text", T.strip(F.col("text"))).where(F.col("text") != "").withColumn("factor", factor)
    ink = (F.greatest((F.col("x0") / F.col("factor")).cast("int"), F.lit(0)),
           F.greatest((F.col("y0") / F.col("factor")).cast("int"), F.lit(0)),
           F.least(F.ceil(F.col("x1") / F.col("factor")).cast("int"), F.col("px_w").cast("int")),
           F.least(F.ceil(F.col("y1") / F.col("factor")).cast("int"), F.col("px_h").cast("int")))
    work = work.withColumns({"i" + n: c for n, c in zip(G.BOX, ink)})

    def page(c, lo, span, px):
        return F.col(lo) + F.col(c) * span / F.col(px)

    include = ((F.col("conf") >= min_confidence) & ~T.is_graphical_symbol(F.col("text"))
               & F.col("angle_deg").isin(*K.PICTURE_LABEL_ANGLES))
    return work.withColumns({
        "page_x0": page("ix0", "r_x0", rw, "px_w"), "page_y0": page("iy0", "r_y0", rh, "px_h"),
        "page_x1": page("ix1", "r_x0", rw, "px_w"), "page_y1": page("iy1", "r_y0", rh, "px_h"),
        "include": include, "ocr_text": F.col("text")})


def label_review_flags(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """Page flags after the review: picture-linework for every page, one
    picture-text per redrawn label, one picture-text-skipped for each of the rest."""
    linework = pages.select(*PAGE, FL.flag(
        "picture-linework", "Walls and lines of this page are a picture and were mirrored as one; lettering in it "
        "that was not confirmed is mirrored too.", "warn").alias("f"))
    plain = T.strip(F.col("text"))
    known = labels.join(pages.select(*PAGE), PAGE, "left_semi")
    changed = F.coalesce((F.col("ocr_text") != "") & (F.col("ocr_text") != plain), F.lit(False))
    redrawn = known.where(F.col("include") & (plain != "")).select(*PAGE, FL.flag("picture-text", F.concat(
        F.lit("'"), plain, F.lit("' was lettering inside the picture; redrawn as text"),
        F.when(changed, F.concat(F.lit(" (read as '"), F.col("ocr_text"), F.lit("')"))).otherwise(""), F.lit(".")),
        "info").alias("f"))
    skipped = known.where(~F.col("include")).select(
        *PAGE, F.when(F.coalesce("ocr_text", F.lit("")) != "", F.col("ocr_text")).otherwise(F.col("text")).alias("shown"))
    left = skipped.select(*PAGE, FL.flag("picture-text-skipped", F.format_string(
        "Left as drawing: '%s'.", F.coalesce("shown", F.lit("")))).alias("f"))
    return linework.unionByName(redrawn).unionByName(left).select(*PAGE, "f.*")
