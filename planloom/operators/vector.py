"""Vector text and drawings: reflection, checks, overlaps, nudges.

Tables are keyed by (doc_id, page_index, run_index). Matrices are ARRAY<DOUBLE>
of six numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import geometry as G, text as T
from planloom.operators.match import prefixed
from planloom.operators.spatial import CELL, box_pairs, boxes_hit, levels_of
from planloom.session import written

PAGE = ["doc_id", "page_index"]
RUN = ["doc_id", "page_index", "run_index"]


def mirror_drawings(pages: DataFrame, axis) -> DataFrame:
    """Reflected path items. Stroke width: none = 1, zero = hairline 0.1;
    opacities default to 1; unknown operators are left out."""
    w, h = F.col("width"), F.col("height")

    def reflect(i):
        pts = F.transform(i["pts"], lambda p: F.struct(G.mirror_x(p["x"], w, axis).alias("x"),
                                                       G.mirror_y(p["y"], h, axis).alias("y")))
        xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
        corners = F.array(F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y")),
                          F.struct(F.array_max(xs).alias("x"), F.array_max(ys).alias("y")))
        return F.struct(i["op"].alias("op"), F.when(i["op"] == "re", corners).otherwise(pts).alias("pts"))

    def redraw(d):
        known = F.filter(d["items"], lambda i: i["op"].isin("l", "re", "c", "qu"))
        width = F.when(d["width"].isNull(), 1.0).when(d["width"] == 0, 0.1).otherwise(d["width"])
        return F.struct(width.alias("width"), d["fill"].alias("fill"),
                        F.coalesce(d["fill_opacity"], F.lit(1.0)).alias("fill_opacity"),
                        F.coalesce(d["stroke_opacity"], F.lit(1.0)).alias("stroke_opacity"),
                        F.transform(known, reflect).alias("items"))

    return pages.withColumn("drawings", F.transform("drawings", redraw))


def trace_end() -> tuple[Column, Column]:
    """Far end of a run's baseline from the hull of its last glyph."""
    dx, dy = F.col("dx"), F.col("dy")
    cos, sin = F.abs(dx), F.abs(dy)
    advance = F.when(cos >= sin, (F.col("lw") - F.col("size") * sin) / F.nullif(cos, F.lit(0.0))).otherwise(
        (F.col("lh") - F.col("size") * cos) / F.nullif(sin, F.lit(0.0)))
    extent = ((F.col("lx") - F.col("sx")) * dx + (F.col("ly") - F.col("sy")) * dy
              + F.greatest(advance, F.lit(0.0)))
    return F.col("sx") + dx * extent, F.col("sy") + dy * extent


def expected_transforms(traces: DataFrame, matrices: DataFrame, pages: DataFrame, axis) -> DataFrame:
    """Where every run must start and end on the reflected page, and its matrix.

    ``matrices`` has matrix and ctm per run, ``pages`` width and height. A run
    without a partner on the other side, or with a degenerate matrix, gets an
    ``error`` instead.
    """
    ex, ey = trace_end()
    work = traces.withColumns({"end_x": ex, "end_y": ey, "has_trace": F.lit(True)})
    work = work.join(matrices.withColumn("has_matrix", F.lit(True)), RUN, "full").join(
        pages.select(*PAGE, "width", "height"), PAGE, "left")
    work = work.withColumn("to_page", G.compose(F.col("ctm"), F.col("matrix")))
    unit = F.hypot(F.col("to_page")[0], F.col("to_page")[1])
    work = work.withColumn("unit", unit)
    error = (F.when(F.col("has_trace").isNull(), "text matrix without a glyph run")
             .when(F.col("has_matrix").isNull(), "glyph run without a text matrix")
             .when(F.col("width").isNull() | F.col("height").isNull(), "page size unknown")
             .when(F.col("unit") < 1e-9, "degenerate text matrix"))
    work = work.withColumn("error", error)
    dx, dy = F.col("dx"), F.col("dy")
    raw_dx, raw_dy = G.mirror_raw_direction(dx, dy, axis)
    out_dx, out_dy = G.mirror_direction(dx, dy, axis)
    work = work.withColumn("reverse", raw_dx * out_dx + raw_dy * out_dy < 0)
    size = F.nullif(F.col("unit"), F.lit(0.0))
    work = work.withColumns({
        "advance": F.hypot(F.col("end_x") - F.col("sx"), F.col("end_y") - F.col("sy")) / size,
        "y_shift": F.col("size") * (F.col("ascender") + F.col("descender")) / size,
        "rsx": G.mirror_x(F.col("sx"), "width", axis), "rsy": G.mirror_y(F.col("sy"), "height", axis),
        "rex": G.mirror_x(F.col("end_x"), "width", axis), "rey": G.mirror_y(F.col("end_y"), "height", axis)})
    shift = F.col("y_shift") * F.hypot(F.col("to_page")[2], F.col("to_page")[3])
    up_x, up_y = G.mirror_raw_direction(dy, -dx, axis)
    back = F.col("reverse")
    matrix = G.reflect_text_matrix(F.col("matrix"), back, F.col("advance"), F.col("y_shift"))
    ok = F.col("error").isNull()

    def when_ok(c):
        return F.when(ok, c)

    return work.select(
        *RUN, "text", "error",
        when_ok(F.when(back, F.col("rex")).otherwise(F.col("rsx") + up_x * shift)).alias("start_x"),
        when_ok(F.when(back, F.col("rey")).otherwise(F.col("rsy") + up_y * shift)).alias("start_y"),
        when_ok(F.when(back, F.col("rsx")).otherwise(F.col("rex") + up_x * shift)).alias("stop_x"),
        when_ok(F.when(back, F.col("rsy")).otherwise(F.col("rey") + up_y * shift)).alias("stop_y"),
        F.col("matrix").alias("source_matrix"), when_ok(matrix).alias("output_matrix"))


def _joined(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``actual`` has text, got_start_x/y, got_stop_x/y and got_matrix per run."""
    return expected.withColumn("want", F.lit(True)).join(
        actual.withColumnRenamed("text", "got_text").withColumn("got", F.lit(True)), RUN, "full")


def _gap(a: str, b: str) -> Column:
    return F.hypot(F.col(f"{a}_x") - F.col(f"{b}_x"), F.col(f"{a}_y") - F.col(f"{b}_y"))


def calibrate_translations(expected: DataFrame, actual: DataFrame, axis) -> DataFrame:
    """Shift output matrices by the measured error of the rendered page.

    Pages whose run counts differ are left alone; errors within 0.75 pt count
    as none. The shift is the mean of both end errors, turned back through the
    axis. ``expected`` rows come back with their output_matrix adjusted.
    """
    counts = (expected.select(*PAGE, F.lit(1).alias("n")).unionByName(actual.select(*PAGE, F.lit(-1).alias("n")))
              .groupBy(*PAGE).agg(F.sum("n").alias("n")).where("n <> 0").select(*PAGE))
    # named run by run, the rows need not be spread anew by page
    uneven = expected.select(*RUN).join(counts, PAGE, "left_semi").distinct().withColumn("uneven", F.lit(True))
    work = expected.join(actual.select(
        *RUN, "got_start_x", "got_start_y", "got_stop_x", "got_stop_y", F.lit(True).alias("got")), RUN, "left").join(uneven, RUN, "left")
    off = F.greatest(_gap("got_start", "start"), _gap("got_stop", "stop")) > K.TRANSFORM_TOLERANCE_PT
    use = F.col("uneven").isNull() & F.col("got").isNotNull() & off
    cx = (F.col("start_x") - F.col("got_start_x") + F.col("stop_x") - F.col("got_stop_x")) / 2
    cy = (F.col("start_y") - F.col("got_start_y") + F.col("stop_y") - F.col("got_stop_y")) / 2
    # page space has y up: the unflipped axis turns the sign of y
    fx, fy = G.flips(axis)
    zero = F.lit(0.0)
    de = F.when(use, F.when(fx, -cx).otherwise(cx)).otherwise(zero)
    df = F.when(use, F.when(fy, -cy).otherwise(cy)).otherwise(zero)
    m = F.col("output_matrix")
    return (work.withColumns({"de": F.coalesce(de, zero), "df": F.coalesce(df, zero)})
            .withColumn("output_matrix", G.affine(m[0], m[1], m[2], m[3], m[4] + F.col("de"), m[5] + F.col("df")))
            .select(*expected.columns, "de", "df"))


def verify_transforms(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per run with the reason of its failure (NULL = as expected)."""
    far = F.array_max(F.transform(F.arrays_zip(F.col("output_matrix").alias("a"), F.col("got_matrix").alias("b")),
                                  lambda p: F.abs(p["a"] - p["b"])))
    ends = F.greatest(_gap("got_start", "start"), _gap("got_stop", "stop"))
    reason = (F.when(F.col("want").isNull(), "unexpected run")
              .when(F.col("got").isNull(), "missing run")
              .when(far > K.MATRIX_TOLERANCE, "output matrix is not the reflected source matrix")
              .when(~F.col("text").eqNullSafe(F.col("got_text")), "text changed")
              .when(ends > K.TRANSFORM_TOLERANCE_PT, "baseline differs from the reflected source"))
    return _joined(expected, actual).select(*RUN, reason.alias("failure"))


def verify_documents(checks: DataFrame) -> DataFrame:
    """Per document: failed runs and the first failure in page and run order."""
    return checks.groupBy("doc_id").agg(
        F.count("*").alias("runs"), F.count("failure").alias("failed"),
        F.min_by("failure", F.when(F.col("failure").isNotNull(), F.struct("page_index", "run_index")))
        .alias("first_failure"))


def anchor_points(spans: DataFrame, width: Column, height: Column, text_width: Column, axis) -> DataFrame:
    """Start of the reflected baseline: the other end if it would run backwards."""
    dx, dy = F.col("dx"), F.col("dy")
    ox, oy = F.col("ox"), F.col("oy")
    sx, sy = G.mirror_x(ox, width, axis), G.mirror_y(oy, height, axis)
    ex = G.mirror_x(ox + dx * text_width, width, axis)
    ey = G.mirror_y(oy + dy * text_width, height, axis)
    rx, ry = G.mirror_direction(dx, dy, axis)
    ahead = (ex - sx) * rx + (ey - sy) * ry >= 0
    turn = G.quarter_turn(rx, ry)
    return spans.withColumns({
        "anchor_x": F.when(ahead, sx).otherwise(ex), "anchor_y": F.when(ahead, sy).otherwise(ey),
        "turn": turn["turn"], "deviation": turn["deviation"]})


def remove_runs(traces: DataFrame, removals: DataFrame) -> DataFrame:
    return traces.join(removals.select(*RUN).distinct(), RUN, "left_anti")


def translate_runs(matrices: DataFrame, nudges: DataFrame, axis) -> DataFrame:
    """Add a screen nudge (right, down) to the translation of text matrices."""
    fx, fy = G.flips(axis)
    m = F.col("matrix")
    right, down = F.coalesce("right", F.lit(0.0)), F.coalesce("down", F.lit(0.0))
    moved = G.affine(m[0], m[1], m[2], m[3], m[4] + F.when(fx, -right).otherwise(right),
                     m[5] + F.when(fy, down).otherwise(-down))
    return (matrices.join(nudges.select(*RUN, "right", "down"), RUN, "left")
            .withColumn("matrix", moved).drop("right", "down"))


# --- overlaps ------------------------------------------------------------------------

def picture_ink_hits(traces: DataFrame, pictures: DataFrame, dark: DataFrame, cell: float = CELL) -> DataFrame:
    """Distinct runs whose box covers dark picture pixels.

    ``pictures``: doc_id, page_index, xref, box, a..f (unit square to page),
    px_w, px_h, readable. ``dark``: doc_id, xref, y, x of pixels below 128.
    An unreadable picture counts as fully dark, a singular one is skipped.
    """
    pics = prefixed(pictures, "p_", PAGE)
    pairs = box_pairs(traces.select(*RUN, *G.BOX), pics, PAGE, ["p_" + c for c in G.BOX], cell=cell)
    a, b, c, d, e, f = (F.col("p_" + n) for n in "abcdef")
    det = a * d - b * c
    hx = (F.greatest("x0", "p_x0"), F.least("x1", "p_x1"))
    hy = (F.greatest("y0", "p_y0"), F.least("y1", "p_y1"))
    us = [(d * (x - e) - c * (y - f)) / det for x in hx for y in hy]
    vs = [(a * (y - f) - b * (x - e)) / det for x in hx for y in hy]
    w = F.when(F.col("p_readable"), F.col("p_px_w")).otherwise(1)
    h = F.when(F.col("p_readable"), F.col("p_px_h")).otherwise(1)
    win = pairs.where(det != 0).withColumns({"_w": w, "_h": h})
    win = win.withColumns({
        "wx0": F.greatest((F.least(*us) * F.col("_w")).cast("long"), F.lit(0)),
        "wy0": F.greatest((F.least(*vs) * F.col("_h")).cast("long"), F.lit(0)),
        "ux": F.ceil(F.greatest(*us) * F.col("_w")), "uy": F.ceil(F.greatest(*vs) * F.col("_h"))})
    win = win.withColumns({"wx1": F.least(F.greatest(F.col("ux"), F.col("wx0") + 1), F.col("_w")) - 1,
                           "wy1": F.least(F.greatest(F.col("uy"), F.col("wy0") + 1), F.col("_h")) - 1})
    win = win.where((F.col("wx0") < F.col("_w")) & (F.col("wy0") < F.col("_h"))
                    & (F.col("wx1") >= F.col("wx0")) & (F.col("wy1") >= F.col("wy0")))
    # their size classes are looked at before they are joined; points have none
    win = written(win.select(*RUN, "p_xref", "p_readable", "wx0", "wy0", "wx1", "wy1"))
    solid = win.where(~F.col("p_readable")).select(*RUN)
    asked = win.where("p_readable").select(*RUN, F.col("p_xref").alias("xref"), "wx0", "wy0", "wx1", "wy1")
    window = ("wx0", "wy0", "wx1", "wy1")
    spots = dark.select("doc_id", "xref", F.col("x").alias("d_x"), F.col("y").alias("d_y"),
                        F.col("x").alias("d_x1"), F.col("y").alias("d_y1"))
    hits = boxes_hit(asked, spots, ["doc_id", "xref"], RUN, ("d_x", "d_y", "d_x1", "d_y1"),
                     window, closed=True, cell=cell, levels=(levels_of(asked, window, cell), []))
    return solid.unionByName(hits).distinct()


def text_drawing_overlaps(traces: DataFrame, occupied: DataFrame, ink_hits: DataFrame | None = None,
                          cell: float = CELL) -> DataFrame:
    """Runs whose box meets drawn rectangles or picture ink; blanks left out."""
    rects = prefixed(occupied.select(*PAGE, *G.BOX), "o_", PAGE)
    hits = boxes_hit(traces, rects, PAGE, RUN, ["o_" + c for c in G.BOX], cell=cell)
    if ink_hits is not None:
        hits = hits.unionByName(ink_hits.select(*RUN)).distinct()
    return (traces.join(hits, RUN, "left_semi").withColumn("label", T.strip(F.col("text")))
            .where(F.col("label") != "")
            .select(*RUN, (F.col("page_index") + 1).alias("page"), "label"))


def selected_overlap(traces: DataFrame, selected: DataFrame, occupied: DataFrame,
                     ink_hits: DataFrame | None = None, cell: float = CELL) -> DataFrame:
    """(doc_id, overlaps): does any selected run meet the drawing?"""
    chosen = traces.join(selected.select(*RUN).distinct(), RUN, "left_semi")
    rects = prefixed(occupied.select(*PAGE, *G.BOX), "o_", PAGE)
    hits = boxes_hit(chosen, rects, PAGE, RUN, ["o_" + c for c in G.BOX], cell=cell)
    if ink_hits is not None:
        hits = hits.unionByName(ink_hits.join(selected.select(*RUN).distinct(), RUN, "left_semi").select(*RUN))
    found = hits.select("doc_id").distinct().withColumn("hit", F.lit(True))
    return (selected.select("doc_id").distinct().join(found, "doc_id", "left")
            .select("doc_id", F.coalesce("hit", F.lit(False)).alias("overlaps")))


def snap_nudge(regions: DataFrame, nudges: DataFrame) -> DataFrame:
    """Snap a proposed move of the selected runs of a page to aligned edges.

    ``regions``: page key, ord, box (pixels), selected. ``nudges``: page key,
    right, down (points), scale (pixels per point). Left, middle and right (top,
    middle, bottom) of the selection meet those of every other run; the
    smallest correction within 4 pt is the guide, and the smallest one that
    lies ahead within the move is taken.
    """
    group = regions.where("selected").groupBy(*PAGE).agg(
        F.min("x0").alias("gx0"), F.min("y0").alias("gy0"), F.max("x1").alias("gx1"), F.max("y1").alias("gy1"))
    base = nudges.where(F.col("scale") > 0).join(group, PAGE)
    others = regions.where(~F.col("selected")).select(*PAGE, "ord", *G.BOX).join(base, PAGE)
    out = nudges
    for axis, move in (("x", "right"), ("y", "down")):
        lo, hi = F.col(f"{axis}0"), F.col(f"{axis}1")
        glo, ghi = F.col(f"g{axis}0"), F.col(f"g{axis}1")
        combos = F.array(*[F.struct(F.lit(3 * i + j).alias("no"), s.alias("s"), t.alias("t"))
                           for i, s in enumerate((glo, (glo + ghi) / 2, ghi))
                           for j, t in enumerate((lo, (lo + hi) / 2, hi))])
        moved = F.col(move) * F.col("scale")
        pairs = others.where(F.col(move) != 0).select(
            *PAGE, "ord", "scale", moved.alias("moved"), F.inline(combos))
        fix = F.col("t") - (F.col("s") + F.col("moved"))
        dist = F.col("t") - F.col("s")
        rank = F.struct(F.abs("fix").alias("g"), F.col("ord"), F.col("no"))
        pairs = pairs.withColumns({"fix": fix, "dist": dist})
        ahead = (F.col("dist") * F.col("moved") > 0) & (F.abs("dist") <= F.abs("moved"))
        near = F.abs("fix") <= K.SNAP_TOLERANCE_PT * F.col("scale")
        best = pairs.groupBy(*PAGE).agg(
            F.min_by(F.col("fix") / F.col("scale"), F.when(ahead, rank)).alias(f"_snap_{axis}"),
            F.min_by("t", F.when(near, rank)).alias(f"guide_{axis}"))
        out = (out.join(best, PAGE, "left")
               .withColumn(move, F.col(move) + F.coalesce(f"_snap_{axis}", F.lit(0.0))).drop(f"_snap_{axis}"))
    return out


def output_checks(source_pages: DataFrame, output_pages: DataFrame, inked: DataFrame) -> DataFrame:
    """Per document: same page count? blank pages? fall back to a picture?

    ``inked`` lists output pages (doc_id, page_index) with any ink.
    """
    want = source_pages.groupBy("doc_id").agg(F.count("*").alias("source_pages"))
    seen = output_pages.select(*PAGE).join(inked.select(*PAGE).distinct().withColumn("ink", F.lit(True)), PAGE, "left")
    got = seen.groupBy("doc_id").agg(F.count("*").alias("output_pages"),
                                     F.count_if(F.col("ink").isNull()).alias("blank_pages"))
    out = want.join(got, "doc_id", "left").fillna(0, ["output_pages", "blank_pages"])
    return out.withColumns({"same_count": F.col("source_pages") == F.col("output_pages"),
                            "fallback": F.col("blank_pages") > 0})


def inked_pages(pixels: DataFrame) -> DataFrame:
    """Pages with a pixel whose darkest channel is below 245."""
    return (pixels.where(F.least("b", "g", "r") < K.INK_CHANNEL_LIMIT).select(*PAGE).distinct())
