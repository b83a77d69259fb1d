"""Queries: vector text, drawings, pictures and their labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planloom.functions import geometry as G, text as T
from planloom.operators import labels, vector
from planloom.session import checkpoint_dir, written
from planloom.sources import pdf_tables, truth
from planloom.workload import sqltext as S
from planloom.workload.registry import query

RUN = ["doc_id", "page_index", "run_index"]


def r6(c):
    return F.round(c, 6) + 0.0


def six(*names):
    return F.array(*[F.col(n) for n in names])


def text_matrices(t):
    m = t.matrices
    zero = F.lit(0.0)
    return m.select(*RUN, six("ma", "mb", "mc", "md", "me", "mf").alias("matrix"),
                    F.array("ca", zero, zero, "cd", F.lit(3.0), F.lit(4.0)).alias("ctm"))


AX = "'{axis}'"


def expected_sql(axis: str) -> str:
    """Steps ending in ``expected``; the ctm is (ca, 0, 0, cd, 3, 4)."""
    fx, fy = axis in ("v", "both"), axis in ("h", "both")
    sx, sy = ("-" if fx else ""), ("-" if fy else "")
    dx, dy = S.mirrored_direction("dx", "dy", f"'{axis}'")
    mx = (lambda c: f"(width - {c})" if fx else c)
    my = (lambda c: f"(height - {c})" if fy else c)
    return f"""
tr AS (SELECT *, (lx-sx)*dx + (ly-sy)*dy + GREATEST(0, CASE WHEN ABS(dx) >= ABS(dy) THEN (lw - size*ABS(dy)) / ABS(dx) ELSE (lh - size*ABS(dx)) / ABS(dy) END) AS ext FROM traces),
te AS (SELECT *, sx + dx*ext AS ex, sy + dy*ext AS ey FROM tr),
ej AS (SELECT t.*, m.ma, m.mb, m.mc, m.md, m.me, m.mf, m.ca, m.cd, p.width, p.height, SQRT(POW(ca*ma, 2) + POW(cd*mb, 2)) AS unit,
    SQRT(POW(ca*mc, 2) + POW(cd*md, 2)) AS tall, ({sx}(dx))*{dx} + ({sy}(dy))*{dy} < 0 AS rev, m.doc_id IS NULL AS lone
  FROM te AS t LEFT JOIN matrices AS m USING (doc_id, page_index, run_index) LEFT JOIN plan_pages AS p USING (doc_id, page_index)),
ek AS (SELECT *, SQRT(POW(ex-sx,2) + POW(ey-sy,2)) / unit AS adv, size*(ascender+descender)/unit AS ys FROM ej WHERE NOT lone AND unit >= 1e-9 AND width IS NOT NULL),
expected AS (SELECT doc_id, page_index, run_index, text, ma, mb, mc, md, me, mf, NULL AS error,
  CASE WHEN rev THEN {mx('ex')} ELSE {mx('sx')} + ({sx}(dy)) * ys * tall END AS start_x, CASE WHEN rev THEN {my('ey')} ELSE {my('sy')} + ({sy}(-dx)) * ys * tall END AS start_y,
  CASE WHEN rev THEN {mx('sx')} ELSE {mx('ex')} + ({sx}(dy)) * ys * tall END AS stop_x, CASE WHEN rev THEN {my('sy')} ELSE {my('ey')} + ({sy}(-dx)) * ys * tall END AS stop_y,
  CASE WHEN rev THEN -ma ELSE ma END AS oa, CASE WHEN rev THEN -mb ELSE mb END AS ob, CASE WHEN rev THEN mc ELSE -mc END AS oc, CASE WHEN rev THEN md ELSE -md END AS od,
  CASE WHEN rev THEN me + ma*adv ELSE me + mc*ys END AS oe, CASE WHEN rev THEN mf + mb*adv ELSE mf + md*ys END AS o_f FROM ek
  UNION ALL SELECT doc_id, page_index, run_index, text, ma, mb, mc, md, me, mf, CASE WHEN lone THEN 'glyph run without a text matrix' WHEN width IS NULL THEN 'page size unknown' ELSE 'degenerate text matrix' END,
  NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ej WHERE lone OR unit < 1e-9 OR width IS NULL)"""


OUT_SQL = ", ".join(f"ROUND({c}, 6) + 0.0::DOUBLE AS {c}" for c in ("start_x", "start_y", "stop_x", "stop_y", "oa", "ob", "oc", "od", "oe", "o_f"))


def spread_matrix(df, name="output_matrix", prefix="o"):
    names = [prefix + n if n != "f" else prefix + "_f" for n in "abcdef"]
    return df.withColumns({n: F.col(name)[i] for i, n in enumerate(names)})


for _axis in ("v", "h", "both"):
    def _expected(t, axis=_axis):
        out = vector.expected_transforms(t.traces, text_matrices(t), t.plan_pages, axis)
        return spread_matrix(out).select(*RUN, "error", *[
            r6(F.col(c)).alias(c) for c in ("start_x", "start_y", "stop_x", "stop_y", "oa", "ob", "oc", "od", "oe", "o_f")])
    query(f"expected_transforms_{_axis}",
          f"WITH {expected_sql(_axis).strip()} SELECT doc_id, page_index, run_index, error, {OUT_SQL} FROM expected",
          ("traces", "matrices", "plan_pages"))(_expected)


def drawn(expected):
    """A rendered output: most runs as expected, some off, changed or lost."""
    d = F.when(F.col("run_index") % 13 == 0, 3.0).when(F.col("run_index") % 17 == 0, 0.5).otherwise(0.0)
    ok = expected.where(F.col("error").isNull() & (F.col("run_index") % 101 != 9))
    return ok.select(*RUN, F.when(F.col("run_index") % 61 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"),
                     (F.col("start_x") + d).alias("got_start_x"), F.col("start_y").alias("got_start_y"),
                     (F.col("stop_x") + d).alias("got_stop_x"), F.col("stop_y").alias("got_stop_y"),
                     F.when(F.col("run_index") % 71 == 0, F.transform("output_matrix", lambda v: v + 0.001))
                     .otherwise(F.col("output_matrix")).alias("got_matrix"))


FAILURE = """CASE WHEN run_index % 101 = 9 THEN 'missing run' WHEN run_index % 71 = 0 THEN 'output matrix is not the reflected source matrix'
  WHEN run_index % 61 = 0 THEN 'text changed' WHEN run_index % 13 = 0 THEN 'baseline differs from the reflected source' END"""


@query("verify_transforms", f"WITH {expected_sql('v').strip()} SELECT doc_id, page_index, run_index, {FAILURE} AS failure FROM expected WHERE error IS NULL",
       ("traces", "matrices", "plan_pages"))
def _verify(t):
    exp = vector.expected_transforms(t.traces, text_matrices(t), t.plan_pages, "v").where(F.col("error").isNull())
    return vector.verify_transforms(exp, drawn(exp))


@query("verify_documents", f"""WITH {expected_sql('v').strip()}, f AS (SELECT *, {FAILURE} AS failure FROM expected WHERE error IS NULL)
SELECT doc_id, COUNT(*) AS runs, COUNT(failure) AS failed, FIRST(failure ORDER BY page_index, run_index) FILTER (failure IS NOT NULL) AS first_failure
FROM f GROUP BY doc_id""", ("traces", "matrices", "plan_pages"))
def _verify_docs(t):
    exp = vector.expected_transforms(t.traces, text_matrices(t), t.plan_pages, "v").where(F.col("error").isNull())
    return vector.verify_documents(vector.verify_transforms(exp, drawn(exp)))


@query("calibrate_translations", f"""WITH {expected_sql('h').strip()}, f AS (SELECT * FROM expected WHERE error IS NULL),
n AS (SELECT doc_id, page_index, COUNT(*) AS want, COUNT(*) FILTER (run_index % 101 <> 9) AS got FROM f GROUP BY doc_id, page_index)
SELECT f.doc_id, f.page_index, f.run_index, CASE WHEN want = got AND run_index % 13 = 0 THEN -3.0::DOUBLE ELSE 0.0::DOUBLE END AS de,
  ROUND(oe + CASE WHEN want = got AND run_index % 13 = 0 THEN -3 ELSE 0 END, 6) + 0.0::DOUBLE AS oe FROM f JOIN n USING (doc_id, page_index)""",
       ("traces", "matrices", "plan_pages"))
def _calibrate(t):
    exp = written(vector.expected_transforms(t.traces, text_matrices(t), t.plan_pages, "h").where(F.col("error").isNull()))
    out = spread_matrix(vector.calibrate_translations(exp, drawn(exp), "h"))
    return out.select(*RUN, r6(F.col("de")).alias("de"), r6(F.col("oe")).alias("oe"))


@query("page_reflection", """SELECT doc_id, page_index, ROUND(-1 * (width + 4) + (10 + 10 + width), 6) AS px, ROUND(-1 * 3 + (5 + 5 + height), 6) AS py FROM plan_pages""",
       ("plan_pages",))
def _reflection(t):
    page = G.page_reflection(F.lit(10.0), F.lit(5.0), 10.0 + F.col("width"), 5.0 + F.col("height"), "both")
    at = G.compose(page, G.affine(1.0, 0.0, 0.0, 1.0, F.col("width") + 4.0, 3.0))
    return t.plan_pages.select("doc_id", "page_index", F.round(at[4], 6).alias("px"), F.round(at[5], 6).alias("py"))


@query("translate_runs", """SELECT doc_id, page_index, run_index, me - CASE WHEN run_index % 3 = 0 THEN 2.5::DOUBLE ELSE 0 END AS me,
  mf - CASE WHEN run_index % 3 = 0 THEN 1.5::DOUBLE ELSE 0 END AS mf FROM matrices""", ("matrices",))
def _translate(t):
    nudges = t.traces.where(F.col("run_index") % 3 == 0).select(*RUN, F.lit(2.5).alias("right"), F.lit(1.5).alias("down"))
    out = vector.translate_runs(text_matrices(t), nudges, "v")
    return out.select(*RUN, F.col("matrix")[4].alias("me"), F.col("matrix")[5].alias("mf"))


@query("remove_runs", "SELECT doc_id, page_index, run_index FROM traces WHERE text NOT LIKE '1%'", ("traces",))
def _remove(t):
    return vector.remove_runs(t.traces, t.traces.where(F.col("text").startswith("1"))).select(*RUN)


@query("anchor_points", f"""WITH a AS (SELECT t.*, p.width, p.height, LENGTH(text) * size / 2 AS tw FROM traces AS t JOIN plan_pages AS p USING (doc_id, page_index)),
b AS (SELECT *, width - sx AS ax, sy AS ay, width - (sx + dx*tw) AS bx, sy + dy*tw AS by_, {S.mirrored_direction('dx', 'dy', "'v'")[0]} AS rx, {S.mirrored_direction('dx', 'dy', "'v'")[1]} AS ry FROM a)
SELECT doc_id, page_index, run_index, ROUND(CASE WHEN (bx-ax)*rx + (by_-ay)*ry >= 0 THEN ax ELSE bx END, 6) AS anchor_x,
  ROUND(CASE WHEN (bx-ax)*rx + (by_-ay)*ry >= 0 THEN ay ELSE by_ END, 6) AS anchor_y,
  CAST(((CAST(ROUND_EVEN(-DEGREES(ATAN2(ry, rx)) / 90, 0) AS INT) * 90) % 360 + 360) % 360 AS INT) AS turn FROM b""", ("traces", "plan_pages"))
def _anchor(t):
    spans = t.traces.withColumns({"ox": F.col("sx"), "oy": F.col("sy")}).join(t.plan_pages, ["doc_id", "page_index"])
    out = vector.anchor_points(spans, F.col("width"), F.col("height"), F.length("text") * F.col("size") / 2, "v")
    return out.select(*RUN, F.round("anchor_x", 6).alias("anchor_x"), F.round("anchor_y", 6).alias("anchor_y"), "turn")


@query("font_alias", """SELECT doc_id, page_index, run_index, CASE WHEN run_index % 4 = 0 THEN CASE WHEN b AND i THEN 'cobi' WHEN b THEN 'cobo' WHEN i THEN 'coit' ELSE 'cour' END
  WHEN run_index % 4 IN (1, 2) THEN CASE WHEN b AND i THEN 'tibi' WHEN b THEN 'tibo' WHEN i THEN 'tiit' ELSE 'tiro' END
  ELSE CASE WHEN b AND i THEN 'hebi' WHEN b THEN 'hebo' WHEN i THEN 'heit' ELSE 'helv' END END AS alias
FROM (SELECT *, run_index % 2 = 0 AS b, run_index % 3 = 0 AS i FROM traces)""", ("traces",))
def _alias(t):
    n = F.col("run_index")
    name = (F.when(n % 4 == 0, "RobotoMono").when(n % 4 == 1, "Sans-Serif X").when(n % 4 == 2, "EB Garamond").otherwise("Arial"))
    return t.traces.select(*RUN, T.font_alias(name, n % 2 == 0, n % 3 == 0).alias("alias"))


def occupied(t):
    """Rectangles of the segments, as drawings on page 0."""
    rect = t.segments.select(F.col("sheet_id").alias("doc_id"), F.lit(0).alias("page_index"), F.array(F.struct(
        F.col("width").alias("width"), F.lit(False).alias("fill"), F.lit(None).cast("double").alias("fill_opacity"),
        F.lit(None).cast("double").alias("stroke_opacity"), F.array(
            F.struct(F.lit("l").alias("op"), F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")),
                                                     F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))).alias("pts")),
            F.struct(F.lit("re").alias("op"), F.array(F.struct(F.col("x1").alias("x"), F.col("y0").alias("y")),
                                                      F.struct(F.col("x0").alias("x"), (F.col("y1") + 20).alias("y"))).alias("pts")),
        ).alias("items"))).alias("drawings"))
    return rect


OCC = """occ AS (SELECT sheet_id AS doc_id, 0 AS page_index, 'l' AS op, x0 - 0.5::DOUBLE AS x0, y0 - 0.5::DOUBLE AS y0, x1 + 0.5::DOUBLE AS x1, y1 + 0.5::DOUBLE AS y1 FROM segments
  UNION ALL SELECT sheet_id, 0, 're', x0 - 0.5::DOUBLE, y0 - 0.5::DOUBLE, x1 + 0.5::DOUBLE, y0 + 0.5::DOUBLE FROM segments
  UNION ALL SELECT sheet_id, 0, 're', x1 - 0.5::DOUBLE, y0 - 0.5::DOUBLE, x1 + 0.5::DOUBLE, y0 + 20.5::DOUBLE FROM segments
  UNION ALL SELECT sheet_id, 0, 're', x0 - 0.5::DOUBLE, y0 + 19.5::DOUBLE, x1 + 0.5::DOUBLE, y0 + 20.5::DOUBLE FROM segments
  UNION ALL SELECT sheet_id, 0, 're', x0 - 0.5::DOUBLE, y0 - 0.5::DOUBLE, x0 + 0.5::DOUBLE, y0 + 20.5::DOUBLE FROM segments)"""


@query("flatten_drawings", f"WITH {OCC} SELECT * FROM occ", ("segments",))
def _flatten_drawings(t):
    return pdf_tables.flatten_drawings(occupied(t)).select("doc_id", "page_index", "op", *G.BOX)


@query("mirror_drawings", """SELECT sheet_id AS doc_id, 'l' AS op, 200 - x0 AS ax, y0 AS ay, 200 - x1 AS bx, y1 AS by_, 1.0::DOUBLE AS stroke FROM segments
UNION ALL SELECT sheet_id, 're', 200 - x1, y0, 200 - x0, y1 + 20, 1.0::DOUBLE FROM segments""", ("segments",))
def _mirror_drawings(t):
    pages = occupied(t).withColumns({"width": F.lit(200.0), "height": F.lit(100.0)})
    out = vector.mirror_drawings(pages, "v").select("doc_id", F.explode("drawings").alias("d"))
    out = out.select("doc_id", F.col("d.width").alias("stroke"), F.explode("d.items").alias("i"))
    return out.select("doc_id", F.col("i.op").alias("op"), F.expr("i.pts[0].x").alias("ax"), F.expr("i.pts[0].y").alias("ay"),
                      F.expr("i.pts[1].x").alias("bx"), F.expr("i.pts[1].y").alias("by_"), "stroke")


MEETS = "t.x0 < o.x1 AND o.x0 < t.x1 AND t.y0 < o.y1 AND o.y0 < t.y1"
INK = """win AS (SELECT t.doc_id, t.page_index, t.run_index, p.xref, p.readable, CASE WHEN p.readable THEN p.px_w ELSE 1 END AS w, CASE WHEN p.readable THEN p.px_h ELSE 1 END AS h,
    p.a, p.b, p.c, p.d, p.e, p.f, p.a*p.d - p.b*p.c AS det, GREATEST(t.x0,p.x0) AS hx0, LEAST(t.x1,p.x1) AS hx1, GREATEST(t.y0,p.y0) AS hy0, LEAST(t.y1,p.y1) AS hy1
  FROM traces AS t JOIN page_images AS p ON p.doc_id = t.doc_id AND p.page_index = t.page_index AND t.x0 < p.x1 AND p.x0 < t.x1 AND t.y0 < p.y1 AND p.y0 < t.y1),
wu AS (SELECT *, LEAST((d*(hx0-e)-c*(hy0-f))/det, (d*(hx0-e)-c*(hy1-f))/det, (d*(hx1-e)-c*(hy0-f))/det, (d*(hx1-e)-c*(hy1-f))/det) AS u0,
  GREATEST((d*(hx0-e)-c*(hy0-f))/det, (d*(hx0-e)-c*(hy1-f))/det, (d*(hx1-e)-c*(hy0-f))/det, (d*(hx1-e)-c*(hy1-f))/det) AS u1,
  LEAST((a*(hy0-f)-b*(hx0-e))/det, (a*(hy0-f)-b*(hx1-e))/det, (a*(hy1-f)-b*(hx0-e))/det, (a*(hy1-f)-b*(hx1-e))/det) AS v0,
  GREATEST((a*(hy0-f)-b*(hx0-e))/det, (a*(hy0-f)-b*(hx1-e))/det, (a*(hy1-f)-b*(hx0-e))/det, (a*(hy1-f)-b*(hx1-e))/det) AS v1 FROM win WHERE det <> 0),
wx AS (SELECT *, GREATEST(CAST(TRUNC(u0*w) AS INT), 0) AS wx0, GREATEST(CAST(TRUNC(v0*h) AS INT), 0) AS wy0 FROM wu),
wy AS (SELECT *, LEAST(GREATEST(CEIL(u1*w), wx0+1), w) AS wx1, LEAST(GREATEST(CEIL(v1*h), wy0+1), h) AS wy1 FROM wx WHERE wx0 < w AND wy0 < h),
dark AS (SELECT sheet_id AS doc_id, CAST((x + y) % 60 + 1 AS BIGINT) AS xref, y, x FROM pixels WHERE luma < 128),
ink_hits AS (SELECT DISTINCT doc_id, page_index, run_index FROM wy WHERE NOT readable AND wx1 > wx0 AND wy1 > wy0 UNION
  SELECT DISTINCT wy.doc_id, wy.page_index, wy.run_index FROM wy JOIN dark AS k ON k.doc_id = wy.doc_id AND k.xref = wy.xref AND k.x >= wx0 AND k.x < wx1 AND k.y >= wy0 AND k.y < wy1
  WHERE readable)"""


def ink(t):
    dark = t.pixels.where(F.col("luma") < 128).select(
        F.col("sheet_id").alias("doc_id"), ((F.col("x") + F.col("y")) % 60 + 1).cast("long").alias("xref"), "y", "x")
    return vector.picture_ink_hits(t.traces, t.page_images, dark)


@query("picture_ink_hits", f"WITH {INK} SELECT * FROM ink_hits", ("traces", "page_images", "pixels"))
def _ink(t):
    return ink(t)


@query("text_drawing_overlaps", f"""WITH {OCC}, {INK}
SELECT doc_id, page_index, run_index, page_index + 1 AS page, TRIM(text) AS label FROM traces AS t WHERE TRIM(text) <> '' AND (
  EXISTS (SELECT 1 FROM occ AS o WHERE o.doc_id = t.doc_id AND o.page_index = t.page_index AND {MEETS})
  OR EXISTS (SELECT 1 FROM ink_hits AS i WHERE i.doc_id = t.doc_id AND i.page_index = t.page_index AND i.run_index = t.run_index))""",
       ("traces", "segments", "page_images", "pixels"))
def _overlaps(t):
    return vector.text_drawing_overlaps(t.traces, pdf_tables.flatten_drawings(occupied(t)), ink(t))


@query("selected_overlap", f"""WITH {OCC} SELECT t.doc_id, COALESCE(BOOL_OR(o.doc_id IS NOT NULL), FALSE) AS overlaps FROM traces AS t
LEFT JOIN occ AS o ON o.doc_id = t.doc_id AND o.page_index = t.page_index AND {MEETS} WHERE t.run_index % 4 = 1 GROUP BY t.doc_id""", ("traces", "segments"))
def _selected(t):
    chosen = t.traces.where(F.col("run_index") % 4 == 1)
    return vector.selected_overlap(t.traces, chosen, pdf_tables.flatten_drawings(occupied(t)))


def feature_sql(axis: str, move: str) -> str:
    return f"""p{axis} AS (SELECT g.doc_id, g.page_index, o.run_index, 3*a.i + b.i AS no, g.{move} * g.scale AS moved, g.scale,
  CASE a.i WHEN 0 THEN g{axis}0 WHEN 1 THEN (g{axis}0 + g{axis}1) / 2 ELSE g{axis}1 END AS s, CASE b.i WHEN 0 THEN o.{axis}0 WHEN 1 THEN (o.{axis}0 + o.{axis}1) / 2 ELSE o.{axis}1 END AS tt
  FROM g JOIN traces AS o ON o.doc_id = g.doc_id AND o.page_index = g.page_index AND o.run_index % 3 <> 0 CROSS JOIN (VALUES (0),(1),(2)) AS a(i) CROSS JOIN (VALUES (0),(1),(2)) AS b(i)
  WHERE g.{move} <> 0),
f{axis} AS (SELECT *, tt - (s + moved) AS fix, tt - s AS dist FROM p{axis}),
s{axis} AS (SELECT doc_id, page_index, FIRST(fix / scale ORDER BY ABS(fix), run_index, no) AS fix FROM f{axis} WHERE dist * moved > 0 AND ABS(dist) <= ABS(moved) GROUP BY doc_id, page_index),
d{axis} AS (SELECT doc_id, page_index, FIRST(tt ORDER BY ABS(fix), run_index, no) AS guide FROM f{axis} WHERE ABS(fix) <= 4 * scale GROUP BY doc_id, page_index)"""


@query("snap_nudge", f"""WITH n AS (SELECT doc_id, page_index, CAST(doc_id % 9 - 4 AS DOUBLE) AS "right", CAST(doc_id % 7 - 3 AS DOUBLE) AS down, 2.0::DOUBLE AS scale FROM plan_pages),
g AS (SELECT n.*, gx0, gy0, gx1, gy1 FROM n JOIN (SELECT doc_id, page_index, MIN(x0) AS gx0, MIN(y0) AS gy0, MAX(x1) AS gx1, MAX(y1) AS gy1 FROM traces WHERE run_index % 3 = 0 GROUP BY doc_id, page_index) USING (doc_id, page_index)),
{feature_sql('x', '"right"')}, {feature_sql('y', 'down')}
SELECT n.doc_id, n.page_index, ROUND(n."right" + COALESCE(sx.fix, 0), 6) + 0.0::DOUBLE AS "right", ROUND(n.down + COALESCE(sy.fix, 0), 6) + 0.0::DOUBLE AS down, dx.guide AS guide_x, dy.guide AS guide_y
FROM n LEFT JOIN sx USING (doc_id, page_index) LEFT JOIN sy USING (doc_id, page_index) LEFT JOIN dx USING (doc_id, page_index) LEFT JOIN dy USING (doc_id, page_index)""",
       ("traces", "plan_pages"))
def _snap_nudge(t):
    nudges = t.plan_pages.select("doc_id", "page_index", (F.col("doc_id") % 9 - 4).cast("double").alias("right"),
                                 (F.col("doc_id") % 7 - 3).cast("double").alias("down"), F.lit(2.0).alias("scale"))
    regions = t.traces.select("doc_id", "page_index", F.col("run_index").alias("ord"), *G.BOX, (F.col("run_index") % 3 == 0).alias("selected"))
    return vector.snap_nudge(regions, nudges).select("doc_id", "page_index", r6(F.col("right")).alias("right"),
                                                     r6(F.col("down")).alias("down"), "guide_x", "guide_y")


@query("output_checks", """WITH o AS (SELECT doc_id, page_index FROM plan_pages WHERE NOT (doc_id % 7 = 0 AND page_index = 2)),
ink AS (SELECT DISTINCT sheet_id AS doc_id, CAST(x % 3 AS INT) AS page_index FROM colours WHERE LEAST(b, g, r) < 245),
g AS (SELECT o.doc_id, COUNT(*) AS output_pages, COUNT(*) FILTER (ink.doc_id IS NULL) AS blank_pages FROM o LEFT JOIN ink ON ink.doc_id = o.doc_id AND ink.page_index = o.page_index GROUP BY o.doc_id)
SELECT doc_id, source_pages, COALESCE(output_pages, 0) AS output_pages, COALESCE(blank_pages, 0) AS blank_pages, source_pages = COALESCE(output_pages, 0) AS same_count, COALESCE(blank_pages, 0) > 0 AS fallback
FROM (SELECT doc_id, COUNT(*) AS source_pages FROM plan_pages GROUP BY doc_id) LEFT JOIN g USING (doc_id)""", ("plan_pages", "colours"))
def _output_checks(t):
    out = t.plan_pages.where(~((F.col("doc_id") % 7 == 0) & (F.col("page_index") == 2)))
    px = t.colours.withColumns({"doc_id": F.col("sheet_id"), "page_index": (F.col("x") % 3).cast("int")})
    return vector.output_checks(t.plan_pages, out, vector.inked_pages(px))


@query("check_placements", """WITH p AS (SELECT *, CASE WHEN xref <= 0 THEN 'inline picture' WHEN ABS(b) > 1e-6 OR ABS(c) > 1e-6 OR a <= 0 OR d <= 0 THEN 'rotated or flipped picture'
  WHEN ROW_NUMBER() OVER (PARTITION BY doc_id, xref ORDER BY page_index, img_no) > 1 THEN 'picture placed more than once' END AS why FROM page_images)
SELECT doc_id, FIRST(page_index ORDER BY page_index, img_no) + 1 AS page, FIRST(why ORDER BY page_index, img_no) AS reason FROM p WHERE why IS NOT NULL GROUP BY doc_id""", ("page_images",))
def _placements(t):
    return labels.check_placements(t.page_images)[1]


LABELS = """pl AS (SELECT doc_id, xref, ANY_VALUE(page_index) AS page_index, ANY_VALUE(x0) AS rx0, ANY_VALUE(y0) AS ry0, ANY_VALUE(x1) AS rx1, ANY_VALUE(y1) AS ry1, ANY_VALUE(px_w) AS px_w, ANY_VALUE(px_h) AS px_h
  FROM page_images WHERE xref > 0 GROUP BY doc_id, xref HAVING COUNT(*) = 1),
pd AS (SELECT d.sheet_id AS doc_id, l.xref, d.det_idx, d.text, d.conf, d.angle_deg, d.x0, d.y0, d.x1, d.y1, pl.page_index, rx0, ry0, rx1, ry1, px_w, px_h,
    GREATEST(1, CEIL(300 / GREATEST(px_w / GREATEST((rx1-rx0) / 72, 1e-6), 1) - 1e-6)) AS k
  FROM detections AS d JOIN (SELECT doc_id, MIN(xref) AS xref FROM pl GROUP BY doc_id) AS l ON l.doc_id = d.sheet_id JOIN pl ON pl.doc_id = l.doc_id AND pl.xref = l.xref),
cand AS (SELECT *, GREATEST(CAST(TRUNC(x0/k) AS INT), 0) AS ix0, GREATEST(CAST(TRUNC(y0/k) AS INT), 0) AS iy0, LEAST(CAST(CEIL(x1/k) AS INT), px_w) AS ix1, LEAST(CAST(CEIL(y1/k) AS INT), px_h) AS iy1,
  conf >= 0.9::DOUBLE AND angle_deg IN (0, 90, -90) AS include FROM pd)"""


def single_pictures(t):
    p = t.page_images.where(F.col("xref") > 0)
    return p.join(p.groupBy("doc_id", "xref").count().where("count = 1").drop("count"), ["doc_id", "xref"])


def label_candidates(t):
    p = single_pictures(t)
    first = p.groupBy("doc_id").agg(F.min("xref").alias("xref"))
    dets = t.detections.withColumnRenamed("sheet_id", "doc_id").join(first, "doc_id")
    return labels.picture_label_candidates(dets, p)


@query("picture_label_candidates", f"""WITH {LABELS} SELECT doc_id, det_idx, page_index, include, ix0, iy0, ix1, iy1,
  ROUND(rx0 + ix0 * (rx1-rx0) / px_w, 6) AS page_x0, ROUND(ry0 + iy1 * (ry1-ry0) / px_h, 6) AS page_y1 FROM cand""", ("detections", "page_images"))
def _labels(t):
    return label_candidates(t).select("doc_id", "det_idx", "page_index", "include", "ix0", "iy0", "ix1", "iy1",
                                      F.round("page_x0", 6).alias("page_x0"), F.round("page_y1", 6).alias("page_y1"))


@query("label_review_flags", f"""WITH {LABELS},
k AS (SELECT c.* FROM cand AS c JOIN plan_pages AS p ON p.doc_id = c.doc_id AND p.page_index = c.page_index)
SELECT doc_id, page_index, 'picture-linework' AS code, 'warn' AS severity, NULL AS skipped FROM plan_pages
UNION ALL SELECT doc_id, page_index, 'picture-text', 'info', NULL FROM k WHERE include
UNION ALL SELECT k.doc_id, k.page_index, 'picture-text-skipped', 'info', CONCAT('Left as drawing: ', CHR(39), d.text, CHR(39), '.') FROM k
  JOIN detections AS d ON d.sheet_id = k.doc_id AND d.det_idx = k.det_idx WHERE NOT include""",
       ("detections", "page_images", "plan_pages"))
def _review(t):
    out = labels.label_review_flags(label_candidates(t), t.plan_pages)
    skipped = F.when(F.col("code") == "picture-text-skipped", F.col("message"))
    return out.select("doc_id", "page_index", "code", "severity", skipped.alias("skipped"))


def span_pages(t):
    """Nested page records: one text block per sheet, and one picture block."""
    span = F.struct("text", F.struct(*G.BOX).alias("bbox"), F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")).alias("origin"),
                    "size", (F.col("run_index") % 16777216).cast("int").alias("color"), F.lit("Arial").alias("font"),
                    (F.col("run_index") % 32).cast("int").alias("flags"))
    line = F.struct(F.struct("dx", "dy").alias("dir"), F.array(span).alias("spans"))
    block = F.struct((F.col("run_index") % 6 == 0).cast("int").alias("type"), F.array(line).alias("lines"))
    return t.traces.withColumn("text", F.when(F.col("run_index") % 8 == 0, "  ").otherwise(F.col("text"))).select(
        "doc_id", "page_index", "run_index", F.array(block).alias("blocks"))


@query("flatten_spans", """SELECT doc_id, page_index, run_index, text, x0, y1, size, dx, ROUND(((run_index % 16777216) // 65536) / 255, 9) AS red,
  ROUND(((run_index % 16777216) // 256 % 256) / 255, 9) AS green, ROUND((run_index % 256) / 255, 9) AS blue, (run_index % 32) // 16 = 1 AS bold, (run_index % 4) // 2 = 1 AS italic
FROM traces WHERE run_index % 6 <> 0 AND run_index % 8 <> 0""", ("traces",))
def _spans(t):
    out = pdf_tables.flatten_spans(span_pages(t))
    return out.select(*RUN, "text", "x0", "y1", "size", "dx", *[F.round(c, 9).alias(c) for c in ("red", "green", "blue")], "bold", "italic")


@query("build_truth", """SELECT doc_id, page_index, run_index, text, ROUND_EVEN(x0 * 2.5::DOUBLE, 2) AS x0, ROUND_EVEN(y1 * 2.5::DOUBLE, 2) AS y1, CASE WHEN ABS(dx) > ABS(dy) THEN 0.0::DOUBLE ELSE 90.0::DOUBLE END AS angle_deg,
  COALESCE(k.kind, 'unknown') AS kind, ROUND_EVEN((y1 - y0) * 2.5::DOUBLE * 0.72::DOUBLE, 1) AS cap_height_px
FROM traces AS t LEFT JOIN (SELECT l.text AS word, FIRST(l.kind ORDER BY l.run_id) AS kind FROM runs AS l WHERE l.kind <> 'annotation' GROUP BY l.text) AS k ON k.word = t.text
WHERE run_index % 6 <> 0 AND run_index % 8 <> 0""", ("traces", "runs"))
def _build_truth(t):
    places = t.runs.where(F.col("kind") != "annotation").select(F.col("run_id").alias("ord"), "text", "kind")
    out = truth.build_truth(pdf_tables.flatten_spans(span_pages(t)), places, 2.5)
    return out.select(*RUN, "text", "x0", "y1", "angle_deg", "kind", "cap_height_px")


@query("read_truth", """SELECT CAST(sheet_id AS VARCHAR) AS image, ROW_NUMBER() OVER (PARTITION BY sheet_id ORDER BY truth_idx) - 1 AS truth_idx, text, x0, y0, x1, y1, angle_deg, kind,
  y1 - y0 AS cap_height_px FROM truth WHERE sheet_id IN (SELECT sheet_id FROM sheets)""", ("truth", "sheets"))
def _read_truth(t):
    """All truth written sheet by sheet and read back."""
    sheets = t.sheets.select("sheet_id", F.col("sheet_id").cast("string").alias("image"), F.lit(150).alias("dpi"), F.lit(2.5).alias("zoom"),
                             F.col("width").cast("int").alias("width_px"), F.col("height").cast("int").alias("height_px"))
    runs = t.truth.withColumn("cap_height_px", F.col("y1") - F.col("y0"))
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/truth-{uuid.uuid4().hex}"
    truth.write_truth(truth.truth_payload(runs, sheets), folder)
    return truth.read_truth(t.spark, folder, one_per_file=False).select(
        "image", "truth_idx", "text", *G.BOX, "angle_deg", "kind", "cap_height_px")


@query("flatten_traces", """SELECT sheet_id AS doc_id, COUNT(*) AS runs, MIN(text) AS lo, MAX(text) AS hi, SUM(x0) AS sx FROM detections WHERE det_idx % 3 <> 0 GROUP BY sheet_id""", ("detections",))
def _flatten_traces(t):
    box = F.struct(*G.BOX)
    chars = F.transform(F.split("text", ""), lambda c: F.struct(
        F.ascii(c).alias("cp"), F.struct(F.col("x0").alias("x"), F.col("y1").alias("y")).alias("origin"), box.alias("bbox")))
    trace = F.struct((F.col("det_idx") % 3 == 0).cast("int").alias("type"), chars.alias("chars"),
                     F.struct(F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy")).alias("dir"), F.lit(9.0).alias("size"),
                     F.lit(0.9).alias("ascender"), F.lit(-0.2).alias("descender"), box.alias("bbox"))
    pages = t.detections.select(F.col("sheet_id").alias("doc_id"), F.lit(0).alias("page_index"), F.array(trace).alias("traces"))
    return pdf_tables.flatten_traces(pages).groupBy("doc_id").agg(
        F.count("*").alias("runs"), F.min("text").alias("lo"), F.max("text").alias("hi"), F.sum("x0").alias("sx"))
