"""Queries: geometry, vocabulary, triage and the checks around detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import geometry as G, text as T
from planloom.operators import detect, match, merge, score, vocab
from planloom.session import written
from planloom.workload import sqltext as S
from planloom.workload.q_match import MERGE_STEPS
from planloom.workload.registry import query

def axis_of_sheet():
    return F.expr(S.AXIS_OF_SHEET)

ID = ["sheet_id", "det_idx"]


def r6(c):
    return F.round(c, 6) + 0.0


def with_quads(dets):
    """Detections as slightly tilted quads."""
    s = (F.col("det_idx") % 7 - 3).cast("double")

    def p(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    x0, y0, x1, y1 = G.box_of()
    return dets.withColumn("quad", F.array(p(x0, y0), p(x1, y0 + s), p(x1 - s, y1 + s), p(x0 - s, y1)))


QUAD = """quads AS (SELECT *, s, x0 AS px0, y0 AS py0, x1 AS px1, y0 + s AS py1, x1 - s AS px2, y1 + s AS py2, x0 - s AS px3, y1 AS py3
  FROM (SELECT *, CAST(det_idx % 7 - 3 AS DOUBLE) AS s FROM detections))"""


@query("bbox_center", f"""WITH {QUAD}
SELECT sheet_id, det_idx, bx0, by0, bx1, by1, (bx0+bx1)/2 AS cx, (by0+by1)/2 AS cy FROM (
SELECT sheet_id, det_idx, LEAST(px0,px1,px2,px3) AS bx0, LEAST(py0,py1,py2,py3) AS by0,
  GREATEST(px0,px1,px2,px3) AS bx1, GREATEST(py0,py1,py2,py3) AS by1 FROM quads)""", ("detections",))
def _bbox(t):
    out = detect.with_center(detect.with_bbox(with_quads(t.detections)))
    return out.select(*ID, *[F.col(c).alias("b" + c) for c in G.BOX], "cx", "cy")


@query("mirror_boxes", f"""WITH m AS (SELECT d.*, s.width, s.height, {S.AXIS_OF_SHEET.replace('sheet_id', 'd.sheet_id')} AS axis
  FROM detections AS d JOIN sheets AS s ON s.sheet_id = d.sheet_id)
SELECT sheet_id, det_idx, {S.mirrored_box('m', 'width', 'height', 'axis')} FROM m""", ("detections", "sheets"))
def _mirror_boxes(t):
    joined = t.detections.join(t.sheets, "sheet_id")
    box = G.mirror_box(G.box_of(), "width", "height", axis_of_sheet())
    return joined.select(*ID, *[b.alias(n) for b, n in zip(box, G.BOX)])


@query("mirror_points", f"""WITH m AS (SELECT d.*, s.width, s.height, {S.AXIS_OF_SHEET.replace('sheet_id', 'd.sheet_id')} AS axis
  FROM detections AS d JOIN sheets AS s ON s.sheet_id = d.sheet_id)
SELECT sheet_id, det_idx, CASE WHEN axis IN ('v','both') THEN width - x0 ELSE x0 END AS mx,
  CASE WHEN axis IN ('h','both') THEN height - y0 ELSE y0 END AS my FROM m""", ("detections", "sheets"))
def _mirror_points(t):
    return t.detections.join(t.sheets, "sheet_id").select(
        *ID, G.mirror_x(F.col("x0"), "width", axis_of_sheet()).alias("mx"),
        G.mirror_y(F.col("y0"), "height", axis_of_sheet()).alias("my"))


@query("mirror_angles", f"""SELECT sheet_id, det_idx, {S.mirrored_angle('angle_deg', f'({S.AXIS_OF_SHEET})')} AS angle_out FROM tilts""",
       ("tilts",))
def _mirror_angles(t):
    return t.tilts.select(*ID, r6(G.mirror_angle(F.col("angle_deg"), axis_of_sheet())).alias("angle_out"))


@query("mirror_truth", f"""WITH m AS (SELECT t.*, s.width, s.height FROM truth AS t JOIN sheets AS s ON s.sheet_id = t.sheet_id)
SELECT sheet_id, truth_idx, text, {S.mirrored_box('m', 'width', 'height', "'v'")}, {S.mirrored_angle('angle_deg', "'v'")} AS angle_deg FROM m""",
       ("truth", "sheets"))
def _mirror_truth(t):
    out = score.mirror_truth(t.truth.join(t.sheets, "sheet_id"), "width", "height", "v")
    return out.select("sheet_id", "truth_idx", "text", *G.BOX, r6(F.col("angle_deg")).alias("angle_deg"))


@query("mirror_twice", "SELECT sheet_id, det_idx, x0, y0, x1, y1 FROM detections", ("detections",))
def _mirror_twice(t):
    out = t.detections
    for _ in range(2):
        out = out.withColumns(dict(zip(G.BOX, G.mirror_box(G.box_of(), F.lit(256.0), F.lit(128.0), "both"))))
    return out.select(*ID, *G.BOX)


@query("unrotate_quads", f"""WITH {QUAD}
SELECT sheet_id, det_idx, CASE pass_id WHEN 1 THEN py2 WHEN 2 THEN 199 - py2 ELSE px2 END AS ux,
  CASE pass_id WHEN 1 THEN 99 - px2 WHEN 2 THEN px2 ELSE py2 END AS uy FROM quads""", ("detections",))
def _unrotate(t):
    df = with_quads(t.detections).withColumns({"width": F.lit(200.0), "height": F.lit(100.0)})
    return detect.unrotate_quads(df).select(*ID, F.expr("quad[2].x").alias("ux"), F.expr("quad[2].y").alias("uy"))


@query("quad_angle", f"""WITH {QUAD},
e AS (SELECT *, SQRT((px1-px0)*(px1-px0)+(py1-py0)*(py1-py0)) AS tl, SQRT((px3-px0)*(px3-px0)+(py3-py0)*(py3-py0)) AS ll FROM quads),
v AS (SELECT *, CASE WHEN tl >= ll THEN px1-px0 ELSE px3-px0 END AS dx, CASE WHEN tl >= ll THEN py1-py0 ELSE py3-py0 END AS dy FROM e),
c AS (SELECT *, CASE WHEN (ABS(dx) >= ABS(dy) AND dx < 0) OR (ABS(dx) < ABS(dy) AND dy > 0) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg FROM v),
a AS (SELECT *, -DEGREES(ATAN2(sg*dy, sg*dx)) AS ang FROM c)
SELECT sheet_id, det_idx, ROUND(CASE WHEN GREATEST(tl,ll) / GREATEST(1.0::DOUBLE, LEAST(tl,ll)) < 1.5::DOUBLE THEN angle_deg
  WHEN ABS(ang+180) < 3 THEN -180 WHEN ABS(ang+90) < 3 THEN -90 WHEN ABS(ang) < 3 THEN 0 WHEN ABS(ang-90) < 3 THEN 90
  WHEN ABS(ang-180) < 3 THEN 180 ELSE ang END, 6) + 0.0::DOUBLE AS angle FROM a""", ("detections",))
def _quad_angle(t):
    return with_quads(t.detections).select(
        *ID, r6(G.quad_angle("quad", F.col("angle_deg"))).alias("angle"))


@query("cardinal_deviation", f"""WITH g AS (SELECT sheet_id, det_idx, 0 AS ord, 0.0::DOUBLE AS cardinal, angle_deg AS dev FROM tilts
  UNION ALL SELECT t.sheet_id, t.det_idx, c.ord, c.cardinal, {S.wrap('t.angle_deg - c.cardinal')} FROM tilts AS t
  CROSS JOIN (VALUES (1,-180.0::DOUBLE),(2,-90.0::DOUBLE),(3,0.0::DOUBLE),(4,90.0::DOUBLE),(5,180.0::DOUBLE)) AS c(ord, cardinal))
SELECT sheet_id, det_idx, cardinal, ROUND(dev, 6) + 0.0::DOUBLE AS dev FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sheet_id, det_idx ORDER BY ABS(dev), ord) AS rn FROM g) WHERE rn = 1""", ("tilts",))
def _cardinal(t):
    near = G.cardinal_deviation(F.col("angle_deg"))
    return t.tilts.select(*ID, near["cardinal"].alias("cardinal"), r6(near["dev"]).alias("dev"))


@query("orientation_plausible", """SELECT sheet_id, det_idx,
  CASE WHEN LENGTH(text) < 2 THEN TRUE WHEN ABS(angle_deg) < 45 THEN NOT (y1-y0 > (x1-x0) * 1.15::DOUBLE)
       ELSE NOT (x1-x0 > (y1-y0) * 1.15::DOUBLE) END AS plausible FROM detections""", ("detections",))
def _plausible(t):
    return t.detections.select(*ID, detect.orientation_plausible(
        F.col("text"), F.col("angle_deg")).alias("plausible"))


@query("drop_degenerate", """SELECT sheet_id, det_idx FROM detections
WHERE GREATEST(0, x1 - CAST(det_idx % 60 AS DOUBLE) - x0) * (y1 - y0) > 0""", ("detections",))
def _degenerate(t):
    df = t.detections.withColumn("x1", F.col("x1") - (F.col("det_idx") % 60).cast("double"))
    return detect.drop_degenerate(df).select(*ID)


@query("canonicalise_vertical", """SELECT sheet_id, det_idx,
  CASE WHEN angle_deg = -90 THEN 90 ELSE angle_deg END AS angle_deg FROM detections""", ("detections",))
def _canonical(t):
    return t.detections.select(*ID, detect.canonical_vertical(F.col("angle_deg")).alias("angle_deg"))


@query("reads_vertically", f"""SELECT sheet_id, det_idx,
  LEAST(ABS({S.wrap('angle_deg - 90')}), ABS({S.wrap('angle_deg + 90')})) < ABS({S.wrap('angle_deg')}) AND
  LEAST(ABS({S.wrap('angle_deg - 90')}), ABS({S.wrap('angle_deg + 90')})) <= ABS({S.wrap('angle_deg - 180')}) AS vertical,
  LEAST(ABS(angle_deg+180), ABS(angle_deg+90), ABS(angle_deg), ABS(angle_deg-90), ABS(angle_deg-180)) >= 20 AS rotated
FROM (SELECT sheet_id, det_idx, angle_deg + CAST(det_idx % 90 AS DOUBLE) AS angle_deg FROM tilts)""", ("tilts",))
def _vertical(t):
    a = F.col("angle_deg") + (F.col("det_idx") % 90).cast("double")
    return t.tilts.select(*ID, G.reads_vertically(a).alias("vertical"), G.needs_rotation(a).alias("rotated"))


@query("quarter_turn", """WITH a AS (SELECT sheet_id, det_idx, -DEGREES(ATAN2(-SIN(RADIANS(angle_deg)), COS(RADIANS(angle_deg)))) AS ang FROM tilts)
SELECT sheet_id, det_idx, CAST(((CAST(ROUND_EVEN(ang / 90, 0) AS INT) * 90) % 360 + 360) % 360 AS INT) AS turn,
  ROUND(ang - ROUND_EVEN(ang / 90, 0) * 90, 6) + 0.0::DOUBLE AS deviation FROM a""", ("tilts",))
def _quarter(t):
    q = G.quarter_turn(*G.direction(F.col("angle_deg")))
    return t.tilts.select(*ID, q["turn"].alias("turn"), r6(q["deviation"]).alias("deviation"))


@query("redraw_turn", """SELECT sheet_id, det_idx, CASE angle_deg WHEN 0 THEN 0 WHEN 90 THEN 90 WHEN -90 THEN 270 END AS turn, angle_deg NOT IN (0, 90, -90) AS refused
FROM tilts""", ("tilts",))
def _redraw(t):
    q = G.redraw_turn(F.col("angle_deg"))
    return t.tilts.select(*ID, q["turn"].alias("turn"), q["error"].isNotNull().alias("refused"))


@query("outside_protected", """SELECT sheet_id, det_idx FROM detections AS d WHERE NOT EXISTS (
  SELECT 1 FROM regions AS r WHERE r.sheet_id = d.sheet_id AND (d.x0+d.x1)/2 BETWEEN r.x0 AND r.x1
  AND (d.y0+d.y1)/2 BETWEEN r.y0 AND r.y1)""", ("detections", "regions"))
def _outside(t):
    return match.outside_protected(t.detections, t.regions).select(*ID)


@query("inside_protected", """SELECT sheet_id, det_idx FROM detections AS d WHERE EXISTS (
  SELECT 1 FROM regions AS r WHERE r.sheet_id = d.sheet_id AND (d.x0+d.x1)/2 BETWEEN r.x0 AND r.x1
  AND (d.y0+d.y1)/2 BETWEEN r.y0 AND r.y1)""", ("detections", "regions"))
def _inside(t):
    return match.inside_protected(t.detections, t.regions).select(*ID)


@query("missed_text", f"""WITH {MERGE_STEPS.strip()},
k AS (SELECT d.* FROM detections AS d JOIN final_kept AS f ON f.sheet_id = d.sheet_id AND f.det_idx = d.det_idx),
dr AS (SELECT * FROM detections AS d WHERE NOT EXISTS (SELECT 1 FROM final_kept AS f WHERE f.sheet_id = d.sheet_id AND f.det_idx = d.det_idx))
SELECT sheet_id, det_idx, text, 'possible-missed-text' AS code FROM dr WHERE LENGTH(text) >= 3 AND conf >= 0.85::DOUBLE
  AND NOT EXISTS (SELECT 1 FROM k WHERE k.sheet_id = dr.sheet_id AND {S.inter('dr', 'k')} / GREATEST(1.0::DOUBLE, {S.area('dr')}) > 0.5::DOUBLE)""",
       ("detections",), recursive=True)
def _missed(t):
    # written once: the dropped, the kept and their size classes are read by themselves
    merged = written(merge.merge_detections(t.detections))
    out = match.missed_text(merged.where(~F.col("kept")), merged.where("kept"))
    return out.select(*ID, "text", F.col("flag.code").alias("code"))


@query("union_passes", """SELECT sheet_id, det_idx, text, pass_id,
  CASE pass_id WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 90.0::DOUBLE ELSE -90.0::DOUBLE END AS angle_deg FROM detections""", ("detections",))
def _union_passes(t):
    raw = t.detections
    frames = [raw.where(F.col("pass_id") == n).drop("pass_id", "angle_deg") for n, _ in K.PASS_ANGLES]
    return detect.union_passes(*frames).select(*ID, "text", "pass_id", "angle_deg")


@query("merge_rereads", f"""WITH r AS (SELECT sheet_id, det_idx, ANY_VALUE(x0)/2 + ANY_VALUE(crop_x) AS x0, ANY_VALUE(y0)/2 + ANY_VALUE(crop_y) AS y0,
    ANY_VALUE(x1)/2 + ANY_VALUE(crop_x) AS x1, ANY_VALUE(y1)/2 + ANY_VALUE(crop_y) AS y1, ANY_VALUE(text) AS text, ANY_VALUE(conf) AS conf
  FROM rereads GROUP BY sheet_id, det_idx HAVING COUNT(*) = 1)
SELECT d.sheet_id, d.det_idx, d.conf, CASE WHEN d.conf < 0.85::DOUBLE AND LENGTH(d.text) BETWEEN 2 AND 5 AND LENGTH(r.text) = LENGTH(d.text)
    AND r.conf > d.conf AND {S.inter('d', 'r')} / GREATEST(1.0::DOUBLE, {S.area('d')}) >= 0.8::DOUBLE THEN r.text ELSE d.text END AS text
FROM detections AS d LEFT JOIN r ON r.sheet_id = d.sheet_id AND r.det_idx = d.det_idx""", ("detections", "rereads"))
def _rereads(t):
    return detect.merge_rereads(t.detections, t.rereads).select(*ID, "conf", "text")


NEAR = f"""near AS (SELECT t.*, cardinal, dev FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sheet_id, det_idx ORDER BY ABS(dev), ord) AS rn FROM (
    SELECT sheet_id, det_idx, 0 AS ord, 0.0::DOUBLE AS cardinal, angle_deg AS dev FROM tilts
    UNION ALL SELECT t.sheet_id, t.det_idx, c.ord, c.cardinal, {S.wrap('t.angle_deg - c.cardinal')} FROM tilts AS t
    CROSS JOIN (VALUES (1,-180.0::DOUBLE),(2,-90.0::DOUBLE),(3,0.0::DOUBLE),(4,90.0::DOUBLE),(5,180.0::DOUBLE)) AS c(ord, cardinal))) AS n
  JOIN tilts AS t USING (sheet_id, det_idx) WHERE n.rn = 1)"""


@query("corroborate_tilts", f"""WITH {NEAR}
SELECT sheet_id, det_idx, ROUND(CASE WHEN ABS(dev) >= 3 AND ABS(dev) < 20 AND NOT EXISTS (SELECT 1 FROM near AS o
    WHERE o.sheet_id = n.sheet_id AND o.det_idx <> n.det_idx AND o.cardinal = n.cardinal AND ABS(o.dev) >= 3 AND ABS(o.dev) < 20
    AND ABS(o.dev - n.dev) <= 1.0::DOUBLE) THEN cardinal ELSE angle_deg END, 6) + 0.0::DOUBLE AS angle_deg FROM near AS n""", ("tilts",))
def _tilts(t):
    return detect.corroborate_tilts(t.tilts).select(*ID, r6(F.col("angle_deg")).alias("angle_deg"))


@query("line_corroboration", f"""WITH w AS (SELECT *, FLOOR(2 * LEAST(x1-x0, y1-y0)) AS pad FROM detections WHERE REGEXP_FULL_MATCH(text, '[0-9]+')),
g AS (SELECT *, SQRT((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS len, DEGREES(ATAN2(-(y1-y0), x1-x0)) AS ang FROM segments)
SELECT DISTINCT w.sheet_id, w.det_idx FROM w JOIN g ON g.sheet_id = w.sheet_id
WHERE g.x0 <= FLOOR(w.x1) + pad AND g.x1 >= FLOOR(w.x0) - pad AND g.y0 <= FLOOR(w.y1) + pad AND g.y1 >= FLOOR(w.y0) - pad
  AND (g.x1 < w.x0 - 3 OR g.x0 > w.x1 + 3 OR g.y1 < w.y0 - 3 OR g.y0 > w.y1 + 3)
  AND g.len >= GREATEST(20, 0.6::DOUBLE * GREATEST(w.x1-w.x0, w.y1-w.y0))
  AND ABS({S.pmod('g.ang - w.angle_deg + 90', '180')} - 90) <= 3""", ("detections", "segments"))
def _lines(t):
    return detect.line_corroboration(t.detections, t.segments)


CAPS = f"""WITH c AS (SELECT sheet_id, (CASE WHEN ABS(angle_deg) > 45 THEN x1-x0 ELSE y1-y0 END) * 0.72::DOUBLE AS cap,
    NOT {S.symbol('text')} AS ok FROM detections),
m AS (SELECT sheet_id, COALESCE(QUANTILE_CONT(cap, 0.5) FILTER (ok), QUANTILE_CONT(cap, 0.5)) AS med FROM c GROUP BY sheet_id)
SELECT s.sheet_id, CASE WHEN med < 8 THEN 'refuse' WHEN med < 14 THEN 'upscale' ELSE 'keep' END AS decision,
  CASE WHEN med < 8 THEN NULL WHEN med < 14 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS factor
FROM sheets AS s LEFT JOIN m ON m.sheet_id = s.sheet_id"""


@query("upscale_decision", CAPS, ("detections", "sheets"))
def _upscale(t):
    return detect.upscale_decision(t.detections, t.sheets)


@query("scale_protected", """SELECT sheet_id, x0*2 AS x0, y0*2 AS y0, x1*2 AS x1, y1*2 AS y1 FROM regions""", ("regions",))
def _scale(t):
    return detect.scale_boxes(t.regions, F.lit(2.0)).select("sheet_id", *G.BOX)


@query("text_classes", f"""SELECT sheet_id, det_idx, NOT REGEXP_MATCHES(raw, '[\\p{{L}}\\p{{N}}]') AS symbol,
  REGEXP_MATCHES(raw, '[\\x{{0400}}-\\x{{04FF}}\\x{{0590}}-\\x{{08FF}}\\x{{2E80}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7A3}}]') AS wrong_script,
  REGEXP_FULL_MATCH(TRIM(raw), '[0-9][0-9 .,:/\\\\\\-]*') AS numeric_run,
  CASE WHEN REGEXP_FULL_MATCH(raw, '\\d{{2,5}}') THEN 'dimension' WHEN REGEXP_FULL_MATCH(raw, '\\d{{1,3}}(?:[,.]\\d{{1,2}})?\\s*m[²2]?') THEN 'area' END AS kind,
  REGEXP_FULL_MATCH(raw, '\\d{{2,5}}') AND TRY_CAST(raw AS INT) NOT BETWEEN 200 AND 20000 AS implausible FROM raw_labels""", ("raw_labels",))
def _classes(t):
    raw = F.col("raw")
    kind = T.classify_numeric(raw)
    return t.raw_labels.select(*ID, T.is_graphical_symbol(raw).alias("symbol"),
                               T.is_wrong_script(raw).alias("wrong_script"),
                               T.is_numeric_run(raw).alias("numeric_run"), kind["kind"].alias("kind"),
                               kind["warning"].isNotNull().alias("implausible"))


@query("fold_text", f"""SELECT sheet_id, det_idx, REPLACE({S.fold('raw')}, '²', '2') AS folded,
  REGEXP_REPLACE(REGEXP_REPLACE(raw, '^\\s+|\\s+$', '', 'g'), '^[{S.DASH}]+|[{S.DASH}]+$', '', 'g') AS stripped,
  CASE WHEN REGEXP_MATCHES(raw, '{S.TRAIL}') THEN REGEXP_EXTRACT(raw, '{S.TRAIL}', 1) ELSE raw END AS head,
  CASE WHEN REGEXP_MATCHES(raw, '{S.TRAIL}') THEN REGEXP_EXTRACT(raw, '{S.TRAIL}', 2) ELSE '' END AS tail
FROM raw_labels""", ("raw_labels",))
def _fold(t):
    raw = F.col("raw")
    cut = T.split_trailing_number(raw)
    return t.raw_labels.select(
        *ID, T.fold_text(raw).alias("folded"), T.strip_edge_dashes(raw).alias("stripped"),
        cut["head"].alias("head"), cut["number"].alias("tail"))


@query("fold_documents", f"""SELECT doc_id, MD5({S.fold('text')}) AS folded FROM documents""")
def _fold_documents(t):
    from planloom.workload.views import table
    return table(t.spark, t.sf_dir, "documents").select("doc_id", F.md5(T.fold_text(F.col("text"))).alias("folded"))


@query("edit_distance", f"""SELECT sheet_id, det_idx, LEVENSHTEIN(REPLACE(REPLACE({S.fold('raw')}, '²', '2'), '一', '%'), {S.fold('truth_word')}) AS distance FROM raw_labels""", ("raw_labels",))
def _distance(t):
    raw = F.col("raw")
    return t.raw_labels.select(
        *ID, T.edit_distance(T.fold_text(raw), T.fold_text(F.col("truth_word"))).cast("long").alias("distance"))


@query("snap_text", f"""WITH {S.snap_steps('raw_labels', 'raw').strip()}
SELECT sheet_id, det_idx, raw, text_out AS text, kind, changed, ROUND(confidence, 9) AS confidence, warned FROM snapped""", ("raw_labels", "rooms"))
def _snap(t):
    s = F.col("snap")
    return vocab.snap_text(t.raw_labels, "raw").select(
        *ID, "raw", s["text"].alias("text"), s["kind"].alias("kind"), s["changed"].alias("changed"),
        F.round(s["confidence"], 9).alias("confidence"), s["warning"].isNotNull().alias("warned"))


@query("snap_text_open", f"""WITH {S.snap_steps('raw_labels', 'raw').strip()}
SELECT sheet_id, det_idx, raw, text_out AS text, kind, changed, ROUND(confidence, 9) AS confidence, warned FROM snapped""", ("raw_labels", "rooms"))
def _snap_open(t):
    """The vocabulary as a table, joined with the different heads."""
    s = F.col("snap")
    return vocab.snap_text(t.raw_labels, "raw", words=t.rooms.select("ord", "word")).select(
        *ID, "raw", s["text"].alias("text"), s["kind"].alias("kind"), s["changed"].alias("changed"),
        F.round(s["confidence"], 9).alias("confidence"), s["warning"].isNotNull().alias("warned"))


TRIAGE = f"""WITH labelled AS (SELECT d.sheet_id, d.det_idx, d.x0, d.y0, d.x1, d.y1, d.conf, l.raw AS label FROM detections AS d
  JOIN raw_labels AS l ON l.sheet_id = d.sheet_id AND l.det_idx = d.det_idx),
{S.snap_steps('labelled', 'label').strip()},
covered AS (SELECT DISTINCT d.sheet_id, d.det_idx FROM detections AS d JOIN regions AS r ON r.sheet_id = d.sheet_id
    AND (d.x0+d.x1)/2 BETWEEN r.x0 AND r.x1 AND (d.y0+d.y1)/2 BETWEEN r.y0 AND r.y1),
tri AS (SELECT snapped.*, CASE WHEN covered.det_idx IS NOT NULL THEN 'protected'
    WHEN {S.symbol('label')} OR (kind = 'unknown' AND LENGTH(label) <= 2) THEN 'symbol' ELSE 'run' END AS disposition
  FROM snapped LEFT JOIN covered ON covered.sheet_id = snapped.sheet_id AND covered.det_idx = snapped.det_idx)
SELECT sheet_id, det_idx, disposition, CASE disposition WHEN 'protected' THEN '' WHEN 'symbol' THEN 'non-text-symbol'
  ELSE CONCAT_WS(',', CASE WHEN conf < 0.85::DOUBLE THEN 'low-confidence' END, CASE WHEN changed THEN 'lexicon-snap' END,
    CASE WHEN warned AND kind = 'annotation' AND changed THEN 'annotation-confusable' WHEN warned THEN 'implausible' END) END AS codes
FROM tri"""


@query("triage_runs", TRIAGE, ("detections", "raw_labels", "rooms", "regions"))
def _triage(t):
    # written once: triage reads the runs within and the runs outside regions
    labelled = written(t.detections.drop("text").join(
        t.raw_labels.select(*ID, F.col("raw").alias("text")), ID))
    out = detect.triage_runs(labelled, protected=t.regions)
    return out.select(*ID, "disposition", F.array_join(F.transform("flags", lambda f: f["code"]), ",").alias("codes"))
