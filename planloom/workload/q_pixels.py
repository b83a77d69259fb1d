"""Queries: pixel tables, statistics and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom.functions import geometry as G
from planloom.operators import gate, match, pixels as P
from planloom.session import written
from planloom.workload import sqltext as S
from planloom.workload.registry import query
from planloom.workload.q_match import match_steps

PIX = ["sheet_id", "y", "x"]


def output_of(t):
    """The mirrored sheet with some pixels changed, lost or added (width 97)."""
    px = t.pixels
    out = px.where(F.col("luma") % 29 != 3).select(
        "sheet_id", "y", (96 - F.col("x")).alias("x"),
        F.when(F.col("luma") % 7 == 0, 255 - F.col("luma")).otherwise(F.col("luma")).alias("luma"))
    return out


OUT = """outp AS (SELECT sheet_id, y, 96 - x AS x, CASE WHEN luma % 7 = 0 THEN 255 - luma ELSE luma END AS luma FROM pixels WHERE luma % 29 <> 3),
src AS (SELECT sheet_id, y, 96 - x AS x, luma FROM pixels),
dif AS (SELECT * FROM (SELECT COALESCE(s.sheet_id, o.sheet_id) AS sheet_id, COALESCE(s.y, o.y) AS y, COALESCE(s.x, o.x) AS x, ABS(COALESCE(s.luma, 255) - COALESCE(o.luma, 255)) AS gap
  FROM src AS s FULL JOIN outp AS o ON o.sheet_id = s.sheet_id AND o.y = s.y AND o.x = s.x) WHERE gap > 60)"""


def sizes(t, w=97, h=41):
    return t.sheets.select("sheet_id", F.lit(w).alias("width"), F.lit(h).alias("height"))


def diffs(t):
    return P.diff_pixels(P.flip_pixels(t.pixels, sizes(t), "v"), output_of(t))


@query("flip_pixels", "SELECT sheet_id, 40 - y AS y, 96 - x AS x, luma FROM pixels", ("pixels",))
def _flip(t):
    return P.flip_pixels(t.pixels, sizes(t), "both")


@query("align_scale", """SELECT sheet_id, CASE sheet_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS scale FROM sheets""", ("sheets",))
def _align(t):
    out = t.sheets.select("sheet_id", *[(F.col(c) * (1 + F.col("sheet_id") % 3)).alias(c) for c in ("width", "height")])
    return P.align_scale(t.sheets, out.withColumn("height", F.col("height") + F.when(F.col("sheet_id") % 3 == 2, 1).otherwise(0))).select("sheet_id", "scale")


@query("enlarge", """SELECT p.sheet_id, p.y * k + dy.v AS y, p.x * k + dx.v AS x, luma FROM (SELECT *, 1 + sheet_id % 2 AS k FROM pixels) AS p
JOIN (VALUES (0),(1)) AS dy(v) ON dy.v < k JOIN (VALUES (0),(1)) AS dx(v) ON dx.v < k""", ("pixels",))
def _enlarge(t):
    scales = t.sheets.select("sheet_id", (1 + F.col("sheet_id") % 2).alias("scale"))
    return P.enlarge(t.pixels, scales)


@query("diff_pixels", f"WITH {OUT} SELECT * FROM dif", ("pixels",))
def _diff(t):
    return diffs(t)


BOXES = "bx AS (SELECT sheet_id, CAST(TRUNC(97 - x1 - 2) AS INT) AS x0, CAST(TRUNC(y0 - 2) AS INT) AS y0, CAST(TRUNC(97 - x0 + 2) AS INT) AS x1, CAST(TRUNC(y1 + 2) AS INT) AS y1 FROM regions)"
OUTSIDE = "ob AS (SELECT * FROM dif AS d WHERE NOT EXISTS (SELECT 1 FROM bx AS b WHERE b.sheet_id = d.sheet_id AND d.x >= b.x0 AND d.x < b.x1 AND d.y >= b.y0 AND d.y < b.y1))"


def boxes_out(t):
    return t.regions.select("sheet_id", *[c.alias(n) for c, n in zip(G.mirror_box(G.box_of(), F.lit(97.0), F.lit(41.0), "v"), G.BOX)])


@query("outside_boxes", f"WITH {OUT}, {BOXES}, {OUTSIDE} SELECT * FROM ob", ("pixels", "regions"))
def _outside(t):
    return P.outside_boxes(diffs(t), boxes_out(t), pad=2)


def grow_sql(source: str, diagonal: bool = True) -> str:
    """Every pixel's region = its smallest reachable pixel (walk from each)."""
    near = "ABS(a.x - b.x) <= 1 AND ABS(a.y - b.y) <= 1" if diagonal else "ABS(a.x - b.x) + ABS(a.y - b.y) <= 1"
    return f"""pt AS (SELECT sheet_id, x, y, y * 4294967296 + x AS id FROM {source}),
nb AS (SELECT a.sheet_id, a.id AS a, b.id AS b FROM pt AS a JOIN pt AS b ON b.sheet_id = a.sheet_id AND {near}),
walk AS (SELECT sheet_id, id AS root, id AS cur FROM pt UNION SELECT w.sheet_id, w.root, n.b FROM walk AS w JOIN nb AS n ON n.sheet_id = w.sheet_id AND n.a = w.cur),
lab AS (SELECT sheet_id, cur, MIN(root) AS region FROM walk GROUP BY sheet_id, cur),
reg AS (SELECT l.sheet_id, l.region, MIN(x) AS x0, MIN(y) AS y0, MAX(x) + 1 AS x1, MAX(y) + 1 AS y1, COUNT(*) AS area FROM lab AS l JOIN pt AS p ON p.sheet_id = l.sheet_id AND p.id = l.cur GROUP BY l.sheet_id, l.region)"""


@query("diff_regions", f"WITH {OUT}, dense AS (SELECT DISTINCT sheet_id, x // 3 AS x, y // 3 AS y FROM dif), {grow_sql('dense')} SELECT sheet_id, x0, y0, x1, y1, area FROM reg", ("pixels",), recursive=True)
def _regions(t):
    px = diffs(t).select("sheet_id", F.floor(F.col("x") / 3).cast("int").alias("x"), F.floor(F.col("y") / 3).cast("int").alias("y")).distinct()
    return P.diff_regions(px).drop("region")


@query("diff_regions_4", f"WITH {OUT}, dense AS (SELECT DISTINCT sheet_id, x // 6 AS x, y // 6 AS y FROM dif), {grow_sql('dense', False)} SELECT sheet_id, x0, y0, x1, y1, area FROM reg", ("pixels",), recursive=True)
def _regions4(t):
    px = diffs(t).select("sheet_id", F.floor(F.col("x") / 6).cast("int").alias("x"), F.floor(F.col("y") / 6).cast("int").alias("y")).distinct()
    return P.diff_regions(px, diagonal=False).drop("region")


@query("long_runs", """WITH p AS (SELECT DISTINCT sheet_id, CAST(y0 AS INT) AS y, CAST(UNNEST(RANGE(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS INT) AS x FROM detections UNION
  SELECT sheet_id, CAST(UNNEST(RANGE(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT) + 12)) AS INT), CAST(x0 AS INT) FROM detections),
h AS (SELECT *, x - ROW_NUMBER() OVER (PARTITION BY sheet_id, y ORDER BY x) AS g FROM p), v AS (SELECT *, y - ROW_NUMBER() OVER (PARTITION BY sheet_id, x ORDER BY y) AS g FROM p),
hh AS (SELECT sheet_id, y, x, COUNT(*) OVER (PARTITION BY sheet_id, y, g) AS n FROM h), vv AS (SELECT sheet_id, y, x, COUNT(*) OVER (PARTITION BY sheet_id, x, g) AS n FROM v)
SELECT sheet_id, y, x FROM hh WHERE n >= 40 UNION SELECT sheet_id, y, x FROM vv WHERE n >= 40""", ("detections",))
def _long(t):
    x0, y0, x1, y1 = (F.col(c).cast("int") for c in G.BOX)
    across = t.detections.select("sheet_id", y0.alias("y"), F.explode(F.sequence(x0, x1 - 1)).alias("x"))
    down = t.detections.select("sheet_id", F.explode(F.sequence(y0, y1 + 11)).alias("y"), x0.alias("x"))
    return P.long_runs(across.unionByName(down))


HIST = """hist AS (SELECT sheet_id, luma, SUM(n)::BIGINT AS n FROM (SELECT sheet_id, luma, COUNT(*) AS n FROM pixels GROUP BY sheet_id, luma UNION ALL
  SELECT s.sheet_id, 255, 97 * 41 - COUNT(p.luma) FROM sheets AS s LEFT JOIN pixels AS p ON p.sheet_id = s.sheet_id GROUP BY s.sheet_id) GROUP BY sheet_id, luma)"""
LEVELS = HIST + """,
cum AS (SELECT *, SUM(n) OVER w AS n1, SUM(n * luma) OVER w AS s1, SUM(n) OVER (PARTITION BY sheet_id) AS nn, SUM(n * luma) OVER (PARTITION BY sheet_id) AS ss FROM hist WINDOW w AS (PARTITION BY sheet_id ORDER BY luma)),
sc AS (SELECT *, CASE WHEN nn > n1 THEN (s1::DOUBLE * nn - ss::DOUBLE * n1) * (s1::DOUBLE * nn - ss::DOUBLE * n1) / (n1::DOUBLE * (nn - n1)) ELSE -1 END AS score FROM cum),
bl AS (SELECT sheet_id, CASE WHEN score > 0 THEN luma ELSE 0 END AS level FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sheet_id ORDER BY score DESC, luma) AS rn FROM sc) WHERE rn = 1),
ex AS (SELECT h.sheet_id, h.luma, h.n, h.luma <= b.level AS dark FROM hist AS h JOIN bl AS b ON b.sheet_id = h.sheet_id),
ec AS (SELECT *, SUM(n) OVER (PARTITION BY sheet_id, dark ORDER BY luma) AS c, SUM(n) OVER (PARTITION BY sheet_id, dark) AS t FROM ex),
em AS (SELECT sheet_id, dark, (MIN(luma) FILTER (c > (t - 1) // 2) + MIN(luma) FILTER (c > t // 2)) / 2 AS med FROM ec GROUP BY sheet_id, dark),
lv AS (SELECT b.sheet_id, b.level, MAX(e.med) FILTER (e.dark) AS ink, MAX(e.med) FILTER (NOT e.dark) AS paper FROM bl AS b JOIN em AS e ON e.sheet_id = b.sheet_id GROUP BY b.sheet_id, b.level)"""


@query("histogram", f"WITH {HIST} SELECT * FROM hist", ("pixels", "sheets"))
def _hist(t):
    return P.histogram(t.pixels, sizes(t))


@query("otsu_levels", f"WITH {LEVELS} SELECT * FROM lv", ("pixels", "sheets"))
def _otsu(t):
    return P.otsu_levels(P.histogram(t.pixels, sizes(t)))


COVER = LEVELS + """,
pa AS (SELECT p.*, l.level, LEAST(GREATEST((l.paper - p.luma) / GREATEST(1, l.paper - l.ink), 0), 1) AS alpha FROM pixels AS p JOIN lv AS l ON l.sheet_id = p.sheet_id AND ink IS NOT NULL AND paper IS NOT NULL),
cov AS (SELECT a.sheet_id, a.y, a.x, a.alpha FROM pa AS a WHERE alpha > 0 AND EXISTS (SELECT 1 FROM pa AS d WHERE d.sheet_id = a.sheet_id AND ABS(d.x - a.x) <= 1 AND ABS(d.y - a.y) <= 1 AND d.luma <= d.level))"""


@query("drawing_coverage", f"WITH {COVER} SELECT sheet_id, y, x, ROUND(alpha, 9) AS alpha FROM cov", ("pixels", "sheets"))
def _coverage(t):
    px = written(t.pixels)
    out = P.drawing_coverage(px, P.otsu_levels(P.histogram(px, sizes(t))))
    return out.withColumn("alpha", F.round("alpha", 9))


def text_boxes(t):
    return t.regions.select("sheet_id", F.lit(1).alias("box_id"), *G.BOX)


RING = """rb AS (SELECT sheet_id, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1 FROM regions),
ring AS (SELECT p.*, b.x0, b.y0, b.x1, b.y1 FROM colours AS p JOIN rb AS b ON b.sheet_id = p.sheet_id AND x >= x0-6 AND x < x1+6 AND y >= y0-6 AND y < y1+6 AND NOT (x >= x0 AND x < x1 AND y >= y0 AND y < y1))"""


@query("paper_colour", f"""WITH {RING},
q AS (SELECT sheet_id, b // 8 AS qb, g // 8 AS qg, r // 8 AS qr, COUNT(*) AS n, SUM(b) AS sb, SUM(g) AS sg, SUM(r) AS sr FROM ring GROUP BY ALL),
miss AS (SELECT rb.sheet_id, GREATEST(LEAST(x1+6, 97) - GREATEST(x0-6, 0), 0) * GREATEST(LEAST(y1+6, 41) - GREATEST(y0-6, 0), 0) - GREATEST(LEAST(x1, 97) - GREATEST(x0, 0), 0) * GREATEST(LEAST(y1, 41) - GREATEST(y0, 0), 0)
  - COALESCE((SELECT SUM(n) FROM q WHERE q.sheet_id = rb.sheet_id), 0) AS n FROM rb),
u AS (SELECT sheet_id, qb, qg, qr, SUM(n) AS n, SUM(sb) AS sb, SUM(sg) AS sg, SUM(sr) AS sr FROM (SELECT * FROM q UNION ALL SELECT sheet_id, 31, 31, 31, n, n*255, n*255, n*255 FROM miss WHERE n > 0) GROUP BY ALL),
w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sheet_id ORDER BY n DESC, qb, qg, qr) AS rn FROM u)
SELECT rb.sheet_id, 1 AS box_id, COALESCE(CAST(ROUND_EVEN(sb / n, 0) AS INT), 255) AS b, COALESCE(CAST(ROUND_EVEN(sg / n, 0) AS INT), 255) AS g, COALESCE(CAST(ROUND_EVEN(sr / n, 0) AS INT), 255) AS r
FROM rb LEFT JOIN w ON w.sheet_id = rb.sheet_id AND w.rn = 1""", ("colours", "regions"))
def _paper(t):
    return P.paper_colour(t.colours, text_boxes(t), sizes(t))


@query("patterned_background", """WITH rb AS (SELECT sheet_id, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1 FROM regions),
ring AS (SELECT p.* FROM pixels AS p JOIN rb AS b ON b.sheet_id = p.sheet_id AND x >= x0-6 AND x < x1+6 AND y >= y0-6 AND y < y1+6 AND NOT (x >= x0 AND x < x1 AND y >= y0 AND y < y1))
SELECT sheet_id, 'erase-over-pattern' AS code FROM ring WHERE luma > 128 GROUP BY sheet_id HAVING STDDEV_POP(luma) > 18""", ("pixels", "regions"))
def _pattern(t):
    return P.patterned_background(t.pixels, text_boxes(t)).select("sheet_id", F.col("flag.code").alias("code"))


LUMA = "(b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE)"


@query("ink_paper", f"""WITH rb AS (SELECT sheet_id, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1 FROM regions),
crop AS (SELECT p.*, {LUMA} AS lu FROM colours AS p JOIN rb AS k ON k.sheet_id = p.sheet_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1),
cut AS (SELECT sheet_id, QUANTILE_CONT(lu, 0.1) AS lo, QUANTILE_CONT(lu, 0.9) AS hi FROM crop GROUP BY sheet_id),
m AS (SELECT c.sheet_id, QUANTILE_CONT(r, 0.5) FILTER (lu <= lo) AS ir, QUANTILE_CONT(g, 0.5) FILTER (lu <= lo) AS ig, QUANTILE_CONT(b, 0.5) FILTER (lu <= lo) AS ib,
  QUANTILE_CONT(r, 0.5) FILTER (lu >= hi) AS pr, QUANTILE_CONT(g, 0.5) FILTER (lu >= hi) AS pg, QUANTILE_CONT(b, 0.5) FILTER (lu >= hi) AS pb FROM crop AS c JOIN cut ON cut.sheet_id = c.sheet_id GROUP BY c.sheet_id)
SELECT rb.sheet_id, 1 AS box_id, CAST(COALESCE(ROUND_EVEN(ir, 0), 0) AS INT) AS ink_r, CAST(COALESCE(ROUND_EVEN(ig, 0), 0) AS INT) AS ink_g, CAST(COALESCE(ROUND_EVEN(ib, 0), 0) AS INT) AS ink_b,
  CAST(COALESCE(ROUND_EVEN(pr, 0), 255) AS INT) AS paper_r, CAST(COALESCE(ROUND_EVEN(pg, 0), 255) AS INT) AS paper_g, CAST(COALESCE(ROUND_EVEN(pb, 0), 255) AS INT) AS paper_b
FROM rb LEFT JOIN m ON m.sheet_id = rb.sheet_id""", ("colours", "regions"))
def _ink_paper(t):
    return P.ink_paper(t.colours, text_boxes(t))


@query("sheet_ink_colour", """WITH l AS (SELECT *, b * 114 + g * 587 + r * 299 AS lu FROM colours), c AS (SELECT sheet_id, ROUND(100 * QUANTILE_CONT(lu, 0.01)) AS cut FROM l GROUP BY sheet_id)
SELECT l.sheet_id, CAST(TRUNC(QUANTILE_CONT(b, 0.5)) AS INT) AS b, CAST(TRUNC(QUANTILE_CONT(g, 0.5)) AS INT) AS g, CAST(TRUNC(QUANTILE_CONT(r, 0.5)) AS INT) AS r
FROM l JOIN c ON c.sheet_id = l.sheet_id AND 100 * lu <= cut GROUP BY l.sheet_id""", ("colours",))
def _sheet_ink(t):
    return P.sheet_ink_colour(t.colours)


@query("luma", f"SELECT sheet_id, y, x, ROUND({LUMA}, 6) AS luma, CAST(ROUND({LUMA}) AS INT) AS luma8 FROM colours", ("colours",))
def _luma(t):
    from planloom.functions import text as T
    c = (F.col("b"), F.col("g"), F.col("r"))
    return t.colours.select(*PIX, F.round(T.luma(*c), 6).alias("luma"), T.luma8(*c).alias("luma8"))


LOST = f"""{OUT},
bx AS (SELECT sheet_id, CAST(TRUNC(97 - x1) AS INT) AS x0, CAST(TRUNC(y0) AS INT) AS y0, CAST(TRUNC(97 - x0) AS INT) AS x1, CAST(TRUNC(y1) AS INT) AS y1 FROM regions),
lost AS (SELECT s.sheet_id FROM src AS s JOIN sheets AS h ON h.sheet_id = s.sheet_id WHERE s.sheet_id % 11 <> 0 AND luma < 128
  AND NOT EXISTS (SELECT 1 FROM bx AS b WHERE b.sheet_id = s.sheet_id AND s.x >= b.x0 AND s.x < b.x1 AND s.y >= b.y0 AND s.y < b.y1)
  AND NOT EXISTS (SELECT 1 FROM outp AS o WHERE o.sheet_id = s.sheet_id AND o.y = s.y AND o.x = s.x AND o.luma < 128))"""


def spatial_violations(t):
    size = sizes(t)
    out_size = size.withColumn("width", F.col("width") + F.when(F.col("sheet_id") % 11 == 0, 1).otherwise(0))
    return P.check_spatial_integrity(t.pixels, output_of(t), size, out_size, boxes_out(t), "v")


@query("check_spatial_integrity", f"""WITH {LOST}
SELECT sheet_id, 'geometry' AS kind, CAST(COUNT(*) AS DOUBLE) AS measured FROM lost GROUP BY sheet_id UNION ALL SELECT sheet_id, 'scale-mismatch', 0 FROM sheets WHERE sheet_id % 11 = 0""",
       ("pixels", "regions", "sheets"))
def _spatial(t):
    return spatial_violations(t).select("sheet_id", "kind", "measured")




OVERWRITTEN = f"""{COVER},
c AS (SELECT k.sheet_id FROM cov AS k JOIN colours AS p ON p.sheet_id = k.sheet_id AND p.y = k.y AND p.x = k.x WHERE alpha >= 0.999::DOUBLE AND (p.b % 5 = 0 OR p.r % 9 = 1))"""


def layer_violations(t):
    px = written(t.pixels)
    plate = written(t.colours)
    canvas = plate.withColumn("g", F.when((F.col("b") % 5 == 0) | (F.col("r") % 9 == 1), F.col("g") + 1).otherwise(F.col("g")))
    cover = P.drawing_coverage(px, P.otsu_levels(P.histogram(px, sizes(t))))
    return P.check_layer_ordering(canvas, plate, cover)


@query("check_layer_ordering", f"""WITH {OVERWRITTEN}
SELECT sheet_id, CAST(COUNT(*) AS DOUBLE) AS measured FROM c GROUP BY sheet_id""", ("pixels", "colours", "sheets"))
def _layer(t):
    return layer_violations(t).select("sheet_id", "measured")


WORDING = f"""WITH {match_steps('last', truth='wt').strip()},
{S.snap_steps('detections', 'text').strip()}
SELECT t.sheet_id, t.truth_idx AS run_id, CASE WHEN m.det_idx IS NULL THEN 'unconfirmed' ELSE 'differs' END AS issue
FROM truth AS t LEFT JOIN matches AS m ON m.sheet_id = t.sheet_id AND m.truth_idx = t.truth_idx LEFT JOIN snapped AS s ON s.sheet_id = m.sheet_id AND s.det_idx = m.det_idx
WHERE m.det_idx IS NULL OR s.text_out <> t.text OR s.conf < 0.85::DOUBLE""".replace("wt AS t", "truth AS t")


@query("check_wording", WORDING, ("truth", "detections", "rooms"), recursive=True)
def _wording(t):
    expected = t.truth.withColumnRenamed("truth_idx", "run_id")
    return match.check_wording(expected, t.detections).select("sheet_id", "run_id", "issue")


@query("verify_report", f"""WITH {OUT}, {BOXES}, {OUTSIDE}, {grow_sql('ob')}
SELECT s.sheet_id, CAST(97 * 41 AS BIGINT) AS total_px, COALESCE(d.n, 0) AS differing_px, COALESCE(r.n, 0) AS outside_regions, COALESCE(r.a, 0)::BIGINT AS outside_px, COALESCE(i.n, 0) AS issues,
  ROUND(100 * COALESCE(d.n, 0) / (97 * 41), 9) AS differing_pct, r.n IS NULL AND i.n IS NULL AS passed,
  COALESCE(c.n, 0) AS text_regions_checked, COALESCE(c.n, 0) AS text_runs_checked
FROM sheets AS s LEFT JOIN (SELECT sheet_id, COUNT(*) AS n FROM detections GROUP BY sheet_id) AS c ON c.sheet_id = s.sheet_id LEFT JOIN (SELECT sheet_id, COUNT(*) AS n FROM dif GROUP BY sheet_id) AS d ON d.sheet_id = s.sheet_id
LEFT JOIN (SELECT sheet_id, COUNT(*) AS n, SUM(area) AS a FROM reg GROUP BY sheet_id) AS r ON r.sheet_id = s.sheet_id
LEFT JOIN (SELECT sheet_id, COUNT(*) AS n FROM run_flags WHERE severity = 'error' GROUP BY sheet_id) AS i ON i.sheet_id = s.sheet_id""",
       ("pixels", "regions", "sheets", "run_flags", "detections"), recursive=True)
def _report(t):
    d = diffs(t)
    regions = P.diff_regions(P.outside_boxes(d, boxes_out(t), pad=2))
    out = P.verify_report(sizes(t), d, regions, t.run_flags.where(F.col("severity") == "error"), t.detections)
    return out.withColumn("differing_pct", F.round("differing_pct", 9))


@query("verification_summary", """SELECT sheet_id, CASE WHEN n = 0 THEN 0 ELSE 1 END AS errors, n AS warnings, CASE WHEN n = 0 THEN 1 ELSE 0 END AS information,
  CASE WHEN n > 0 THEN '1 error(s) need attention' ELSE 'Ready to save' END AS label FROM (SELECT s.sheet_id, COUNT(f.sheet_id) AS n FROM sheets AS s LEFT JOIN run_flags AS f ON f.sheet_id = s.sheet_id AND f.severity = 'error' GROUP BY s.sheet_id)""",
       ("sheets", "run_flags"))
def _verification(t):
    from planloom.operators import batch
    issues = t.run_flags.where(F.col("severity") == "error").groupBy("sheet_id").agg(F.count("*").alias("issues"))
    report = t.sheets.select("sheet_id").join(issues, "sheet_id", "left").fillna(0, ["issues"]).withColumn("passed", F.col("issues") == 0)
    return batch.verification_summary(report)
