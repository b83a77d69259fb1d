"""Queries: merge, overlap, matching, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom.operators import match, merge, ranking, score
from planloom.plans import scoring
from planloom.workload.registry import query

INTER = ("(GREATEST(0.0::DOUBLE, LEAST({a}.x1,{b}.x1) - GREATEST({a}.x0,{b}.x0)) * "
         "GREATEST(0.0::DOUBLE, LEAST({a}.y1,{b}.y1) - GREATEST({a}.y0,{b}.y0)))")


def _inter(a, b):
    return INTER.format(a=a, b=b)


def _area(a):
    return f"(({a}.x1-{a}.x0)*({a}.y1-{a}.y0))"


def _iou(a, b):
    i = _inter(a, b)
    return f"(CASE WHEN {i} > 0 THEN {i} / ({_area(a)} + {_area(b)} - {i}) ELSE 0 END)"


def _cont(a, b):
    i = _inter(a, b)
    return f"(CASE WHEN {i} > 0 THEN {i} / LEAST({_area(a)}, {_area(b)}) ELSE 0 END)"


MERGE_STEPS = f"""
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sheet_id
    ORDER BY conf DESC, LENGTH(text) DESC, det_idx) AS k FROM detections),
fold AS (
  SELECT sheet_id, 0::BIGINT AS k,
    CAST([] AS STRUCT(det_idx BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, conf DOUBLE, n BIGINT)[]) AS kept
  FROM (SELECT DISTINCT sheet_id FROM detections)
  UNION ALL
  SELECT s.sheet_id, s.k,
    CASE WHEN LEN(s.ov) = 0 THEN LIST_APPEND(s.kept, s.me)
         WHEN LEN(s.ov) = 1 AND s.me.n > s.ov[1].n AND (s.me.conf > s.ov[1].conf - 0.05::DOUBLE
              OR (s.bc > 0.9::DOUBLE AND s.me.conf >= 0.85::DOUBLE))
           THEN LIST_APPEND(LIST_FILTER(s.kept, lambda q: q.det_idx <> s.ov[1].det_idx), s.me)
         ELSE s.kept END
  FROM (
    SELECT o.*, CASE WHEN LEN(o.ov) = 1 THEN {_cont('o.me', 'o.ov[1]')} ELSE 0 END AS bc
    FROM (
      SELECT f.sheet_id, r.k, f.kept,
        {{'det_idx': r.det_idx, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1, 'conf': r.conf,
          'n': CAST(LENGTH(r.text) AS BIGINT)}} AS me,
        LIST_FILTER(f.kept, lambda q: {_iou('r', 'q')} > 0.3::DOUBLE OR {_cont('r', 'q')} > 0.6::DOUBLE) AS ov
      FROM fold AS f JOIN ranked AS r ON r.sheet_id = f.sheet_id AND r.k = f.k + 1
    ) AS o
  ) AS s
),
final_kept AS (
  SELECT sheet_id, UNNEST(LIST_TRANSFORM(kept, lambda q: q.det_idx)) AS det_idx
  FROM (SELECT sheet_id, MAX_BY(kept, k) AS kept FROM fold GROUP BY sheet_id))
"""

MERGE_SQL = f"""WITH {MERGE_STEPS.strip()}
SELECT d.sheet_id, d.det_idx, d.text, d.conf, (f.det_idx IS NOT NULL) AS kept
FROM detections AS d LEFT JOIN final_kept AS f ON f.sheet_id = d.sheet_id AND f.det_idx = d.det_idx
"""


@query("merge_detections", MERGE_SQL, ("detections",), recursive=True)
def _merge(t):
    return merge.merge_detections(t.detections).select("sheet_id", "det_idx", "text", "conf", "kept")


#: All sheets side by side on so many boards: far beyond the limits of the folds at every scale.
BOARDS, TILE, PER_ROW = 2, 16384.0, 64


def _pinned(df):
    """Boxes of each sheet on a tile of its own of a large board."""
    tile = F.floor(F.col("sheet_id") / BOARDS)
    right, down = (tile % PER_ROW) * TILE, F.floor(tile / PER_ROW) * TILE
    return df.withColumns({"x0": F.col("x0") + right, "x1": F.col("x1") + right, "y0": F.col("y0") + down, "y1": F.col("y1") + down,
                           "board": F.col("sheet_id") % BOARDS})


@query("merge_detections_dense", MERGE_SQL, ("detections",), recursive=True)
def _merge_dense(t):
    dets = _pinned(t.detections).withColumn("number", F.struct("sheet_id", "det_idx"))
    merged = merge.merge_detections(dets, order="number", on=("board",))
    return merged.select("sheet_id", "det_idx", "text", "conf", "kept")


def match_steps(ties: str, truth: str = "truth", dets: str = "detections") -> str:
    order = "t.truth_idx, d.det_idx" if ties == "first" else "t.truth_idx DESC, d.det_idx DESC"
    return f"""
cand AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sheet_id ORDER BY pref) AS k FROM (
    SELECT t.sheet_id, t.truth_idx, d.det_idx, {_iou('t', 'd')} AS iou,
      ROW_NUMBER() OVER (PARTITION BY t.sheet_id ORDER BY {_iou('t', 'd')} DESC, {order}) AS pref
    FROM {truth} AS t JOIN {dets} AS d ON d.sheet_id = t.sheet_id
    WHERE {_iou('t', 'd')} >= 0.15::DOUBLE)),
greedy AS (
  SELECT sheet_id, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS ts, CAST([] AS BIGINT[]) AS ds
  FROM (SELECT DISTINCT sheet_id FROM cand)
  UNION ALL
  SELECT g.sheet_id, c.k,
    CASE WHEN LIST_CONTAINS(g.ts, c.truth_idx) OR LIST_CONTAINS(g.ds, c.det_idx) THEN g.ts
         ELSE LIST_APPEND(g.ts, c.truth_idx) END,
    CASE WHEN LIST_CONTAINS(g.ts, c.truth_idx) OR LIST_CONTAINS(g.ds, c.det_idx) THEN g.ds
         ELSE LIST_APPEND(g.ds, c.det_idx) END
  FROM greedy AS g JOIN cand AS c ON c.sheet_id = g.sheet_id AND c.k = g.k + 1),
picked AS (
  SELECT sheet_id, UNNEST(ts) AS truth_idx, UNNEST(ds) AS det_idx
  FROM (SELECT sheet_id, MAX_BY(ts, k) AS ts, MAX_BY(ds, k) AS ds FROM greedy GROUP BY sheet_id)),
matches AS (
  SELECT p.sheet_id, p.truth_idx, p.det_idx, c.iou FROM picked AS p
  JOIN cand AS c ON c.sheet_id = p.sheet_id AND c.truth_idx = p.truth_idx AND c.det_idx = p.det_idx)
"""


@query("match_one_to_one", f"WITH {match_steps('first').strip()} SELECT * FROM matches",
       ("truth", "detections"), recursive=True)
def _match(t):
    return match.match_one_to_one(t.truth, t.detections)


@query("match_dense", f"WITH {match_steps('first').strip()} SELECT * FROM matches",
       ("truth", "detections"), recursive=True)
def _match_dense(t):
    """Runs of several sheets may have one number: on a board, sheet and number name a run."""
    truth, dets = (_pinned(df).withColumn(idx, F.struct("sheet_id", F.col(idx).alias("n")))
                   for df, idx in ((t.truth, "truth_idx"), (t.detections, "det_idx")))
    return match.match_one_to_one(truth, dets, on=("board",)).select(
        "truth_idx.sheet_id", F.col("truth_idx.n").alias("truth_idx"), F.col("det_idx.n").alias("det_idx"), "iou")


@query("match_last_ties", f"WITH {match_steps('last').strip()} SELECT * FROM matches",
       ("truth", "detections"), recursive=True)
def _match_last(t):
    return match.match_one_to_one(t.truth, t.detections, ties="last")


@query("overlap_pairs", f"""
SELECT d.sheet_id, d.det_idx, t.truth_idx, {_inter('d', 't')} AS inter, {_iou('d', 't')} AS iou,
  {_cont('d', 't')} AS containment, {_inter('d', 't')} / GREATEST(1.0::DOUBLE, {_area('d')}) AS coverage
FROM detections AS d JOIN truth AS t ON t.sheet_id = d.sheet_id WHERE {_inter('d', 't')} > 0
""", ("detections", "truth"))
def _pairs(t):
    dets = t.detections.select("sheet_id", "det_idx", "x0", "y0", "x1", "y1")
    tr = t.truth.select("sheet_id", "truth_idx", "x0", "y0", "x1", "y1")
    return match.overlap_pairs(dets, tr, ["sheet_id"]).select(
        "sheet_id", "det_idx", F.col("r_truth_idx").alias("truth_idx"), "inter", "iou",
        "containment", "coverage")


SCORED = """
scored AS (
  SELECT t.sheet_id, t.truth_idx, t.text AS truth, t.kind, d.text AS detected, d.conf,
    t.angle_deg AS angle_truth, d.angle_deg AS angle_detected, COALESCE(m.iou, 0::DOUBLE) AS iou,
    SQRT(POW((t.x0+t.x1)/2 - (d.x0+d.x1)/2, 2) + POW((t.y0+t.y1)/2 - (d.y0+d.y1)/2, 2)) AS err
  FROM truth AS t LEFT JOIN matches AS m ON m.sheet_id = t.sheet_id AND m.truth_idx = t.truth_idx
  LEFT JOIN detections AS d ON d.sheet_id = m.sheet_id AND d.det_idx = m.det_idx)
"""


@query("score_runs", f"""WITH {match_steps('first').strip()}, {SCORED.strip()}
SELECT sheet_id, truth_idx, truth, detected, detected AS corrected, iou, ROUND(err, 6) AS anchor_error_px FROM scored
""", ("truth", "detections"), recursive=True)
def _score_runs(t):
    return match.score_runs(t.truth, t.detections).select(
        "sheet_id", "truth_idx", "truth", "detected", "corrected", "iou",
        F.round("anchor_error_px", 6).alias("anchor_error_px"))


ANGLE_GAP = "ABS((((angle_truth - angle_detected + 180) % 360) + 360) % 360 - 180)"
REPORT = """COUNT(*) AS runs, ROUND(AVG(CAST(detected IS NOT NULL AS INT)), 9) AS recall,
  ROUND(GREATEST(0, 1 - SUM(COALESCE(LEVENSHTEIN(truth, detected), LENGTH(truth))) / SUM(LENGTH(truth))), 9) AS char_accuracy,
  ROUND(AVG(CAST(COALESCE(detected = truth, FALSE) AS INT)), 9) AS exact_raw_rate,
  ROUND(COALESCE(AVG(err), -1), 6) AS mean_anchor_error,
  ROUND(AVG(CAST(COALESCE(""" + ANGLE_GAP + """ < 15, FALSE) AS INT)), 9) AS angle_accuracy"""


def rounded_report(df, *by):
    anchor = F.when(F.isnan("mean_anchor_error"), -1.0).otherwise(F.col("mean_anchor_error"))
    return df.select(*by, "runs", F.round("recall", 9).alias("recall"),
                     F.round("char_accuracy", 9).alias("char_accuracy"),
                     F.round("exact_raw_rate", 9).alias("exact_raw_rate"),
                     F.round(anchor, 6).alias("mean_anchor_error"),
                     F.round("angle_accuracy", 9).alias("angle_accuracy"))


@query("score_report", f"""WITH {match_steps('first').strip()}, {SCORED.strip()}
SELECT sheet_id, {REPORT} FROM scored GROUP BY sheet_id""", ("truth", "detections"), recursive=True)
def _score_report(t):
    return rounded_report(score.score_report(match.score_runs(t.truth, t.detections), "sheet_id"),
                          "sheet_id")


@query("score_breakdown", f"""WITH {match_steps('first').strip()}, {SCORED.strip()}
SELECT kind, angle_truth, {REPORT} FROM scored GROUP BY CUBE (kind, angle_truth)""",
       ("truth", "detections"), recursive=True)
def _score_breakdown(t):
    scores = match.score_runs(t.truth, t.detections)
    return rounded_report(score.score_breakdown(scores, "kind", "angle_truth"), "kind", "angle_truth")


@query("score_failures", f"""WITH {match_steps('first').strip()}, {SCORED.strip()}
SELECT sheet_id, truth_idx, truth, detected FROM scored WHERE detected IS NULL OR detected <> truth""",
       ("truth", "detections"), recursive=True)
def _failures(t):
    return score.score_failures(match.score_runs(t.truth, t.detections)).select(
        "sheet_id", "truth_idx", "truth", "detected")


@query("orientation_failures", f"""WITH {match_steps('first').strip()}, {SCORED.strip()}
SELECT sheet_id, truth_idx, angle_truth, angle_detected FROM scored
WHERE angle_detected IS NULL OR {ANGLE_GAP} >= 15""", ("truth", "detections"), recursive=True)
def _orientation(t):
    return score.orientation_failures(match.score_runs(t.truth, t.detections)).select(
        "sheet_id", "truth_idx", "angle_truth", "angle_detected")


@query("score_merged_corpus", f"""WITH {MERGE_STEPS.strip()},
merged AS (SELECT d.* FROM detections AS d JOIN final_kept AS f ON f.sheet_id = d.sheet_id AND f.det_idx = d.det_idx),
{match_steps('first', dets='merged').strip()}, {SCORED.strip()}
SELECT {REPORT} FROM scored""", ("truth", "detections"), recursive=True)
def _score_merged(t):
    return rounded_report(scoring.score_merged(t.detections, t.truth))


@query("reading_order", """
SELECT sheet_id, det_idx, ROW_NUMBER() OVER (PARTITION BY sheet_id ORDER BY y0, x0, det_idx) AS read_pos
FROM detections""", ("detections",))
def _reading(t):
    return ranking.reading_order(t.detections).select("sheet_id", "det_idx", "read_pos")
