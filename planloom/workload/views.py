"""Input tables of the registered queries, derived from the driver's tables.

A sheet is an order, a text run is a line item. The text of a view runs in
Spark and in DuckDB; ``{lineitem}`` stands for the base table. Runs are
numbered by a value of their own row, so no view needs a window or a sort.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from planloom import constants as K

VIEWS: dict[str, str] = {}

VIEWS["detections"] = """
SELECT sheet_id, det_idx, CAST(det_idx % 3 AS INT) AS pass_id,
  CASE WHEN det_idx % 3 = 0 THEN CAST(0 AS DOUBLE) WHEN det_idx % 3 = 1 THEN CAST(90 AS DOUBLE)
       ELSE CAST(-90 AS DOUBLE) END AS angle_deg,
  x0, y0, x1, y1, conf, text
FROM (
  SELECT l_orderkey AS sheet_id,
    l_partkey * 100000000 + CAST(ROUND(l_extendedprice * CAST(100 AS DOUBLE)) AS BIGINT) AS det_idx,
    CAST(l_partkey % 97 AS DOUBLE) AS x0, CAST(l_suppkey % 41 AS DOUBLE) AS y0,
    CAST(l_partkey % 97 AS DOUBLE) + CAST(8 AS DOUBLE) + l_quantity AS x1,
    CAST(l_suppkey % 41 AS DOUBLE) + CAST(6 + l_partkey % 29 AS DOUBLE) AS y1,
    CAST(100 - CAST(ROUND(l_discount * CAST(300 AS DOUBLE)) AS INT) AS DOUBLE) / CAST(100 AS DOUBLE) AS conf,
    CASE WHEN l_partkey % 4 = 0 THEN CAST(l_partkey AS STRING)
         ELSE CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) % 30000 AS STRING) END AS text
  FROM {lineitem}
) AS runs
"""

VIEWS["truth"] = """
SELECT sheet_id, det_idx AS truth_idx,
  x0 + CAST(det_idx % 3 AS DOUBLE) AS x0, y0 + CAST(1 AS DOUBLE) AS y0,
  x1 + CAST(det_idx % 3 AS DOUBLE) AS x1, y1 + CAST(1 AS DOUBLE) AS y1,
  CASE WHEN det_idx % 5 = 0 THEN CONCAT(text, '0') ELSE text END AS text,
  CASE WHEN det_idx % 4 = 0 THEN 'room' ELSE 'dimension' END AS kind,
  CASE WHEN det_idx % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(90 AS DOUBLE) END AS angle_deg
FROM detections WHERE det_idx % 7 <> 0
"""

VIEWS["sheets"] = """
SELECT o_orderkey AS sheet_id, CAST(160 + o_custkey % 40 AS DOUBLE) AS width,
  CAST(80 + o_custkey % 20 AS DOUBLE) AS height FROM {orders}
"""

VIEWS["segments"] = """
SELECT o_orderkey AS sheet_id, CAST(o_custkey % 120 AS DOUBLE) AS x0, CAST(o_custkey % 50 AS DOUBLE) AS y0,
  CAST(o_custkey % 120 + o_orderkey % 40 AS DOUBLE) AS x1, CAST(o_custkey % 50 AS DOUBLE) AS y1,
  CAST(1 AS DOUBLE) AS width
FROM {orders}
"""

VIEWS["regions"] = """
SELECT o_orderkey AS sheet_id, CAST(o_custkey % 60 AS DOUBLE) AS x0, CAST(o_custkey % 30 AS DOUBLE) AS y0,
  CAST(o_custkey % 60 + 10 + o_orderkey % 30 AS DOUBLE) AS x1,
  CAST(o_custkey % 30 + 5 + o_orderkey % 20 AS DOUBLE) AS y1
FROM {orders}
"""

VIEWS["rooms"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{w}')" for i, w in enumerate(K.ROOMS)) + ") AS r(ord, word)"

VIEWS["raw_labels"] = """
SELECT k.sheet_id, k.det_idx, k.conf, r.word AS truth_word,
  CASE k.dmg WHEN 0 THEN r.word WHEN 1 THEN LOWER(r.word)
    WHEN 2 THEN REPLACE(REPLACE(REPLACE(r.word, 'ø', 'o'), 'æ', 'ae'), 'é', 'e')
    WHEN 3 THEN CONCAT('---', r.word) WHEN 4 THEN CONCAT(r.word, '.-1')
    WHEN 5 THEN CONCAT(r.word, 'x') WHEN 6 THEN CONCAT(' Vr.', CAST(k.det_idx % 9 AS STRING))
    WHEN 7 THEN CAST(k.det_idx % 30000 AS STRING) WHEN 8 THEN CONCAT(CAST(k.det_idx % 90 AS STRING), ',5 m²')
    WHEN 9 THEN 'H*' WHEN 10 THEN '1' WHEN 11 THEN '->' WHEN 12 THEN 'GO' WHEN 13 THEN '一'
    ELSE 'Qzxwv' END AS raw
FROM (SELECT sheet_id, det_idx, conf, CAST((sheet_id * 7 + det_idx) % 46 AS INT) AS ord,
        CAST((sheet_id + det_idx) % 15 AS INT) AS dmg FROM detections) AS k
JOIN rooms AS r ON k.ord = r.ord
"""

VIEWS["tilts"] = """
SELECT sheet_id, det_idx, text, x0, y0, x1, y1,
  CAST(CASE det_idx % 4 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN -90 ELSE 180 END AS DOUBLE)
    + CAST(det_idx % 401 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(20 AS DOUBLE) AS angle_deg
FROM detections
"""

VIEWS["rereads"] = """
SELECT sheet_id, det_idx, (x0 - CAST(5 AS DOUBLE)) * CAST(2 AS DOUBLE) + CAST(det_idx % 9 AS DOUBLE) AS x0,
  (y0 - CAST(3 AS DOUBLE)) * CAST(2 AS DOUBLE) AS y0, (x1 - CAST(5 AS DOUBLE)) * CAST(2 AS DOUBLE) AS x1,
  (y1 - CAST(3 AS DOUBLE)) * CAST(2 AS DOUBLE) AS y1, CAST(5 AS DOUBLE) AS crop_x, CAST(3 AS DOUBLE) AS crop_y,
  CASE WHEN det_idx % 3 = 0 THEN CONCAT(text, '1') ELSE CONCAT('7', SUBSTRING(text, 2)) END AS text,
  conf + CAST(det_idx % 5 - 1 AS DOUBLE) / CAST(100 AS DOUBLE) AS conf
FROM detections WHERE det_idx % 2 = 0
UNION ALL
SELECT sheet_id, det_idx, x0, y0, x1, y1, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), text, CAST(1 AS DOUBLE)
FROM detections WHERE det_idx % 10 = 0
"""

VIEWS["runs"] = """
SELECT sheet_id, det_idx AS run_id, pass_id, text, conf, x0, y0, x1, y1,
  CASE WHEN det_idx % 4 = 0 THEN 'room' WHEN det_idx % 11 = 0 THEN 'annotation' ELSE 'dimension' END AS kind,
  CASE WHEN det_idx % 5 = 0 THEN CAST(90 AS DOUBLE) WHEN det_idx % 13 = 0 THEN CAST(37 AS DOUBLE)
       ELSE CAST(0 AS DOUBLE) END AS angle_deg,
  CAST(14 + det_idx % 17 AS INT) AS px_size,
  CASE WHEN det_idx % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE x1 - x0 - CAST(2 AS DOUBLE) END AS ink_along,
  y1 - y0 - CAST(2 AS DOUBLE) AS cap_height,
  det_idx % 10 = 3 AS shrunk, det_idx % 7 = 2 AS collided,
  CASE WHEN det_idx % 9 = 4 THEN CAST(det_idx % 100 AS DOUBLE) / CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS hidden,
  (x1 - x0) * CAST(1 + det_idx % 3 AS DOUBLE) / CAST(2 AS DOUBLE) AS drawn_width,
  (y1 - y0 - CAST(2 AS DOUBLE)) * CAST(8 + det_idx % 5 AS DOUBLE) / CAST(10 AS DOUBLE) AS drawn_height
FROM detections
"""

VIEWS["run_flags"] = """
SELECT sheet_id, run_id, 'low-confidence' AS code, CONCAT('confidence of ', text) AS message, 'warn' AS severity
FROM runs WHERE conf < CAST(85 AS DOUBLE) / CAST(100 AS DOUBLE)
UNION ALL
SELECT sheet_id, run_id, 'implausible', CONCAT('cannot confirm ', text), 'warn' FROM runs WHERE run_id % 23 = 0
UNION ALL
SELECT sheet_id, run_id, 'lexicon-snap', CONCAT('changed ', text), 'info' FROM runs WHERE run_id % 8 = 1
UNION ALL
SELECT sheet_id, run_id, 'geometry-lost', CONCAT('lost near ', text), 'error' FROM runs WHERE run_id % 211 = 0
"""

VIEWS["glyphs"] = """
SELECT f.font, c.cp, CAST(26 + (c.cp * f.k) % 24 AS DOUBLE) / CAST(64 AS DOUBLE) AS em
FROM (SELECT DISTINCT CAST(32 + p_partkey % 95 AS INT) AS cp FROM {part}) AS c
CROSS JOIN (VALUES ('Alpha', 3), ('Beta', 5), ('Gamma', 7), ('Narrow', 2)) AS f(font, k)
WHERE NOT (f.font = 'Alpha' AND c.cp = 55) AND NOT (f.font = 'Beta' AND c.cp IN (49, 57)) AND NOT (f.font <> 'Narrow' AND c.cp = 51 )
"""

VIEWS["font_choices"] = """
SELECT * FROM (VALUES (TRUE, 'Beta', 1), (TRUE, 'Alpha', 2), (TRUE, 'Gamma', 3), (FALSE, 'Alpha', 1), (FALSE, 'Gamma', 2)) AS f(bold, font, priority)
"""

VIEWS["styled"] = """
SELECT r.*, CASE r.run_id % 3 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' ELSE 'Gamma' END AS font,
  r.run_id % 5 = 0 AS bold, r.run_id % 2 = 0 AS allow_condensed,
  CASE WHEN ink_along > CAST(0 AS DOUBLE) THEN ink_along WHEN ABS(angle_deg) > 45 THEN y1 - y0 ELSE x1 - x0 END AS target_along,
  CASE WHEN ink_along > CAST(0 AS DOUBLE) THEN cap_height WHEN ABS(angle_deg) > 45 THEN x1 - x0 ELSE y1 - y0 END AS target_across,
  CAST(256 AS DOUBLE) - (x0 + x1) / CAST(2 AS DOUBLE) AS cx_out, (y0 + y1) / CAST(2 AS DOUBLE) AS cy_out, angle_deg AS angle_out,
  drawn_width AS ink_width, drawn_height AS ink_height
FROM runs AS r
"""

VIEWS["trials"] = """
SELECT r.sheet_id, r.run_id, r.angle_deg, d.delta,
  (r.x1 - r.x0) * CAST(80 + (r.run_id + CAST(d.delta * CAST(6 AS DOUBLE) AS BIGINT)) % 30 AS DOUBLE) / CAST(100 AS DOUBLE) AS along,
  (r.y1 - r.y0) * CAST(80 + (r.run_id * 7 + CAST(d.delta * CAST(10 AS DOUBLE) AS BIGINT)) % 41 AS DOUBLE) / CAST(100 AS DOUBLE) AS across
FROM runs AS r CROSS JOIN (VALUES (CAST(-1 AS DOUBLE)), (CAST(-5 AS DOUBLE) / CAST(10 AS DOUBLE)), (CAST(0 AS DOUBLE)),
  (CAST(5 AS DOUBLE) / CAST(10 AS DOUBLE)), (CAST(1 AS DOUBLE))) AS d(delta)
"""

VIEWS["traces"] = """
SELECT sheet_id AS doc_id, pass_id AS page_index, det_idx AS run_index, text,
  CASE det_idx % 5 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(-1 AS DOUBLE) WHEN 2 THEN CAST(6 AS DOUBLE) / CAST(10 AS DOUBLE)
    ELSE CAST(1 AS DOUBLE) END AS dx,
  CASE det_idx % 5 WHEN 0 THEN CAST(-1 AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN CAST(8 AS DOUBLE) / CAST(10 AS DOUBLE)
    ELSE CAST(0 AS DOUBLE) END AS dy,
  CAST(5 + det_idx % 9 AS DOUBLE) AS size, CAST(9 AS DOUBLE) / CAST(10 AS DOUBLE) AS ascender, CAST(-2 AS DOUBLE) / CAST(10 AS DOUBLE) AS descender,
  x0 AS sx, y1 AS sy, x0 + CAST(det_idx % 40 AS DOUBLE) AS lx, y1 - CAST(det_idx % 7 AS DOUBLE) AS ly,
  CAST(4 + det_idx % 11 AS DOUBLE) AS lw, CAST(6 + det_idx % 13 AS DOUBLE) AS lh, x0, y0, x1, y1
FROM detections
"""

VIEWS["matrices"] = """
SELECT doc_id, page_index, run_index, size / CAST(4 AS DOUBLE) AS ma, CAST(0 AS DOUBLE) AS mb, CAST(0 AS DOUBLE) AS mc,
  size / CAST(4 AS DOUBLE) AS md, sx AS me, CAST(100 AS DOUBLE) - sy AS mf,
  CASE WHEN run_index % 97 = 5 THEN CAST(0 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END AS ca, CAST(2 AS DOUBLE) AS cd
FROM traces WHERE run_index % 89 <> 7
"""

VIEWS["plan_pages"] = """
SELECT o.o_orderkey AS doc_id, p.page_index, CAST(160 + o.o_custkey % 40 AS DOUBLE) AS width, CAST(80 + o.o_custkey % 20 AS DOUBLE) AS height,
  CAST(o.o_orderkey % 17 AS INT) AS text_runs_mirrored
FROM {orders} AS o JOIN (VALUES (0), (1), (2)) AS p(page_index) ON p.page_index <= o.o_custkey % 3
"""

VIEWS["page_images"] = """
SELECT l_orderkey AS doc_id, CAST(l_partkey % 3 AS INT) AS page_index, l_partkey * 100000000 + CAST(ROUND(l_extendedprice * CAST(100 AS DOUBLE)) AS BIGINT) AS img_no,
  CASE WHEN l_partkey % 50 = 0 THEN CAST(0 AS BIGINT) ELSE l_suppkey % 60 + 1 END AS xref,
  CAST(l_partkey % 97 AS DOUBLE) AS x0, CAST(l_suppkey % 41 AS DOUBLE) AS y0, CAST(l_partkey % 97 AS DOUBLE) + CAST(2 AS DOUBLE) * l_quantity AS x1,
  CAST(l_suppkey % 41 AS DOUBLE) + l_quantity AS y1, CAST(2 AS DOUBLE) * l_quantity AS a,
  CASE WHEN l_partkey % 31 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS b, CAST(0 AS DOUBLE) AS c, l_quantity AS d,
  CAST(l_partkey % 97 AS DOUBLE) AS e, CAST(l_suppkey % 41 AS DOUBLE) AS f, CAST(100 + l_partkey % 400 AS INT) AS px_w, CAST(60 + l_suppkey % 30 AS INT) AS px_h,
  l_partkey % 7 <> 0 AS readable
FROM {lineitem}
"""

VIEWS["file_list"] = """
SELECT o_orderkey AS seq, CONCAT('/in/', CAST(o_custkey % 50 AS STRING), '//', CASE o_orderkey % 4 WHEN 0 THEN './' ELSE '' END,
    CASE o_orderkey % 5 WHEN 0 THEN CONCAT('PLAN-', CAST(o_custkey % 20 AS STRING), '-A00-S-V00-R00') WHEN 1 THEN CONCAT('T04-R-V', CAST(o_custkey % 20 AS STRING))
      WHEN 2 THEN CONCAT('A-R-V1-S-V2-', CAST(o_custkey % 30 AS STRING)) ELSE CONCAT('plan ', CAST(o_custkey % 40 AS STRING)) END,
    CASE o_orderkey % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '' ELSE '.pdf' END) AS path,
  o_orderkey % 11 <> 0 AS exists, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'queued' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Mixed image PDF' END AS badge, CASE WHEN o_orderkey % 3 = 0 THEN 'has pictures' END AS reason,
  CONCAT('failed on ', o_orderpriority) AS error, o_orderpriority AS batch
FROM {orders}
"""

VIEWS["input_documents"] = """
SELECT seq AS doc_id, path, CASE WHEN seq % 29 = 0 THEN 'broken' END AS error, CAST(CASE WHEN seq % 23 = 0 THEN 0 ELSE seq % 3 + 1 END AS INT) AS page_count FROM file_list
"""

VIEWS["pixels"] = """
SELECT l_orderkey AS sheet_id, CAST(l_suppkey % 41 AS INT) AS y, CAST(l_partkey % 97 AS INT) AS x,
  MIN(CAST(l_partkey * 13 % 256 AS INT)) AS luma
FROM {lineitem} GROUP BY l_orderkey, CAST(l_suppkey % 41 AS INT), CAST(l_partkey % 97 AS INT)
"""

VIEWS["colours"] = """
SELECT sheet_id, y, x, CAST((luma * 3 + x) % 256 AS INT) AS b, luma AS g, CAST((luma + y * 5) % 256 AS INT) AS r
FROM pixels
"""

VIEWS["job_events"] = """
SELECT event_id, ts, user_id AS sheet_id,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'processing'
       ELSE 'queued' END AS status
FROM {events}
"""

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _needed(names) -> list[str]:
    """``names`` and the views they read, each after the ones it reads."""
    order: list[str] = []

    def visit(n: str) -> None:
        for other in VIEWS:
            if other != n and other not in order and re.search(rf"\b(FROM|JOIN) {other}\b", VIEWS[n]):
                visit(other)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return order


def cte(*names: str) -> str:
    """``name AS (...)`` list, for a WITH clause in DuckDB."""
    parts = []
    for n in _needed(names):
        body = VIEWS[n]
        for t in BASE_TABLES:
            body = body.replace("{" + t + "}", t)
        parts.append(f"{n} AS ({body.strip()})")
    return ",\n".join(parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, read as it lies. Where the session sets ``spark.planloom.spread``
    (the bench and the tests do, as each of their tables is one row group), it is
    spread by its key over so many partitions first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get("spark.planloom.spread", None)
    return df.repartition(int(spread), df.columns[0]) if spread else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    chain = _needed([name])
    text = "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in chain) + f" SELECT * FROM {name}"
    used = {t: table(spark, sf_dir, t) for t in BASE_TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
