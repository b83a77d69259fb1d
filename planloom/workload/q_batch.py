"""Queries: files, names, manifests, job records and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom.operators import batch
from planloom.sources import files, truth
from planloom.workload.registry import query
from planloom.workload.views import table

STEM = "REGEXP_EXTRACT({p}, '^(.*/)?([^/]+?)(\\.[^./]+)?$', 2)"
SUFF = "REGEXP_EXTRACT({p}, '^(.*/)?([^/]+?)(\\.[^./]+)?$', 3)"
FIELD = "^(.*?-)([RS])(-V\\d+(?:-.*)?)$"


def counterpart_sql(p: str) -> tuple[str, str]:
    stem, suff = STEM.format(p=p), SUFF.format(p=p)
    has = f"REGEXP_MATCHES({stem}, '{FIELD}')"
    name = (f"CASE WHEN {has} THEN REGEXP_EXTRACT({stem}, '{FIELD}', 1) || CASE REGEXP_EXTRACT({stem}, '{FIELD}', 2) WHEN 'R' THEN 'S' ELSE 'R' END "
            f"|| REGEXP_EXTRACT({stem}, '{FIELD}', 3) || {suff} ELSE {stem} || '_mirrored' || {suff} END")
    return name, f"NOT {has}"


NAME, WARN = counterpart_sql("path")


@query("counterpart_name", f"SELECT seq, {NAME} AS name, {WARN} AS naming_warning FROM file_list", ("file_list",))
def _counterpart(t):
    twin = batch.counterpart_name(F.col("path"))
    return t.file_list.select("seq", twin["name"].alias("name"), twin["naming_warning"].alias("naming_warning"))


@query("default_output_name", f"""SELECT seq, REGEXP_EXTRACT(path, '^(.*/)?([^/]+?)(\\.[^./]+)?$', 1) || {STEM.format(p='path')} || '_mirrored' || {SUFF.format(p='path')} AS output,
  REGEXP_EXTRACT(path, '^(.*/)?([^/]+?)(\\.[^./]+)?$', 1) || {STEM.format(p='path')} || '_mirrored' || {SUFF.format(p='path')} || '.planloom.json' AS sidecar FROM file_list""", ("file_list",))
def _output_name(t):
    out = batch.default_output_name(F.col("path"))
    return t.file_list.select("seq", out.alias("output"), batch.sidecar_name(out).alias("sidecar"))


@query("route_files", """SELECT path, CASE WHEN s = 'pdf' THEN 'vector' WHEN s IN ('png','jpg','jpeg','tif','tiff','bmp') THEN 'raster'
  WHEN seq % 4 = 0 THEN 'vector' WHEN seq % 4 = 1 THEN 'raster' WHEN seq % 4 = 2 THEN 'raster' END AS route
FROM (SELECT *, LOWER(REGEXP_EXTRACT(path, '\\.([^./]+)$', 1)) AS s FROM file_list)""", ("file_list",))
def _route(t):
    n = F.col("seq") % 4
    content = (F.when(n == 0, F.encode(F.concat(F.repeat(F.lit("x"), 900), F.lit("%PDF-1.7")), "UTF-8"))
               .when(n == 1, F.unhex(F.lit("89504E470D0A"))).when(n == 2, F.unhex(F.lit("4D4D002A00")))
               .otherwise(F.encode(F.lit("hello"), "UTF-8")))
    return files.route_files(t.file_list.withColumn("content", content)).select("path", "route")


@query("route_pages", """SELECT page_id, CASE WHEN CONTAINS(html[:1024], '%PDF-') THEN 'vector' WHEN html LIKE 'BM%' THEN 'raster' END AS route FROM pages""")
def _route_pages(t):
    pages = table(t.spark, t.sf_dir, "pages").withColumn("content", F.encode("html", "UTF-8"))
    return pages.select("page_id", files.route_by_content(F.col("content")).alias("route"))


CLEAN = ("REGEXP_REPLACE(path, '/(?:\\./|/)+', '/', 'g')")


@query("build_manifest", f"""WITH ok AS (SELECT MIN(seq) AS seq, {CLEAN} AS path FROM file_list WHERE exists AND LOWER(REGEXP_EXTRACT(path, '\\.([^./]+)$', 1)) = 'pdf' GROUP BY 2)
SELECT seq, path, {NAME} AS mirrored_name, {WARN} AS naming_warning, 'queued' AS status FROM ok""", ("file_list",))
def _manifest(t):
    return batch.build_manifest(t.file_list)


@query("manifest_counts", f"""WITH ok AS (SELECT DISTINCT {CLEAN} AS path FROM file_list WHERE exists AND LOWER(REGEXP_EXTRACT(path, '\\.([^./]+)$', 1)) = 'pdf')
SELECT COUNT(*) AS added, COUNT(*) FILTER ({WARN}) AS naming_warnings, (SELECT COUNT(*) FROM file_list WHERE NOT (exists AND LOWER(REGEXP_EXTRACT(path, '\\.([^./]+)$', 1)) = 'pdf')) AS rejected FROM ok""", ("file_list",))
def _manifest_counts(t):
    listing = t.file_list
    return batch.manifest_counts(listing, batch.build_manifest(listing))


@query("export_names", """WITH e AS (SELECT o_orderkey AS seq, 'plan' || o_custkey % 5 AS stem, CAST(o_orderkey % 3 AS INT) AS page_index, CAST(1 + o_orderkey % 2 * 4 AS INT) AS page_count FROM orders),
b AS (SELECT *, stem || CASE WHEN page_count > 1 THEN '_p' || LPAD(CAST(page_index + 1 AS VARCHAR), 2, '0') ELSE '' END AS base FROM e),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY base ORDER BY seq) AS k FROM b)
SELECT seq, base, base || CASE WHEN slot = 1 THEN '' ELSE '_' || slot END || '.jpg' AS export_name FROM (
  SELECT seq, base, CASE WHEN base NOT IN ('plan0', 'plan1_p01') THEN k WHEN base = 'plan0' THEN CASE WHEN k < 2 THEN k + 1 WHEN k = 2 THEN 4 ELSE k + 2 END ELSE CASE WHEN k < 2 THEN k ELSE k + 1 END END AS slot FROM k)""")
def _export(t):
    o = table(t.spark, t.sf_dir, "orders")
    exports = o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("plan"), (F.col("o_custkey") % 5).cast("string")).alias("stem"),
                       (F.col("o_orderkey") % 3).cast("int").alias("page_index"), (1 + F.col("o_orderkey") % 2 * 4).cast("int").alias("page_count"))
    taken = t.spark.sql("SELECT * FROM VALUES ('plan0'), ('plan0_3'), ('plan1_p01_2'), ('plan1_p01_02') AS x(name)")
    return batch.export_names(exports, taken, ["seq"]).select("seq", "base", "export_name")


@query("classify_inputs", """WITH pg AS (SELECT i.doc_id, i.page_index, COUNT(*) AS pictures, SUM(GREATEST(0, LEAST(i.x1, p.width) - GREATEST(i.x0, 0)) * GREATEST(0, LEAST(i.y1, p.height) - GREATEST(i.y0, 0))) AS covered, ANY_VALUE(p.width * p.height) AS page_area
  FROM page_images AS i JOIN plan_pages AS p ON p.doc_id = i.doc_id AND p.page_index = i.page_index GROUP BY i.doc_id, i.page_index),
f AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY page_index) AS rn FROM pg) WHERE rn = 1),
c AS (SELECT d.*, f.page_index, f.pictures, LEAST(covered / GREATEST(page_area, 1e-9), 1) AS share, CASE WHEN LOWER(REGEXP_EXTRACT(path, '(\\.[^./]+)$', 1)) <> '.pdf' THEN 'Not a PDF'
  WHEN error IS NOT NULL THEN 'Unreadable PDF' WHEN page_count = 0 THEN 'Empty PDF' WHEN f.doc_id IS NOT NULL THEN 'Mixed image PDF' END AS badge FROM input_documents AS d LEFT JOIN f ON f.doc_id = d.doc_id)
SELECT doc_id, badge, CASE WHEN badge = 'Mixed image PDF' THEN 'mixed-image' WHEN badge IS NOT NULL THEN 'other' END AS kind, CASE WHEN badge = 'Mixed image PDF' THEN pictures END AS pictures,
  CASE WHEN badge = 'Mixed image PDF' THEN ROUND(share, 6) END AS share, CASE WHEN badge = 'Mixed image PDF' THEN share >= 0.5::DOUBLE END AS underlay FROM c""", ("input_documents", "plan_pages", "page_images"))
def _classify(t):
    out = batch.classify_inputs(t.input_documents, t.plan_pages, t.page_images)
    return out.select("doc_id", "badge", "kind", "pictures", F.round("share", 6).alias("share"),
                      F.when(F.col("kind") == "mixed-image", F.col("reason").contains("not vector lines")).alias("underlay"))


@query("blocking_problem", """SELECT seq, CASE WHEN seq % 4 = 0 THEN NULL ELSE badge END AS blocking FROM file_list""", ("file_list",))
def _blocking(t):
    labels = F.when(F.col("seq") % 4 == 0, F.lit("reviewed"))
    return t.file_list.select("seq", batch.blocking_problem(F.col("badge"), labels).alias("blocking"))


@query("batch_summary", """WITH s AS (SELECT batch, COUNT(*) FILTER (status = 'completed') AS completed, COUNT(*) FILTER (status = 'failed') AS failed,
  COUNT(*) FILTER (status = 'queued' AND badge IS NOT NULL) AS skipped, MIN(error) FILTER (status = 'failed') AS e, COUNT(DISTINCT badge) FILTER (status = 'failed') AS nb,
  COUNT(*) FILTER (status = 'failed' AND badge IS NULL) AS o, MIN(reason) FILTER (status = 'failed') AS r FROM (SELECT *, batch || CASE WHEN seq % 40 = 3 THEN 'x' ELSE '' END AS b2 FROM file_list) GROUP BY batch)
SELECT batch, completed, failed, skipped, CASE WHEN failed = 0 THEN '' WHEN failed = 1 THEN e WHEN o = 0 AND nb = 1 THEN CASE WHEN failed = 2 THEN 'Both' ELSE 'All ' || failed END || ': ' || r
  ELSE 'See each failed plan for its reason.' END AS failure FROM s""", ("file_list",))
def _batch_summary(t):
    return batch.batch_summary(t.file_list, ["batch"])


@query("selection", "SELECT seq, path FROM file_list WHERE path IN (SELECT path FROM file_list WHERE seq % 5 = 2)", ("file_list",))
def _selection(t):
    chosen = t.file_list.where(F.col("seq") % 5 == 2)
    return batch.selection(t.file_list, chosen).select("seq", "path")


# --- flags and records ---------------------------------------------------------------------

@query("union_flags", """SELECT sheet_id, code, message, severity FROM run_flags WHERE severity = 'warn'
UNION ALL SELECT sheet_id, 'upscaled', 'sheet enlarged', 'info' FROM sheets WHERE sheet_id % 3 = 0""", ("run_flags", "sheets"))
def _union_flags(t):
    sheet = t.sheets.where(F.col("sheet_id") % 3 == 0).select(
        "sheet_id", F.lit("upscaled").alias("code"), F.lit("sheet enlarged").alias("message"), F.lit("info").alias("severity"))
    return batch.union_flags(sheet, t.run_flags)


@query("review_summary", """SELECT *, CASE WHEN errors > 0 THEN errors || ' error(s) need attention' WHEN warnings > 0 THEN warnings || ' item(s) to review' ELSE 'Ready to save' END AS label
FROM (SELECT sheet_id, COUNT(*) FILTER (severity = 'error') AS errors, COUNT(*) FILTER (severity = 'warn') AS warnings, COUNT(*) FILTER (severity NOT IN ('error','warn')) AS information
  FROM run_flags GROUP BY sheet_id)""", ("run_flags",))
def _review_summary(t):
    return batch.review_summary(t.run_flags, ["sheet_id"])


PAGE_FLAGS = "pf AS (SELECT sheet_id AS doc_id, CAST(run_id % 3 AS INT) AS page_index, code, message, severity FROM run_flags)"


def page_flags(t):
    return t.run_flags.select(F.col("sheet_id").alias("doc_id"), (F.col("run_id") % 3).cast("int").alias("page_index"),
                              "code", "message", "severity")


@query("job_totals", f"""WITH {PAGE_FLAGS} SELECT p.doc_id, COUNT(*) AS pages, SUM(text_runs_mirrored)::BIGINT AS runs, COALESCE(ANY_VALUE(f.n), 0) AS flags FROM plan_pages AS p
LEFT JOIN (SELECT doc_id, COUNT(*) AS n FROM pf GROUP BY doc_id) AS f ON f.doc_id = p.doc_id GROUP BY p.doc_id""", ("run_flags", "plan_pages"))
def _job_totals(t):
    return batch.job_totals(t.plan_pages, page_flags(t))


@query("job_records", f"""WITH {PAGE_FLAGS}, n AS (SELECT p.doc_id, p.page_index, p.text_runs_mirrored, COUNT(f.doc_id) AS flags, COALESCE(MIN(f.code || '|' || f.message), '') AS first_flag
  FROM plan_pages AS p LEFT JOIN pf AS f ON f.doc_id = p.doc_id AND f.page_index = p.page_index GROUP BY p.doc_id, p.page_index, p.text_runs_mirrored)
SELECT doc_id, COUNT(*) AS pages, SUM(flags)::BIGINT AS flags, STRING_AGG(page_index || ':' || text_runs_mirrored || ':' || flags || ':' || first_flag, ';' ORDER BY page_index) AS listing, 'v' AS axis FROM n GROUP BY doc_id""",
       ("run_flags", "plan_pages"))
def _job_records(t):
    jobs = t.plan_pages.select("doc_id").distinct().select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source"), F.lit("out.pdf").alias("output"),
        F.lit("v").alias("axis"), F.lit("vector").alias("route"))
    rec = batch.job_records(jobs, t.plan_pages, page_flags(t))
    line = F.transform("pages", lambda p: F.concat_ws(":", p["index"].cast("string"), p["text_runs_mirrored"].cast("string"),
                                                      F.size(p["flags"]).cast("string"), F.coalesce(F.concat(
                                                          F.get(p["flags"], 0)["code"], F.lit("|"), F.get(p["flags"], 0)["message"]), F.lit(""))))
    flags = F.aggregate("pages", F.lit(0).cast("long"), lambda a, p: a + F.size(p["flags"]))
    return rec.select("doc_id", F.size("pages").cast("long").alias("pages"), flags.alias("flags"),
                      F.array_join(line, ";").alias("listing"), "axis")


@query("top_findings", """WITH r AS (SELECT sheet_id, CAST(pass_id + 1 AS INT) AS page, text, ROW_NUMBER() OVER (PARTITION BY sheet_id ORDER BY pass_id, det_idx) AS rn, COUNT(*) OVER (PARTITION BY sheet_id) AS total FROM detections)
SELECT sheet_id, ANY_VALUE(total) AS total, STRING_AGG('p.' || page || ': ''' || text || '''', ', ' ORDER BY rn) || CASE WHEN ANY_VALUE(total) > 3 THEN ', and ' || (ANY_VALUE(total) - 3) || ' more' ELSE '' END AS summary
FROM r WHERE rn <= 3 GROUP BY sheet_id""", ("detections",))
def _top(t):
    found = t.detections.select("sheet_id", (F.col("pass_id") + 1).alias("page"), "text", "pass_id", "det_idx")
    return batch.top_findings(found, ["sheet_id"], ["pass_id", "det_idx"])


@query("truth_payload", """SELECT sheet_id, COUNT(*) AS runs, STRING_AGG(text || '@' || x0, ',' ORDER BY truth_idx) AS listing FROM truth GROUP BY sheet_id""", ("truth",))
def _payload(t):
    sheets = t.truth.select("sheet_id").distinct().withColumns({"image": F.lit("a.png"), "dpi": F.lit(150), "zoom": F.lit(150 / 72)})
    out = truth.truth_payload(t.truth.withColumn("cap_height_px", F.lit(12.5)), sheets)
    return out.select("sheet_id", F.size("runs").cast("long").alias("runs"), F.array_join(F.transform(
        "runs", lambda r: F.concat(r["text"], F.lit("@"), r["bbox_px"][0].cast("string"))), ",").alias("listing"))
