"""File names, manifests, job records and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import flags as FL, geometry as G
from planloom.operators.ranking import rank_within
from planloom.session import cut_lineage

# fixed values: name patterns (folder, stem, suffix) and the orientation field
NAME_PARTS = r"^(.*/)?([^/]+?)(\.[^./]+)?$"
ORIENTATION_FIELD = r"^(.*?-)([RS])(-V\d+(?:-.*)?)$"
SIDECAR_SUFFIX = ".planloom.json"

#: A nested job record holds at most this many flags; more go to further parts.
PART_FLAGS = 10_000


def name_parts(path: Column) -> tuple[Column, Column, Column]:
    """(folder with slash, stem, suffix with dot)."""
    return tuple(F.regexp_extract(path, NAME_PARTS, i) for i in (1, 2, 3))


def default_output_name(path: Column) -> Column:
    return F.regexp_replace(path, NAME_PARTS, "$1$2_mirrored$3")


def sidecar_name(output: Column, suffix: str = SIDECAR_SUFFIX) -> Column:
    return F.concat(output, F.lit(suffix))


def counterpart_name(name: Column) -> Column:
    """STRUCT<name, naming_warning>: swap R and S in the first orientation
    field of the stem; without one append _mirrored and warn."""
    _, stem, suffix = name_parts(name)
    has = stem.rlike(ORIENTATION_FIELD)
    first, mark, rest = (F.regexp_extract(stem, ORIENTATION_FIELD, i) for i in (1, 2, 3))
    swapped = F.concat(first, F.translate(mark, "RS", "SR"), rest, suffix)
    return F.struct(F.when(has, swapped).otherwise(F.concat(stem, F.lit("_mirrored"), suffix)).alias("name"),
                    (~has).alias("naming_warning"))


def clean_path(path: Column) -> Column:
    """Collapse //, /./ and folder/../ steps, however many there are.

    A step up beyond the root stays at the root; one beyond the start of a
    relative path is kept.
    """
    parts = F.split(path, "/")
    rooted = F.startswith(path, F.lit("/"))
    top = F.try_element_at
    start = F.array().cast("array<string>")

    def step(kept, part):
        last = top(kept, F.lit(-1))
        up = part == ".."
        poppable = last.isNotNull() & (last != "..")
        return (F.when((part == "") | (part == "."), kept)
                .when(up & poppable, F.slice(kept, 1, F.size(kept) - 1))
                .when(up & rooted, kept)
                .otherwise(F.concat(kept, F.array(part))))

    joined = F.array_join(F.aggregate(parts, start, step), "/")
    folder = F.when(F.endswith(path, F.lit("/")) & (joined != ""), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), joined, folder)


def export_names(exports: DataFrame, existing: DataFrame, order: list[str], suffix: str = ".jpg") -> DataFrame:
    """Add ``base`` and ``export_name``: _pNN only for several pages, then the
    first free of base, base_2, base_3, ...

    ``exports`` has stem, page_index, page_count; ``existing`` has name (stems
    in use). A taken number pushes later copies up by one, so the number of a
    copy is its position among the copies and taken numbers of its base, with
    a taken number placed before the copy it displaces. Both rankings spread
    over tasks when one base holds very many copies.
    """
    page = F.when(F.col("page_count") > 1, F.concat(F.lit("_p"), F.lpad(
        (F.col("page_index") + 1).cast("string"), 2, "0"))).otherwise("")
    # lpad would cut numbers of three digits and more
    page = F.when((F.col("page_count") > 1) & (F.col("page_index") >= 99), F.concat(
        F.lit("_p"), (F.col("page_index") + 1).cast("string"))).otherwise(page)
    work = exports.withColumn("base", F.concat(F.col("stem"), page))
    names = work.select(*order, "base", F.col("base").alias("_b"))
    while True:
        numbered = _free_numbers(names, existing, order)
        chosen = F.when(F.col("_slot") == 1, F.col("base")).otherwise(
            F.concat(F.col("base"), F.lit("_"), F.col("_slot").cast("string")))
        numbered = cut_lineage(numbered.withColumn("export_name", chosen))
        # a copy of one base may have taken the plain name of another base
        twice = (numbered.groupBy("export_name").agg(F.count("*").alias("n"),
                                                     F.min(F.struct(*order)).alias("keep"))
                 .where(F.col("n") > 1).select("export_name", "keep"))
        if twice.isEmpty():
            break
        kept = numbered.join(twice, "export_name").where(F.struct(*order) == F.col("keep"))
        existing = cut_lineage(existing.select("name").unionByName(
            kept.select(F.col("export_name").alias("name"))))
        settled = kept.select(*order, "base", "export_name")
        rest = cut_lineage(names.join(settled.select(*order), order, "left_anti"))
        return _with_names(work, settled.unionByName(
            export_names_rest(rest, existing, order)), order, suffix)
    return _with_names(work, numbered.select(*order, "base", "export_name"), order, suffix)


def export_names_rest(names: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Names for the remaining rows once some names are settled."""
    work = names.withColumns({"stem": F.col("base"), "page_index": F.lit(0), "page_count": F.lit(1)})
    out = export_names(work.drop("base", "_b"), existing, order, "")
    return out.select(*order, "base", "export_name")


def _with_names(work, named, order, suffix):
    return (work.join(named.select(*order, "export_name"), order)
            .withColumn("export_name", F.concat("export_name", F.lit(suffix))))


def _free_numbers(names, existing, order):
    plain = existing.select(F.col("name").alias("base"), F.lit(1).cast("long").alias("used"))
    tail = r"^(.+)_([1-9]\d{0,17})$"
    counted = (existing.where(F.col("name").rlike(tail))
               .select(F.regexp_extract("name", tail, 1).alias("base"),
                       F.regexp_extract("name", tail, 2).cast("long").alias("used"))
               .where(F.col("used") >= 2))
    taken = (plain.unionByName(counted).distinct()
             .join(names.select("base").distinct(), "base", "left_semi"))
    taken = rank_within(taken, ["base"], ["used"], "_i")
    # free numbers up to and including the one a taken number sits on
    marks = taken.select("base", (F.col("used") - F.col("_i")).alias("_key"), F.lit(1).alias("_t"),
                         F.col("used").alias("_tie"), *[F.lit(None).cast(names.schema[c].dataType).alias(c)
                                                        for c in order])
    copies = rank_within(names.drop("_b"), ["base"], order, "_k")
    asked = copies.select("base", F.col("_k").alias("_key"), F.lit(0).alias("_t"),
                          F.lit(0).cast("long").alias("_tie"), *order)
    slots = rank_within(marks.unionByName(asked), ["base"], ["_key", "_t", "_tie"], "_slot")
    return slots.where(F.col("_t") == 0).select(*order, "base", "_slot")


def build_manifest(listing: DataFrame, suffixes=K.VECTOR_SUFFIXES) -> DataFrame:
    """First sighting of every accepted path, with its counterpart name.

    ``listing`` has seq (order of arrival), path and exists.
    """
    accepted = listing.withColumn("ok", F.col("exists") & F.lower(F.regexp_extract(
        "path", r"\.([^./]+)$", 1)).isin(*suffixes)).where("ok")
    first = (accepted.withColumn("path", clean_path(F.col("path")))
             .groupBy("path").agg(F.min("seq").alias("seq")))
    folder, stem, suffix = name_parts(F.col("path"))
    twin = counterpart_name(F.concat(stem, suffix))
    return (first.withColumn("_twin", twin)
            .select("seq", "path", F.col("_twin.name").alias("mirrored_name"),
                    F.col("_twin.naming_warning").alias("naming_warning"),
                    F.lit("queued").alias("status")))


def manifest_counts(listing: DataFrame, manifest: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """One row: added, rejected, naming warnings and (if given) problems."""
    ok = F.col("exists") & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*K.VECTOR_SUFFIXES)
    parts = [listing.select(F.when(~ok, "rejected").alias("what")),
             manifest.select(F.lit("added").alias("what")),
             manifest.where("naming_warning").select(F.lit("naming_warnings").alias("what"))]
    names = ["added", "rejected", "naming_warnings"]
    if problems is not None:
        names.append("problems")
        parts.append(manifest.join(problems.where(F.col("kind").isNotNull()).select("path"), "path", "left_semi")
                     .select(F.lit("problems").alias("what")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.agg(*[F.count_if(F.col("what") == n).alias(n) for n in names])


def blocking_problem(problem: Column, picture_labels: Column) -> Column:
    """A reviewed picture plan is no longer blocked."""
    return F.when(picture_labels.isNotNull(), F.lit(None)).otherwise(problem)


def classify_inputs(documents: DataFrame, pages: DataFrame, page_images: DataFrame) -> DataFrame:
    """Per document: badge, place, reason and kind of what blocks it (NULL = fine).

    ``documents``: doc_id, path, error (NULL = readable), page_count.
    """
    page_box = (F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
    pictures = page_images.join(pages.select("doc_id", "page_index", "width", "height"),
                                ["doc_id", "page_index"])
    per_page = (pictures.groupBy("doc_id", "page_index", "width", "height")
                .agg(F.count("*").alias("pictures"),
                     F.sum(G.intersection(G.box_of(), page_box)).alias("covered")))
    first = per_page.groupBy("doc_id").agg(F.min_by(F.struct(
        "page_index", "pictures", "covered", "width", "height"), "page_index").alias("p"))
    share = F.least(F.col("p.covered") / F.greatest(F.col("p.width") * F.col("p.height"), F.lit(1e-9)),
                    F.lit(1.0))
    out = documents.join(first, "doc_id", "left").withColumn("share", share)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    is_pdf = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)) == ".pdf"
    case = (F.when(~is_pdf, "not-pdf").when(F.col("error").isNotNull(), "unreadable")
            .when(F.col("page_count") == 0, "empty").when(F.col("p").isNotNull(), "mixed-image"))
    out = out.withColumn("_case", case)
    c = F.col("_case")
    reason = (F.when(c == "not-pdf", "only vector PDF files are accepted.")
              .when(c == "unreadable", F.concat(F.lit("could not be read as a PDF ("), F.col("error"), F.lit(").")))
              .when(c == "empty", "the PDF has no pages.")
              .when(c == "mixed-image", F.concat(F.format_string(
                  "has %d picture(s) covering %.0f%% of the page; ", F.col("p.pictures"), share * 100),
                  F.when(share >= 0.5, "the walls and linework are pictures, not vector lines. Export again as vector.")
                  .otherwise("probably a logo or underlay; hide it and export again as vector."))))
    badge = (F.when(c == "not-pdf", "Not a PDF").when(c == "unreadable", "Unreadable PDF")
             .when(c == "empty", "Empty PDF").when(c == "mixed-image", "Mixed image PDF"))
    where = F.when(c == "mixed-image", F.format_string("%s, page %d", name, F.col("p.page_index") + 1)).otherwise(name)
    return out.select("doc_id", "path", badge.alias("badge"), F.when(c.isNotNull(), where).alias("where"),
                      reason.alias("reason"), F.when(c == "mixed-image", c).when(c.isNotNull(), "other").alias("kind"),
                      F.when(c == "mixed-image", F.col("p.pictures")).alias("pictures"),
                      F.when(c == "mixed-image", F.col("share")).alias("share"))


# --- job records ------------------------------------------------------------------------

def union_flags(sheet_flags: DataFrame, run_flags: DataFrame) -> DataFrame:
    """Sheet flags, and of the run flags only warnings."""
    cols = ["sheet_id", "code", "message", "severity"]
    return sheet_flags.select(*cols).unionByName(run_flags.where(F.col("severity") == "warn").select(*cols))


def job_records(jobs: DataFrame, pages: DataFrame, flags: DataFrame, version: str = "1",
                part_flags: int = PART_FLAGS) -> DataFrame:
    """Nested record per job: source, output, axis, route, version, pages[...].

    ``flags`` has doc_id, page_index, code, message, severity. A record holds
    at most about ``part_flags`` flags and as many pages; a larger job is split
    into numbered parts (``part``), so that no list grows with the data. Parts
    of a page repeat its size and together hold each flag once.
    """
    counted = flags.groupBy("doc_id", "page_index").agg(F.count("*").alias("_n"))
    sized = (pages.join(counted, ["doc_id", "page_index"], "left")
             .withColumn("_parts", F.ceil(F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)) / part_flags)))
    slots = sized.withColumn("_slot", F.explode(F.sequence(F.lit(0), (F.col("_parts") - 1).cast("int"))))
    # Equal flags are counted first and numbered apart, so that the part of a
    # flag follows from its own values and a lost task recomputes the same parts.
    copies = (flags.groupBy("doc_id", "page_index", "code", "message", "severity").agg(F.count("*").alias("_c"))
              .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c")))))
    spread = (copies.join(sized.select("doc_id", "page_index", "_parts"), ["doc_id", "page_index"])
              .withColumn("_slot", F.pmod(F.xxhash64("code", "message", "severity", "_copy"),
                                          F.col("_parts")).cast("int")))
    listed = spread.groupBy("doc_id", "page_index", "_slot").agg(F.array_sort(F.collect_list(
        F.struct("code", "message", "severity"))).alias("flags"))
    filled = (slots.join(listed, ["doc_id", "page_index", "_slot"], "left")
              .withColumn("flags", F.coalesce("flags", FL.no_flags())))
    # pages of a job are grouped by blocks of page numbers; a page slot is one part
    block = F.floor(F.col("page_index") / 1000)
    filled = filled.withColumn("_block", F.struct(block.alias("b"), F.col("_slot").alias("s"),
                               F.when(F.col("_n") > part_flags // 10, F.col("page_index")).otherwise(-1).alias("p")))
    packed = filled.groupBy("doc_id", "_block").agg(F.array_sort(F.collect_list(F.struct(
        F.col("page_index").alias("index"), "width", "height", "text_runs_mirrored", "flags"))).alias("pages"))
    packed = packed.withColumn("part", F.when(
        (F.col("_block.b") == 0) & (F.col("_block.s") == 0) & (F.col("_block.p") == -1), F.lit("0")).otherwise(
        F.concat_ws("-", F.col("_block.b"), F.col("_block.s"), F.col("_block.p"))))
    return (jobs.join(packed.drop("_block"), "doc_id", "left")
            .withColumn("version", F.lit(version)).withColumn("part", F.coalesce("part", F.lit("0"))))


def write_sidecar(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    records.write.mode(mode).json(path)


def job_totals(pages: DataFrame, flags: DataFrame) -> DataFrame:
    """Pages, runs and flags per job."""
    counted = flags.groupBy("doc_id").agg(F.count("*").alias("flags"))
    return (pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("text_runs_mirrored").alias("runs"))
            .join(counted, "doc_id", "left").withColumn("flags", F.coalesce("flags", F.lit(0))))


def review_summary(flags: DataFrame, by: list[str]) -> DataFrame:
    """Errors, warnings, information and the label of the review."""
    out = flags.groupBy(*by).agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warn").alias("warnings"),
        F.count_if(~F.col("severity").isin("error", "warn")).alias("information"))
    return out.withColumn("label", review_label())


def review_label() -> Column:
    return (F.when(F.col("errors") > 0, F.format_string("%d error(s) need attention", "errors"))
            .when(F.col("warnings") > 0, F.format_string("%d item(s) to review", "warnings"))
            .otherwise("Ready to save"))


def verification_summary(report: DataFrame) -> DataFrame:
    """A passed check is one information, a failed one an error plus its issues."""
    return (report.select("sheet_id", F.when(F.col("passed"), 0).otherwise(1).alias("errors"),
                          F.when(F.col("passed"), 0).otherwise(F.col("issues")).alias("warnings"),
                          F.when(F.col("passed"), 1).otherwise(0).alias("information"))
            .withColumn("label", review_label()))


def batch_summary(manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Completed, failed, skipped and one line on why entries failed.

    ``manifest`` has status, error, badge, reason (of a blocking problem).
    """
    failed = F.col("status") == "failed"
    out = manifest.groupBy(*(by or [])).agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(failed).alias("failed"),
        F.count_if((F.col("status") == "queued") & F.col("badge").isNotNull()).alias("skipped"),
        F.min(F.when(failed, F.col("error"))).alias("_error"),
        F.min(F.when(failed, F.col("badge"))).alias("_b0"), F.max(F.when(failed, F.col("badge"))).alias("_b1"),
        F.count_if(failed & F.col("badge").isNull()).alias("_open"),
        F.min(F.when(failed, F.col("reason"))).alias("_reason"))
    who = F.when(F.col("failed") == 2, "Both").otherwise(F.format_string("All %d", "failed"))
    text = (F.when(F.col("failed") == 0, "")
            .when(F.col("failed") == 1, F.coalesce("_error", F.lit("")))
            .when((F.col("_open") == 0) & (F.col("_b0") == F.col("_b1")), F.concat(who, F.lit(": "), F.col("_reason")))
            .otherwise("See each failed plan for its reason."))
    return out.select(*(by or []), "completed", "failed", "skipped", text.alias("failure"))


def top_findings(findings: DataFrame, by: list[str], order: list[str], show: int = 3) -> DataFrame:
    """First labels of each group and how many more there are.

    The first rows come from a rank filter, which Spark cuts to ``show`` rows
    per group and task before the shuffle.
    """
    from pyspark.sql import Window

    total = findings.groupBy(*by).agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    label = F.format_string("p.%d: '%s'", "page", "text")
    first = (findings.withColumn("_rn", rank).where(F.col("_rn") <= show)
             .groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                 F.struct("_rn", label.alias("label")))), lambda x: x["label"]), ", ").alias("shown")))
    more = F.when(F.col("total") > show, F.format_string(f", and %d more", F.col("total") - show)).otherwise("")
    return first.join(total, by).select(*by, "total", F.concat("shown", more).alias("summary"))


def selection(manifest: DataFrame, chosen: DataFrame, on=("path",)) -> DataFrame:
    """The chosen subset of a manifest (or of its pages)."""
    return manifest.join(chosen.select(*on).distinct(), list(on), "left_semi")
