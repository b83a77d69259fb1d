"""From raw reading passes to a clean list of text runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import flags as FL, geometry as G, text as T
from planloom.operators.match import inside_protected, outside_protected
from planloom.operators.spatial import CELL, boxes_hit
from planloom.operators.vocab import Vocabulary, snap_text
from planloom.session import dealt, hot_keys, split_hot, written


#: Runs of a sheet whose tilts one task sorts.
SORT_LIMIT = 20_000

#: Shorter lines corroborate no run.
LEAST_REACH = 20.0

#: Windows beside runs are wider than runs, and are listed in larger cells.
WINDOW_CELL = 4 * CELL


def with_bbox(df: DataFrame, quad: str = "quad") -> DataFrame:
    return df.withColumns(dict(zip(G.BOX, G.quad_box(quad))))


def with_center(df: DataFrame) -> DataFrame:
    cx, cy = G.box_center(G.box_of())
    return df.withColumns({"cx": cx, "cy": cy})


def union_passes(*passes: DataFrame) -> DataFrame:
    """Stack the reading passes; the pass number is the tie-break of the merge."""
    if len(passes) > len(K.PASS_ANGLES):
        raise ValueError(f"{len(passes)} passes given; angles are known for {len(K.PASS_ANGLES)}")
    out = None
    for (number, angle), df in zip(K.PASS_ANGLES, passes):
        df = df.withColumns({"pass_id": F.lit(number), "angle_deg": F.lit(angle)})
        out = df if out is None else out.unionByName(df)
    return out


def unrotate_quads(df: DataFrame, width="width", height="height") -> DataFrame:
    """Quads of turned frames in upright sheet coordinates (needs sheet size)."""
    return df.withColumn("quad", G.unrotate_quad("quad", F.col("pass_id"), F.col(width), F.col(height)))


def drop_degenerate(df: DataFrame) -> DataFrame:
    return df.where(G.area(G.box_of()) > 0)


def orientation_plausible(text: Column, angle: Column) -> Column:
    """Does the shape of the box agree with the pass that read it?"""
    x0, y0, x1, y1 = G.box_of()
    w, h = x1 - x0, y1 - y0
    return ((F.length(text) < 2)
            | F.when(F.abs(angle) < 45, h <= K.PLAUSIBLE_ASPECT * w)
            .otherwise(w <= K.PLAUSIBLE_ASPECT * h))


def canonical_vertical(angle: Column) -> Column:
    return F.when(angle == -90.0, 90.0).otherwise(angle)


def merge_rereads(dets: DataFrame, rereads: DataFrame, on=("sheet_id",)) -> DataFrame:
    """Adopt the text of a confident second reading of an uncertain short run.

    ``rereads`` holds what was read on a twice enlarged crop: crop coordinates
    x0..y1, crop_x, crop_y (origin), text, conf; (on..., det_idx) names the run.
    Only texts change; geometry and the old confidence stay.
    """
    key = [*on, "det_idx"]
    listed = dets.where(T.strip(F.col("text")) != "").withColumn("text", T.strip(F.col("text")))
    once = (rereads.groupBy(*key)
            .agg(F.count("*").alias("r_n"), F.first(F.struct(
                T.strip(F.col("text")).alias("text"), "conf",
                (F.col("x0") / 2 + F.col("crop_x")).alias("x0"),
                (F.col("y0") / 2 + F.col("crop_y")).alias("y0"),
                (F.col("x1") / 2 + F.col("crop_x")).alias("x1"),
                (F.col("y1") / 2 + F.col("crop_y")).alias("y1"))).alias("r"))
            .where(F.col("r_n") == 1).drop("r_n"))
    again = tuple(F.col("r." + c) for c in G.BOX)
    adopt = ((F.col("conf") < K.LOW_CONFIDENCE) & F.length("text").between(2, 5)
             & (F.length("r.text") == F.length("text")) & (F.col("r.conf") > F.col("conf"))
             & (G.coverage(G.box_of(), again) >= K.REREAD_OVERLAP))
    return (listed.join(once, key, "left")
            .withColumn("text", F.when(adopt, F.col("r.text")).otherwise(F.col("text")))
            .select(*dets.columns))


def line_corroboration(runs: DataFrame, segments: DataFrame, on=("sheet_id",), ids=("det_idx",),
                       cell: float = WINDOW_CELL) -> DataFrame:
    """Digit-only runs with a drawn line of the same direction beside them.

    Returns distinct (on..., ids...).
    """
    x0, y0, x1, y1 = G.box_of()
    w, h = x1 - x0, y1 - y0
    pad = F.floor(2 * F.least(w, h))
    near = (runs.where(F.col("text").rlike("^[0-9]+$"))
            .withColumns({"wx0": F.floor(x0) - pad, "wy0": F.floor(y0) - pad,
                          "wx1": F.floor(x1) + pad, "wy1": F.floor(y1) + pad,
                          "reach": F.greatest(F.lit(LEAST_REACH), 0.6 * F.greatest(w, h))}))
    lines = segments.select(
        *on, F.least("x0", "x1").alias("s_x0"), F.least("y0", "y1").alias("s_y0"),
        F.greatest("x0", "x1").alias("s_x1"), F.greatest("y0", "y1").alias("s_y1"),
        F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("s_len"),
        F.degrees(F.atan2(-(F.col("y1") - F.col("y0")), F.col("x1") - F.col("x0"))).alias("s_angle")).where(
        F.col("s_len") >= LEAST_REACH)
    window = ("wx0", "wy0", "wx1", "wy1")
    keys = list(dict.fromkeys([*on, *ids]))
    wide = near.select(*keys, *window, "reach", "angle_deg", *G.BOX)
    off_box = ((F.col("s_x1") < x0 - 3) | (F.col("s_x0") > x1 + 3)
               | (F.col("s_y1") < y0 - 3) | (F.col("s_y0") > y1 + 3))
    turn = F.abs(F.pmod(F.col("s_angle") - F.col("angle_deg") + 90.0, F.lit(180.0)) - 90.0)
    rule = off_box & (F.col("s_len") >= F.col("reach")) & (turn <= 3.0)
    return boxes_hit(wide, lines, list(on), keys, ("s_x0", "s_y0", "s_x1", "s_y1"), window, closed=True, cell=cell,
                     extra=rule, carry=["reach", "angle_deg", *G.BOX])


def corroborate_tilts(df: DataFrame, on=("sheet_id",), ids=("det_idx",),
                      corroborated: DataFrame | None = None, sort_limit: int = SORT_LIMIT,
                      among: Column | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Snap a lone slight tilt to its cardinal; keep tilts that agree.

    A tilt agrees when another ambiguous run of the sheet and cardinal deviates
    within one degree. On sheets of ordinary size a sort shows the next smaller
    and larger deviation. On sheets above ``sort_limit`` rows deviations are
    counted in one-degree bins: two runs in a bin agree by themselves, and otherwise
    only the nearest values of the neighbouring bins matter. There are at most 40 bins
    per sheet and cardinal, so no run list of such a sheet is ever gathered.

    ``among`` names the rows that take part; the others stay as they are. ``counted`` has at least the rows
    of ``df`` on each sheet: its sheets are counted instead, and ``df``, already spread by sheet, is not dealt out again.
    """
    on, ids = list(on), list(ids)
    among = F.lit(True) if among is None else among
    if counted is None:
        normal, dense = split_hot(df, on, sort_limit)
        normal = dealt(normal, on, df)
    else:
        hot = hot_keys(counted, on, sort_limit)
        df = df if hot is None else written(df)
        normal, dense = (df, None) if hot is None else (df.join(hot, on, "left_anti"), df.join(hot, on, "left_semi"))
    out = _with_agreement(normal, on, among)
    if dense is not None:
        out = out.unionByName(_with_agreement_by_bins(dense, on, among))
    agrees = F.col("_agrees")
    if corroborated is not None:
        key = list(dict.fromkeys([*on, *ids]))
        out = out.join(corroborated.select(*key).distinct().withColumn("_line", F.lit(True)),
                       key, "left")
        agrees = agrees | F.col("_line").isNotNull()
    angle = F.when(F.col("_vague") & ~agrees, F.col("_card")).otherwise(F.col("angle_deg"))
    return out.withColumn("angle_deg", angle).select(*df.columns)


def _deviations(df: DataFrame, among: Column) -> DataFrame:
    """``df`` with the nearest cardinal, the deviation from it and whether that is ambiguous."""
    near = G.cardinal_deviation(F.col("angle_deg"))
    work = df.withColumn("_near", near).withColumns(
        {"_card": F.col("_near.cardinal"), "_dev": F.col("_near.dev")}).drop("_near")
    vague = (F.abs("_dev") >= K.ALWAYS_SNAP_DEG) & (F.abs("_dev") < K.UNAMBIGUOUS_TILT_DEG)
    return work.withColumn("_vague", F.coalesce(vague & among, F.lit(False)))


def _with_agreement(df: DataFrame, on: list[str], among: Column) -> DataFrame:
    work = _deviations(df, among).withColumn("_group", F.when(F.col("_vague"), F.col("_card")))
    in_order = Window.partitionBy(*on, "_group").orderBy("_dev")
    agrees = ((F.col("_dev") - F.lag("_dev").over(in_order) <= K.TILT_TOLERANCE_DEG)
              | (F.lead("_dev").over(in_order) - F.col("_dev") <= K.TILT_TOLERANCE_DEG))
    return work.withColumn("_agrees", F.coalesce(agrees, F.lit(False))).drop("_group")


def _with_agreement_by_bins(df: DataFrame, on: list[str], among: Column) -> DataFrame:
    work = _deviations(df, among)
    work = work.withColumn("_bin", F.when(F.col("_vague"), F.floor(F.col("_dev") / K.TILT_TOLERANCE_DEG)))
    # counting the bins (not filtering rows first) evaluates the deviation once
    bins = (work.groupBy(*on, "_card", "_bin")
            .agg(F.count("_bin").alias("n"), F.min("_dev").alias("lo"), F.max("_dev").alias("hi"))
            .where(F.col("n") > 0))
    # each bin offers itself to its own and both neighbouring bins
    offers = bins.select(*on, "_card", "n", "lo", "hi", F.col("_bin").alias("_from"),
                         F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1))
                         .alias("_bin"))
    around = offers.groupBy(*on, "_card", "_bin").agg(
        F.max(F.when(F.col("_from") == F.col("_bin"), F.col("n"))).alias("_own"),
        F.max(F.when(F.col("_from") < F.col("_bin"), F.col("hi"))).alias("_below"),
        F.min(F.when(F.col("_from") > F.col("_bin"), F.col("lo"))).alias("_above"))
    work = work.join(around, [*on, "_card", "_bin"], "left")
    agrees = ((F.col("_own") >= 2) | (F.col("_dev") - F.col("_below") <= K.TILT_TOLERANCE_DEG)
              | (F.col("_above") - F.col("_dev") <= K.TILT_TOLERANCE_DEG))
    return work.withColumn("_agrees", F.coalesce(agrees, F.lit(False))).drop("_bin", "_own", "_below", "_above")


def upscale_decision(dets: DataFrame, sheets: DataFrame, on=("sheet_id",)) -> DataFrame:
    """Per sheet: ``decision`` (keep, upscale, refuse) and ``factor``.

    The rule compares the interpolated median cap height with two limits. How
    many values lie below a limit, the largest value below it and the smallest
    one above decide that comparison, so no sheet's values are gathered.
    Symbols are left out unless a sheet has nothing else.
    """
    x0, y0, x1, y1 = G.box_of()
    cap = F.when(F.abs("angle_deg") > 45, x1 - x0).otherwise(y1 - y0) * K.CAP_SHARE
    text_like = ~T.is_graphical_symbol(F.col("text")) & ~T.is_wrong_script(F.col("text"))
    work = dets.select(*on, cap.alias("cap"), text_like.alias("ok"))
    aggs = []
    for name, cond in (("ok", F.col("ok")), ("any", F.lit(True))):
        aggs.append(F.count_if(cond).alias(f"n_{name}"))
        for tag, limit in (("r", K.REFUSE_CAP_PX), ("u", K.UPSCALE_CAP_PX)):
            below, above = cond & (F.col("cap") < limit), cond & (F.col("cap") >= limit)
            aggs += [F.count_if(below).alias(f"b_{name}_{tag}"),
                     F.max(F.when(below, F.col("cap"))).alias(f"hi_{name}_{tag}"),
                     F.min(F.when(above, F.col("cap"))).alias(f"lo_{name}_{tag}")]
    counted = work.groupBy(*on).agg(*aggs)

    def median_below(tag, limit):
        def rule(name):
            twice = 2 * F.col(f"b_{name}_{tag}")
            middle = (F.col(f"hi_{name}_{tag}") + F.col(f"lo_{name}_{tag}")) / 2
            return F.when(twice == F.col(f"n_{name}"), middle < limit).otherwise(
                twice > F.col(f"n_{name}"))
        return F.when(F.col("n_ok") > 0, rule("ok")).otherwise(rule("any"))

    decision = (F.when(F.col("n_any").isNull(), "keep")
                .when(median_below("r", K.REFUSE_CAP_PX), "refuse")
                .when(median_below("u", K.UPSCALE_CAP_PX), "upscale").otherwise("keep"))
    return (sheets.select(*on).join(counted, list(on), "left")
            .select(*on, decision.alias("decision"))
            .withColumn("factor", F.when(F.col("decision") == "upscale", 2.0)
                        .when(F.col("decision") == "keep", 1.0)))


def scale_boxes(df: DataFrame, factor: Column) -> DataFrame:
    """Multiply box coordinates (protected regions of an enlarged sheet)."""
    return df.withColumns({c: F.col(c) * factor for c in G.BOX})


def triage_runs(dets: DataFrame, vocab: Vocabulary = Vocabulary(), protected: DataFrame | None = None,
                on=("sheet_id",), cell: float = CELL, scorer=T.similarity) -> DataFrame:
    """Decide what each detection is: ``disposition`` protected, symbol or run.

    Adds ``snap`` and ``flags``. A symbol has one sheet-level info flag, a run
    its own flags in a fixed order.
    """
    if protected is not None:
        # the semi join marks the protected runs, the anti join the others
        work = (inside_protected(dets, protected, on, cell).withColumn("_in", F.lit(True))
                .unionByName(outside_protected(dets, protected, on, cell).withColumn("_in", F.lit(False))))
    else:
        work = dets.withColumn("_in", F.lit(False))
    work = snap_text(work, vocab=vocab, scorer=scorer)
    text, snap = F.col("text"), F.col("snap")
    symbol = T.is_graphical_symbol(text) | T.is_wrong_script(text)
    short = (snap["kind"] == "unknown") & (F.length(text) <= K.SHORT_UNKNOWN_LEN)
    disposition = (F.when(F.col("_in"), "protected")
                   .when(symbol | short, "symbol").otherwise("run"))
    symbol_flag = FL.flag("non-text-symbol", F.format_string(
        "Treated as part of the drawing: '%s', confidence %.2f.",
        text, F.col("conf")))
    confusable = (snap["kind"] == "annotation") & snap["changed"]
    run_flags = FL.flags_where(
        (F.col("conf") < K.LOW_CONFIDENCE, FL.flag("low-confidence", F.format_string(
            "Read with confidence %.2f only: '%s'.", F.col("conf"), text), "warn")),
        (snap["changed"], FL.flag("lexicon-snap", F.format_string(
            "'%s' -> '%s'", snap["raw"], snap["text"]), "info")),
        (snap["warning"].isNotNull() & confusable,
         FL.flag("annotation-confusable", snap["warning"], "warn")),
        (snap["warning"].isNotNull() & ~confusable,
         FL.flag("implausible", snap["warning"], "warn")))
    none = F.filter(run_flags, lambda f: F.lit(False))
    work = work.withColumn("disposition", disposition)
    return work.withColumn("flags", F.when(F.col("disposition") == "symbol", F.array(symbol_flag))
                           .when(F.col("disposition") == "run", run_flags).otherwise(none)).drop("_in")
