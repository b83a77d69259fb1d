"""Widths, tracking, scale and size clusters of drawn text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import geometry as G, text as T
from planloom.session import join_small


def font_tables(glyphs: DataFrame) -> DataFrame:
    """(font, advances): advance per em indexed by code point, NULL = no glyph.

    One row per font, at most one entry per code point, so that width and
    coverage of a text are array lookups next to the text itself: characters
    are never exploded into rows.
    """
    top = glyphs.groupBy("font").agg(F.max("cp").alias("top"))
    slots = top.select("font", F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias("cp"))
    filled = slots.join(glyphs.select("font", F.col("cp").cast("int").alias("cp"), "em"),
                        ["font", "cp"], "left")
    packed = filled.groupBy("font").agg(F.array_sort(F.collect_list(F.struct("cp", "em"))).alias("a"))
    return packed.select("font", F.transform("a", lambda g: g["em"]).alias("advances"))


def glyphs_of(fonts: DataFrame) -> DataFrame:
    """(font, cp, em) of the glyphs that fonts have, from such a table or from ``font_tables``."""
    if "advances" not in fonts.columns:
        return fonts.select("font", F.col("cp").cast("int").alias("cp"), "em")
    return fonts.select("font", F.posexplode("advances").alias("cp", "em")).where("em IS NOT NULL")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _advance(advances: Column, char: Column) -> Column:
    return F.get(advances, F.ascii(char))


def natural_width(text: Column, advances: Column, px: Column) -> Column:
    """Sum of glyph advances in pixels (missing glyphs add nothing)."""
    em = F.aggregate(characters(text), F.lit(0.0),
                     lambda acc, c: acc + F.coalesce(_advance(advances, c), F.lit(0.0)))
    return em * px


def text_width(text: Column, advances: Column, px: Column, tracking_px: Column) -> Column:
    gaps = F.greatest(F.length(text) - 1, F.lit(0))
    return natural_width(text, advances, px) + tracking_px * gaps


def solve_tracking(natural: Column, n_chars: Column, px: Column, target: Column) -> Column:
    """Extra space per glyph in em, clipped; 0 below two characters."""
    lo, hi = K.TRACKING_RANGE
    em = (target - natural) / (n_chars - 1) / px
    return F.when(n_chars < 2, 0.0).otherwise(F.least(F.greatest(em, F.lit(lo)), F.lit(hi)))


def solve_scale(natural: Column, target: Column) -> Column:
    lo, hi = K.SCALE_RANGE
    return F.when(natural <= 0, 1.0).otherwise(
        F.least(F.greatest(target / natural, F.lit(lo)), F.lit(hi)))


def with_fit(df: DataFrame, natural: Column, px: Column, along: Column, prefix: str = "") -> DataFrame:
    """Add <prefix>tracking, width_scale, drawn_natural and overflow."""
    n = F.length("text")
    df = df.withColumn(prefix + "tracking", F.when(n < 2, 0.0).otherwise(
        solve_tracking(natural, F.greatest(n, F.lit(2)), px, along)))
    df = df.withColumn(prefix + "tracked",
                       natural + F.col(prefix + "tracking") * px * F.greatest(n - 1, F.lit(0)))
    df = df.withColumn(prefix + "width_scale", solve_scale(F.col(prefix + "tracked"), along))
    return df.withColumn(prefix + "overflow", F.col(prefix + "tracked") * F.col(prefix + "width_scale")
                         / F.greatest(F.lit(1.0), along))


def fit_dimensions(runs: DataFrame, fonts: DataFrame, condensed: str | None = None) -> DataFrame:
    """Fit each run (font, text, px_size, ink_along) to its measured width.

    With ``condensed``, runs that would overflow take that font when it is
    allowed (``allow_condensed`` or not a number) and really narrower; its
    size comes from ``px_size_condensed`` where given.
    """
    out = join_small(runs, fonts, "font", "left")
    out = out.withColumn("natural", natural_width(F.col("text"), F.col("advances"), F.col("px_size")))
    out = with_fit(out, F.col("natural"), F.col("px_size"), F.col("ink_along")).drop("advances")
    if condensed is None:
        return out
    if "px_size_condensed" not in out.columns:
        out = out.withColumn("px_size_condensed", F.col("px_size"))
    narrow = fonts.where(F.col("font") == condensed).select(
        F.lit(condensed).alias("c_font"), F.col("advances").alias("c_advances"))
    out = join_small(out.withColumn("c_font", F.lit(condensed)), narrow, "c_font", "left")
    px = F.col("px_size_condensed")
    out = with_fit(out.withColumn("c_natural", natural_width(F.col("text"), F.col("c_advances"), px)),
                   F.col("c_natural"), px, F.col("ink_along"), "c_")
    allowed = F.col("allow_condensed") | ~T.is_numeric_run(F.col("text"))
    take = ((F.col("overflow") > K.CONDENSED_OVERFLOW) & allowed
            & F.col("c_advances").isNotNull() & (F.col("c_overflow") < F.col("overflow")))
    names = {"font": "c_font", "px_size": "px_size_condensed", "tracking": "c_tracking",
             "width_scale": "c_width_scale", "overflow": "c_overflow", "natural": "c_natural"}
    out = out.withColumn("_take", take)
    for name, other in names.items():
        out = out.withColumn(name, F.when(F.col("_take"), F.col(other)).otherwise(F.col(name)))
    return (out.withColumn("condensed", F.col("_take"))
            .drop("_take", "c_font", "c_advances", "c_natural", "c_tracked", "c_tracking",
                  "c_width_scale", "c_overflow", "px_size_condensed"))


def target_size(angle: Column) -> tuple[Column, Column]:
    """(along, across): measured ink, or the box sides when nothing was measured."""
    x0, y0, x1, y1 = G.box_of()
    w, h = x1 - x0, y1 - y0
    upright = F.abs(angle) > 45
    inked = F.col("ink_along") > 0
    return (F.when(inked, F.col("ink_along")).when(upright, h).otherwise(w),
            F.when(inked, F.col("cap_height")).when(upright, w).otherwise(h))


def size_clusters(runs: DataFrame, on=("sheet_id",)) -> DataFrame:
    """(on..., kind, px_size, median, members) for rooms and dimensions.

    Sizes are whole pixels, so a sheet has few distinct ones however many runs
    it holds; clusters and their upper medians come from counts per size.
    """
    on = list(on)
    sizes = (runs.where(F.col("kind").isin("room", "dimension"))
             .groupBy(*on, "kind", "px_size").agg(F.count("*").alias("n")))
    by_size = Window.partitionBy(*on, "kind").orderBy("px_size")
    gap = F.col("px_size") - F.lag("px_size").over(by_size)
    fresh = F.coalesce(gap > K.SIZE_GAP * F.lag("px_size").over(by_size), F.lit(True))
    sizes = sizes.withColumn("_new", fresh.cast("int"))
    sizes = sizes.withColumn("cluster", F.sum("_new").over(by_size)).drop("_new")
    members = Window.partitionBy(*on, "kind", "cluster")
    running = members.orderBy("px_size").rowsBetween(Window.unboundedPreceding, 0)
    sizes = (sizes.withColumn("members", F.sum("n").over(members))
             .withColumn("_upto", F.sum("n").over(running)))
    middle = F.floor(F.col("members") / 2)
    sizes = sizes.withColumn("median", F.min(F.when(F.col("_upto") > middle, F.col("px_size")))
                             .over(members))
    return sizes.where(F.col("members") >= 2).select(*on, "kind", "px_size", "median", "members")


def snap_sizes(runs: DataFrame, fonts: DataFrame, on=("sheet_id",)) -> DataFrame:
    """Give runs of one size cluster its upper median size.

    A run keeps its own size when its width, fitted again at the median, would
    exceed 1.2 times what was measured. Needs font, text, px_size, ink_along,
    tracking and width_scale; adds ``size_changed``.
    """
    on = list(on)
    out = runs.join(size_clusters(runs, on), [*on, "kind", "px_size"], "left")
    out = join_small(out, fonts, "font", "left")
    px, along = F.col("median"), F.col("ink_along")
    moved = px.isNotNull() & (px != F.col("px_size"))
    out = out.withColumn("_nat", F.when(moved, natural_width(F.col("text"), F.col("advances"), px)))
    out = with_fit(out, F.col("_nat"), px, along, "n_")
    drawn = F.col("n_tracked") * F.col("n_width_scale")
    out = out.withColumn("size_changed", F.coalesce(
        moved & (drawn <= along * K.SIZE_MAX_OVERSHOOT), F.lit(False)))

    def pick(new, old):
        return F.when(F.col("size_changed"), F.col(new)).otherwise(F.col(old)).alias(old)

    changed = {"px_size": "median", "tracking": "n_tracking", "width_scale": "n_width_scale"}
    return out.select(*[pick(changed[c], c) if c in changed else F.col(c) for c in runs.columns],
                      "size_changed")


def best_candidate(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order (a full order), by partial min."""
    others = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), ranked).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in others])


def refine_angle(trials: DataFrame, keys=("sheet_id", "run_id")) -> DataFrame:
    """Best trial angle per run: nearly full length, smallest extent across.

    ``trials`` has angle_deg, delta (0 = as detected), along and across.
    """
    keys = list(keys)
    start = trials.where(F.col("delta") == 0).select(
        *keys, F.col("angle_deg").alias("a0"), F.col("along").alias("l0"), F.col("across").alias("c0"))
    better = ((F.col("delta") != 0) & (F.col("l0") > 0) & (F.col("along") >= 0.9 * F.col("l0"))
              & (F.col("across") < F.col("c0")))
    rated = trials.join(start, keys).groupBy(*keys, "a0").agg(F.min(F.when(
        better, F.struct("across", "delta"))).alias("b"))
    return rated.select(*keys, (F.col("a0") + F.coalesce(F.col("b.delta"), F.lit(0.0))).alias("angle_deg"))
