"""Checks and statistics over pixel tables (sheet_id, y, x, luma or b, g, r).

A table may be sparse: a missing pixel is paper (255). Pixels are filtered or
counted next to the scan; joins are keyed by sheet and position or grid cell,
and per-sheet lists never exceed 256 levels or one image line.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import flags as FL, geometry as G, text as T
from planloom.operators.gate import violation
from planloom.operators.match import prefixed
from planloom.operators.spatial import CELL, box_pairs, points_join
from planloom.session import TASK_ROWS, forget, hot_keys, join_small, shuffles_freed, written

PAPER = 255
PIXEL = ["sheet_id", "y", "x"]


def flip_pixels(pixels: DataFrame, sheets: DataFrame, axis) -> DataFrame:
    """Exact reflection on the pixel grid."""
    sized = join_small(pixels, sheets.select("sheet_id", F.col("width").alias("_w"), F.col("height").alias("_h")),
                       "sheet_id")
    x = G.mirror_x(F.col("x"), F.col("_w") - 1, axis).cast("int")
    y = G.mirror_y(F.col("y"), F.col("_h") - 1, axis).cast("int")
    return sized.withColumns({"x": x, "y": y}).drop("_w", "_h")


def align_scale(source_sizes: DataFrame, output_sizes: DataFrame) -> DataFrame:
    """(sheet_id, scale, problem): 1 for equal sizes, 2 for exactly twice."""
    s = source_sizes.select("sheet_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
    both = s.join(output_sizes.select("sheet_id", "width", "height"), "sheet_id")
    scale = (F.when((F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h")), 1)
             .when((F.col("width") == 2 * F.col("_w")) & (F.col("height") == 2 * F.col("_h")), 2))
    return both.select("sheet_id", scale.alias("scale")).withColumn(
        "problem", F.when(F.col("scale").isNull(), "source and output differ in size"))


def enlarge(pixels: DataFrame, scales: DataFrame) -> DataFrame:
    """Repeat pixels of sheets with scale 2; sheets without a scale drop out."""
    work = join_small(pixels, scales.where(F.col("scale").isNotNull()).select("sheet_id", "scale"), "sheet_id")
    steps = F.when(F.col("scale") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (work.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
            .withColumns({"y": F.col("y") * F.col("scale") + F.col("_dy"),
                          "x": F.col("x") * F.col("scale") + F.col("_dx")}).drop("_dx", "_dy", "scale"))


def diff_pixels(left: DataFrame, right: DataFrame, threshold: int = K.DIFF_THRESHOLD) -> DataFrame:
    """Pixels whose luma differs by more than the threshold.

    A pixel that is absent counts as paper, so paper (most of a sheet) is left
    out before the shuffle.
    """
    inked = F.coalesce("luma", F.lit(PAPER)) != PAPER
    a = left.where(inked).select(*PIXEL, F.col("luma").alias("luma_a"))
    b = right.where(inked).select(*PIXEL, F.col("luma").alias("luma_b"))
    gap = F.abs(F.coalesce("luma_a", F.lit(PAPER)) - F.coalesce("luma_b", F.lit(PAPER)))
    return a.join(b, PIXEL, "full").withColumn("gap", gap).where(F.col("gap") > threshold).select(*PIXEL, "gap")


def outside_boxes(pixels: DataFrame, boxes: DataFrame, pad: int = 0, cell: float = CELL) -> DataFrame:
    """Pixels in none of the boxes (grown by ``pad``, right and bottom open)."""
    grown = boxes.select("sheet_id", *[
        (F.col(c) + (-pad if i < 2 else pad)).cast("int").alias("o_" + c) for i, c in enumerate(G.BOX)])
    return points_join(pixels, grown, ["sheet_id"], "left_anti", ["o_" + c for c in G.BOX], half_open=True, cell=cell)


# --- runs and regions --------------------------------------------------------------------

def line_runs(pixels: DataFrame, along: str = "x") -> DataFrame:
    """Maximal runs of neighbouring pixels: (sheet_id, line, lo, hi).

    The window holds one image line, which the image size bounds.
    """
    across = "y" if along == "x" else "x"
    w = Window.partitionBy("sheet_id", across).orderBy(along)
    return (pixels.select(*PIXEL).withColumn("_g", F.col(along) - F.row_number().over(w))
            .groupBy("sheet_id", across, "_g").agg(F.min(along).alias("lo"), F.max(along).alias("hi"))
            .select("sheet_id", F.col(across).alias("line"), "lo", "hi"))


def _bits(byte: int) -> list[int]:
    return [j for j in range(8) if byte >> j & 1]


def _stretches(byte: int) -> list[tuple[int, int]]:
    """First and last bit of the stretches of set bits."""
    starts = [j for j in _bits(byte) if not byte << 1 >> j & 1]
    return list(zip(starts, [j for j in _bits(byte) if not byte >> 1 >> j & 1]))


def _looked_up(entry: Callable[[int], list], kind: str, byte: Column) -> Column:
    """What ``entry`` has for a byte, from a table of the 256 bytes."""
    return F.get(F.from_json(F.lit(json.dumps([entry(b) for b in range(256)])), f"array<array<{kind}>>"), byte)


def _turned(bits: Column) -> Column:
    """A tile of 8 by 8 bits with lines and columns exchanged."""
    for by, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        swap = bits.bitwiseXOR(F.shiftrightunsigned(bits, by)).bitwiseAND(F.lit(mask).cast("long"))
        bits = bits.bitwiseXOR(swap).bitwiseXOR(F.shiftleft(swap, by))
    return bits


def _tile_lines() -> Column:
    """The eight lines of the tile ``bits``, a byte each."""
    return F.array(*[F.shiftrightunsigned("bits", 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(8)])


def _long_in(tiles: DataFrame, min_length: int) -> DataFrame:
    """Pixels of long runs among tiles (sheet_id, ty, tx, bits). Only stretches of lines of tiles are sorted and summed, and
    pixels are listed once, at the end; where a sheet's tiles lie in one task, none of it is shuffled."""
    bits = F.col("bits")
    ways = F.array(*[F.struct(F.lit(down).alias("down"), F.col(a).alias("ta"), F.col(b).alias("tb"), c.alias("bits"))
                     for down, a, b, c in ((False, "ty", "tx", bits), (True, "tx", "ty", _turned(bits)))])
    lines = tiles.select("sheet_id", F.explode(ways).alias("w")).select("sheet_id", "w.*").select(
        "sheet_id", "down", "ta", "tb", F.posexplode(_tile_lines()).alias("i", "byte"))

    def useful(byte):  # a stretch that ends within the tile is all there is of its run
        return [{"lo": lo, "hi": hi} for lo, hi in _stretches(byte) if lo == 0 or hi == 7 or hi - lo + 1 >= min_length]

    parts = lines.select("sheet_id", "down", (F.col("ta") * 8 + F.col("i")).alias("line"), "tb", F.explode(
        _looked_up(useful, "struct<lo:int,hi:int>", F.col("byte"))).alias("s")).select(
        "sheet_id", "down", "line", (F.col("tb") * 8 + F.col("s.lo")).alias("lo"), (F.col("tb") * 8 + F.col("s.hi")).alias("hi"))
    key = ["sheet_id", "down", "line"]
    w = Window.partitionBy(*key).orderBy("lo")
    fresh = F.coalesce(F.col("lo") > F.lag("hi").over(w) + 1, F.lit(True))
    runs = (parts.withColumn("_g", fresh.cast("int")).withColumn("_g", F.sum("_g").over(w)).groupBy(*key, "_g")
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("hi") - F.col("lo") + 1 >= min_length))
    cut = runs.withColumn("tb", F.explode(F.sequence(F.shiftright("lo", 3), F.shiftright("hi", 3)))).withColumns(
        {"ta": F.shiftright("line", 3), "lo": F.greatest(F.col("lo") - F.col("tb") * 8, F.lit(0)),
         "hi": F.least(F.col("hi") - F.col("tb") * 8, F.lit(7))})
    mask = F.expr("SHIFTLEFT(SHIFTLEFT(SHIFTRIGHT(255L, CAST(7 - (hi - lo) AS INT)), CAST(lo AS INT)), CAST(8 * PMOD(line, 8) AS INT))")
    filled = cut.select("sheet_id", "down", "ta", "tb", mask.alias("bits")).select(
        "sheet_id", F.when(F.col("down"), F.col("tb")).otherwise(F.col("ta")).alias("ty"),
        F.when(F.col("down"), F.col("ta")).otherwise(F.col("tb")).alias("tx"),
        F.when(F.col("down"), _turned(F.col("bits"))).otherwise(F.col("bits")).alias("bits"))
    whole = filled.groupBy("sheet_id", "ty", "tx").agg(F.bit_or("bits").alias("bits"))
    found = whole.select("sheet_id", "ty", "tx", F.posexplode(_tile_lines()).alias("i", "byte"))
    return found.select("sheet_id", (F.col("ty") * 8 + F.col("i")).alias("y"), "tx",
                        F.explode(_looked_up(_bits, "int", F.col("byte"))).alias("j")).select(
        "sheet_id", "y", (F.col("tx") * 8 + F.col("j")).alias("x"))


#: Sheets with more dark pixels than this are dealt to tasks by their lines.
SHEET_PIXELS = 4_000_000


def long_runs(dark: DataFrame, min_length: int = K.LINE_MIN_RUN, sheet_limit: int = SHEET_PIXELS) -> DataFrame:
    """Dark pixels of straight horizontal or vertical runs of that length; a pixel may be listed repeatedly.

    Pixels are packed into tiles of 8 by 8, a bit each, before anything is shuffled, and the tiles of a sheet
    are brought to one task; those of a sheet above the limit are shuffled by line and by tile.
    """
    spark = dark.sparkSession
    tile = [F.shiftright("y", 3).alias("ty"), F.shiftright("x", 3).alias("tx")]
    bit = F.expr("SHIFTLEFT(1L, CAST(PMOD(y, 8) * 8 + PMOD(x, 8) AS INT))")
    with shuffles_freed(spark):
        hot = hot_keys(dark, ["sheet_id"], sheet_limit)
        tiles = written(dark.groupBy("sheet_id", *tile).agg(F.bit_or(bit).alias("bits")))
    ordinary = tiles if hot is None else join_small(tiles, hot, "sheet_id", "left_anti")
    tasks = max(-(-tiles.count() // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = _long_in(ordinary.repartition(tasks, "sheet_id"), min_length)
    return out if hot is None else out.unionByName(_long_in(join_small(tiles, hot, "sheet_id", "left_semi"), min_length))


def diff_regions(pixels: DataFrame, diagonal: bool = True, cell: float = CELL) -> DataFrame:
    """Connected regions: (sheet_id, region, x0, y0, x1, y1, area), end-exclusive.

    Works on row runs. Regions grow together by hooking each label to the
    smallest neighbouring one and shortcutting chains of labels; edges shrink
    to edges between labels every round, so rounds grow with the logarithm of
    the largest region, and no region is held by one task.
    """
    runs = written(line_runs(pixels).withColumn(
        "node", F.col("line").cast("long") * F.lit(1 << 32) + F.col("lo")))
    reach = 1 if diagonal else 0
    lower = runs.select("sheet_id", F.col("node").alias("a"), (F.col("lo") - reach).alias("ax0"),
                        (F.col("line") - 1).alias("ay0"), (F.col("hi") + reach).alias("ax1"),
                        (F.col("line") - 1).alias("ay1"))
    upper = runs.select("sheet_id", F.col("node").alias("b"), F.col("lo").alias("bx0"), F.col("line").alias("by0"),
                        F.col("hi").alias("bx1"), F.col("line").alias("by1"))
    edges = box_pairs(lower, upper, ["sheet_id"], ("bx0", "by0", "bx1", "by1"), ("ax0", "ay0", "ax1", "ay1"),
                      closed=True, cell=cell).select("sheet_id", "a", "b")
    edges = written(edges)
    labels = written(runs.select("sheet_id", "node", F.col("node").alias("label")))
    while not edges.isEmpty():
        old = [edges, labels]
        hooks = edges.groupBy("sheet_id", F.greatest("a", "b").alias("label")).agg(F.min(F.least("a", "b")).alias("up"))
        hooks = written(hooks)
        old.append(hooks)
        while True:
            above = hooks.select("sheet_id", F.col("label").alias("up"), F.col("up").alias("up2"))
            jumped = written(hooks.join(above, ["sheet_id", "up"], "left"))
            old.append(jumped)
            hooks = jumped.select("sheet_id", "label", F.coalesce("up2", "up").alias("up"))
            if jumped.where(F.col("up2").isNotNull()).isEmpty():
                break
        labels = written(labels.join(hooks, ["sheet_id", "label"], "left")
                             .select("sheet_id", "node", F.coalesce("up", "label").alias("label")))
        for side in ("a", "b"):
            edges = edges.join(hooks.select("sheet_id", F.col("label").alias(side), F.col("up").alias("_up")),
                               ["sheet_id", side], "left").withColumn(side, F.coalesce("_up", side)).drop("_up")
        edges = written(edges.where(F.col("a") != F.col("b")).select(
            "sheet_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        for some in old:
            forget(some)
    return (runs.join(labels, ["sheet_id", "node"]).groupBy("sheet_id", F.col("label").alias("region")).agg(
        F.min("lo").alias("x0"), F.min("line").alias("y0"), (F.max("hi") + 1).alias("x1"),
        (F.max("line") + 1).alias("y1"), F.sum(F.col("hi") - F.col("lo") + 1).alias("area")))


# --- histograms ----------------------------------------------------------------------------

def histogram(pixels: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """(sheet_id, luma, n); with sheet sizes, missing pixels count as paper."""
    h = pixels.groupBy("sheet_id", "luma").agg(F.count("*").alias("n"))
    if sheets is None:
        return h
    h = written(h)
    total = h.groupBy("sheet_id").agg(F.sum("n").alias("_n"))
    rest = (sheets.join(total, "sheet_id", "left").select(
        "sheet_id", F.lit(PAPER).alias("luma"),
        (F.col("width") * F.col("height") - F.coalesce("_n", F.lit(0))).cast("long").alias("n")).where(F.col("n") > 0))
    return h.unionByName(rest).groupBy("sheet_id", "luma").agg(F.sum("n").alias("n"))


def histogram_median(hist: DataFrame, keys: list[str], value: str = "luma", name: str = "median") -> DataFrame:
    """Exact interpolated median from counts (at most 256 levels per key)."""
    w = Window.partitionBy(*keys).orderBy(value)
    run = hist.withColumns({"_cum": F.sum("n").over(w), "_all": F.sum("n").over(Window.partitionBy(*keys))})
    low = F.min(F.when(F.col("_cum") > F.floor((F.col("_all") - 1) / 2), F.col(value)))
    high = F.min(F.when(F.col("_cum") > F.floor(F.col("_all") / 2), F.col(value)))
    return run.groupBy(*keys).agg(((low + high) / 2).alias(name))


def otsu_levels(hist: DataFrame) -> DataFrame:
    """(sheet_id, level, ink, paper): threshold of largest between-class
    variance, and the medians of both sides (NULL when a side is empty)."""
    w = Window.partitionBy("sheet_id").orderBy("luma")
    every = Window.partitionBy("sheet_id")
    mass = F.col("n") * F.col("luma")
    run = hist.withColumns({"_n1": F.sum("n").over(w), "_s1": F.sum(mass).over(w),
                            "_n": F.sum("n").over(every), "_s": F.sum(mass).over(every)})
    spread = (F.col("_s1").cast("double") * F.col("_n") - F.col("_s").cast("double") * F.col("_n1"))
    n2 = F.col("_n") - F.col("_n1")
    score = F.when(n2 > 0, spread * spread / (F.col("_n1").cast("double") * n2))
    best = run.withColumn("_score", score).groupBy("sheet_id").agg(
        F.min(F.struct((-F.coalesce("_score", F.lit(-1.0))).alias("k"), "luma")).alias("b"))
    level = best.select("sheet_id", F.when(F.col("b.k") < 0, F.col("b.luma")).otherwise(F.lit(0)).alias("level"))
    sides = hist.join(level, "sheet_id").withColumn("side", F.when(F.col("luma") <= F.col("level"), "ink").otherwise("paper"))
    medians = histogram_median(sides, ["sheet_id", "side"])
    wide = medians.groupBy("sheet_id").agg(F.max(F.when(F.col("side") == "ink", F.col("median"))).alias("ink"),
                                           F.max(F.when(F.col("side") == "paper", F.col("median"))).alias("paper"))
    return level.join(wide, "sheet_id")


def drawing_coverage(pixels: DataFrame, levels: DataFrame) -> DataFrame:
    """(sheet_id, y, x, alpha) for alpha > 0: how solid the drawing is.

    Only pixels within one pixel of a dark one count; a sheet that is all dark
    or has no dark pixel covers nothing.
    """
    ok = written(levels.where(F.col("ink").isNotNull() & F.col("paper").isNotNull()))
    work = join_small(pixels.select(*PIXEL, "luma"), ok, "sheet_id")

    def around(c):
        return F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))

    near = (work.where(F.col("luma") <= F.col("level")).select("sheet_id", "y", "x")
            .withColumn("y", around("y")).withColumn("x", around("x")).distinct())
    alpha = (F.col("paper") - F.col("luma")) / F.greatest(F.lit(1.0), F.col("paper") - F.col("ink"))
    return (work.withColumn("alpha", F.least(F.greatest(alpha, F.lit(0.0)), F.lit(1.0)))
            .where(F.col("alpha") > 0).join(near, PIXEL, "left_semi").select(*PIXEL, "alpha"))


# --- colours -------------------------------------------------------------------------------

def ring_pixels(pixels: DataFrame, boxes: DataFrame, ring: int = K.RING_PX, cell: float = CELL) -> DataFrame:
    """Pixels of the band of ``ring`` pixels outside each box (box_id)."""
    b = boxes.select("sheet_id", "box_id", *[F.col(c).cast("int").alias("i_" + c) for c in G.BOX])
    b = b.withColumns({"o_x0": F.col("i_x0") - ring, "o_y0": F.col("i_y0") - ring,
                       "o_x1": F.col("i_x1") + ring, "o_y1": F.col("i_y1") + ring})
    near = points_join(pixels, b, ["sheet_id"], "inner", ["o_" + c for c in G.BOX], half_open=True, cell=cell)
    inner = ((F.col("x") >= F.col("i_x0")) & (F.col("x") < F.col("i_x1"))
             & (F.col("y") >= F.col("i_y0")) & (F.col("y") < F.col("i_y1")))
    return near.where(~inner)


def _ring_area(sheets_boxes: DataFrame, ring: int) -> Column:
    def clipped(grow):
        x0, y0, x1, y1 = (F.col(c).cast("int") for c in G.BOX)
        w = F.least(x1 + grow, F.col("width").cast("int")) - F.greatest(x0 - grow, F.lit(0))
        h = F.least(y1 + grow, F.col("height").cast("int")) - F.greatest(y0 - grow, F.lit(0))
        return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    return clipped(ring) - clipped(0)


def paper_colour(pixels: DataFrame, boxes: DataFrame, sheets: DataFrame | None = None,
                 channels: tuple[str, ...] = ("b", "g", "r"), ring: int = K.RING_PX,
                 exclude_boxes: bool = False, cell: float = CELL) -> DataFrame:
    """Rounded mean of the most frequent 8-level bucket around each box.

    The smaller bucket wins ties. With ``sheets`` the pixel table is sparse and
    ring pixels that are missing count as paper. ``exclude_boxes`` leaves out
    pixels of the other boxes (dense tables). Boxes without ring are white.
    """
    if exclude_boxes:
        pixels = outside_boxes(pixels, boxes, cell=cell)
    near = ring_pixels(pixels, boxes, ring, cell)
    bucket = [F.floor(F.col(c) / K.BUCKET_LEVELS).cast("int").alias("q_" + c) for c in channels]
    key = ["sheet_id", "box_id"]
    qs = ["q_" + c for c in channels]
    counts = near.select(*key, *bucket, *channels).groupBy(*key, *qs).agg(
        F.count("*").alias("n"), *[F.sum(c).alias("s_" + c) for c in channels])
    if sheets is not None:
        seen = counts.groupBy(*key).agg(F.sum("n").alias("_seen"))
        area = (boxes.join(sheets.select("sheet_id", "width", "height"), "sheet_id")
                .select(*key, _ring_area(boxes, ring).alias("_area")).join(seen, key, "left"))
        rest = area.select(*key, (F.col("_area") - F.coalesce("_seen", F.lit(0))).cast("long").alias("n")).where("n > 0")
        rest = rest.select(*key, *[F.lit(PAPER // K.BUCKET_LEVELS).alias(q) for q in qs], "n",
                           *[(F.col("n") * PAPER).alias("s_" + c) for c in channels])
        counts = counts.unionByName(rest).groupBy(*key, *qs).agg(
            F.sum("n").alias("n"), *[F.sum("s_" + c).alias("s_" + c) for c in channels])
    best = counts.groupBy(*key).agg(F.min(F.struct(
        (-F.col("n")).alias("k"), *qs, "n", *["s_" + c for c in channels])).alias("m"))
    mean = [F.bround(F.col("m.s_" + c) / F.col("m.n")).cast("int").alias(c) for c in channels]
    return boxes.select(*key).join(best, key, "left").select(*key, *[
        F.coalesce(m, F.lit(PAPER)).alias(c) for m, c in zip(mean, channels)])


def _medians(df: DataFrame, keys: list[str], cond: Column, channels, prefix: str) -> list[Column]:
    return [F.percentile(F.when(cond, F.col(c)), 0.5).alias(prefix + c) for c in channels]


def ink_paper(pixels: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """Ink and paper RGB of each box: channel medians of the darkest and the
    lightest tenth. A box without pixels is black on white."""
    key = ["sheet_id", "box_id"]
    b = boxes.select(*key, *[F.bround(F.col(c)).cast("int").alias("o_" + c) for c in G.BOX])
    crop = points_join(pixels, b, ["sheet_id"], "inner", ["o_" + c for c in G.BOX], half_open=True, cell=cell)
    crop = crop.select(*key, "b", "g", "r", T.luma(F.col("b"), F.col("g"), F.col("r")).alias("luma"))
    cuts = crop.groupBy(*key).agg(F.percentile("luma", F.array(F.lit(0.1), F.lit(0.9))).alias("cut"))
    rated = crop.join(cuts, key)
    dark, light = F.col("luma") <= F.col("cut")[0], F.col("luma") >= F.col("cut")[1]
    out = rated.groupBy(*key).agg(*_medians(rated, key, dark, "rgb", "ink_"), *_medians(rated, key, light, "rgb", "paper_"))
    return boxes.select(*key).join(out, key, "left").select(*key, *[
        F.coalesce(F.bround(F.col(p + c)).cast("int"), F.lit(d)).alias(p + c)
        for p, d in (("ink_", 0), ("paper_", PAPER)) for c in "rgb"])


def sheet_ink_colour(pixels: DataFrame) -> DataFrame:
    """Channel medians (truncated) at or below the first luma percentile.

    Luma is counted in thousandths, so the percentile is a whole number of hundredths
    of them, and rounding to it leaves no pixel to the order of sums of fractions.
    """
    shares = [round(1000 * w) for w in K.LUMA_BGR]
    work = pixels.select("sheet_id", "b", "g", "r", sum(
        (F.col(c).cast("long") * w for c, w in zip("gr", shares[1:])), F.col("b").cast("long") * shares[0]).alias("luma"))
    cut = work.groupBy("sheet_id").agg(F.round(100 * F.percentile("luma", 0.01)).cast("long").alias("cut"))
    dark = join_small(work, cut, "sheet_id").where(100 * F.col("luma") <= F.col("cut"))
    return dark.groupBy("sheet_id").agg(*[F.percentile(c, 0.5).cast("int").alias(c) for c in "bgr"])


def patterned_background(pixels: DataFrame, boxes: DataFrame, ring: int = K.RING_PX, cell: float = CELL) -> DataFrame:
    """Boxes on a patterned ground: light ring pixels vary by more than 18."""
    near = ring_pixels(pixels, boxes, ring, cell).where(F.col("luma") > K.DARK_LUMA)
    rated = near.groupBy("sheet_id", "box_id").agg(F.stddev_pop("luma").alias("deviation"))
    return rated.where(F.col("deviation") > K.PATTERN_STD).withColumn("flag", FL.flag(
        "erase-over-pattern", F.format_string("Text box %d lies on a patterned ground; a flat fill may show.", "box_id"), "warn"))


# --- checks ----------------------------------------------------------------------------------

def check_spatial_integrity(source: DataFrame, canvas: DataFrame, source_sheets: DataFrame, canvas_sheets: DataFrame,
                            exclude: DataFrame, axis, cell: float = CELL) -> DataFrame:
    """Dark source pixels outside the excluded boxes that the output lost."""
    sizes = align_scale(source_sheets, canvas_sheets)
    bad = violation(sizes.where(F.coalesce(F.col("scale") != 1, F.lit(True))), "spatial-integrity", "scale-mismatch",
                    F.lit("source and output differ in size; geometry cannot be compared."), F.lit(0.0), F.lit(0.0),
                    False, True)
    equal = sizes.where(F.col("scale") == 1).select("sheet_id")
    dark = source.where(F.col("luma") < K.DARK_LUMA).select(*PIXEL)
    flipped = flip_pixels(dark, source_sheets.join(equal, "sheet_id", "left_semi"), axis)
    kept = canvas.where(F.col("luma") < K.DARK_LUMA).select(*PIXEL)
    lost = outside_boxes(flipped, exclude, cell=cell).join(kept, PIXEL, "left_anti")
    counted = lost.groupBy("sheet_id").agg(F.count("*").alias("n"))
    return bad.unionByName(violation(counted, "spatial-integrity", "geometry", F.format_string(
        "%d px of the source drawing are missing outside all text runs.", "n"), F.col("n"), F.lit(0.0), False, True))


def check_layer_ordering(canvas: DataFrame, plate: DataFrame, coverage: DataFrame) -> DataFrame:
    """Solid drawing pixels whose colour the drawn text changed."""
    chans = ("b", "g", "r")
    solid = coverage.where(F.col("alpha") >= K.SOLID_ALPHA).select(*PIXEL)
    a = canvas.select(*PIXEL, *[F.col(c).alias("a_" + c) for c in chans])
    b = plate.select(*PIXEL, *[F.col(c).alias("b_" + c) for c in chans])
    both = solid.join(a, PIXEL, "left").join(b, PIXEL, "left")
    differs = F.lit(False)
    for c in chans:
        differs = differs | (F.coalesce("a_" + c, F.lit(PAPER)) != F.coalesce("b_" + c, F.lit(PAPER)))
    counted = both.where(differs).groupBy("sheet_id").agg(F.count("*").alias("n"))
    return violation(counted, "layer-ordering", "layer-order", F.format_string(
        "%d px of solid drawing were overwritten by text.", "n"), F.col("n"), F.lit(0.0), False, True)


def verify_report(sheets: DataFrame, diffs: DataFrame, regions: DataFrame, issues: DataFrame,
                  expected: DataFrame) -> DataFrame:
    """One row per sheet: totals, share differing, outside regions, issues, and what was
    checked: text boxes left out of the pixel check, and runs read back (``expected``)."""
    e = expected.groupBy("sheet_id").agg(F.count("x0").alias("text_regions_checked"),
                                         F.count("*").alias("text_runs_checked"))
    d = diffs.groupBy("sheet_id").agg(F.count("*").alias("differing_px"))
    r = regions.groupBy("sheet_id").agg(F.count("*").alias("outside_regions"), F.sum("area").alias("outside_px"))
    i = issues.groupBy("sheet_id").agg(F.count("*").alias("issues"))
    out = sheets.select("sheet_id", (F.col("width") * F.col("height")).cast("long").alias("total_px"))
    for part in (d, r, i, e):
        out = out.join(part, "sheet_id", "left")
    out = out.fillna(0, ["differing_px", "outside_regions", "outside_px", "issues", "text_regions_checked",
                         "text_runs_checked"])
    pct = F.when(F.col("total_px") > 0, 100.0 * F.col("differing_px") / F.col("total_px")).otherwise(0.0)
    return out.withColumns({"differing_pct": pct,
                            "passed": (F.col("outside_regions") == 0) & (F.col("issues") == 0)})
