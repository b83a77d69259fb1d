"""Box joins keyed by sheet, size class *and* grid cell.

A sheet may hold any share of the corpus, so joining on the sheet alone would
send it to one task. A box belongs to the size class whose cells (``cell`` times
a power of two) are at least as large as its longer side, so at any size it
touches four of them at most. Two boxes meet in the grid of the larger one: it
is listed there once, and smaller boxes are listed in the grids of the larger
classes that the other side has. With boxes of one class only, each box is listed
once. Boxes with a missing, infinite or NaN side meet nothing (``placeable``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.functions.geometry import BOX
from planloom.session import join_small, written

CELL = 128.0

#: Side and offset of the blocks that crowded sheets are cut into, in the order in which they are tried.
BLOCKS = ((8 * CELL, 0.0), (64 * CELL, 32 * CELL))
BLOCK = ["_bx", "_by"]


def placeable(box=BOX):
    """Whether all sides are finite numbers; null sides are not."""
    total = sum((F.abs(F.col(c)) for c in box[1:]), F.abs(F.col(box[0]))).cast("double")
    return F.coalesce(total < float("inf"), F.lit(False))


def level(box=BOX, cell: float = CELL):
    """The size class of a box, from 0 on."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    side = F.greatest(x1 - x0, y1 - y0) / cell
    return F.when(side > 1, F.ceil(F.log2(side))).otherwise(0).cast("int")


def levels_of(df: DataFrame, box=BOX, cell: float = CELL) -> list[int]:
    """The classes above 0 that ``df`` has; a number has 2048 exponents, so the list is short."""
    rows = df.where(placeable(box)).select(level(box, cell).alias("level")).where("level > 0").distinct().collect()
    return sorted(r.level for r in rows)


def _cells(df: DataFrame, box, cell: float, prefix: str) -> DataFrame:
    """One row per cell of the grid ``_lvl`` that a box touches; adds <prefix>cx0, <prefix>cy0, cx, cy."""
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("_lvl")) if "_lvl" in df.columns else F.lit(cell)
    lo_x, lo_y, hi_x, hi_y = (F.floor(F.col(c) / size) for c in box)
    return (df.withColumn(prefix + "cx0", lo_x).withColumn(prefix + "cy0", lo_y)
            .withColumn("cx", F.explode(F.sequence(lo_x, F.greatest(lo_x, hi_x))))
            .withColumn("cy", F.explode(F.sequence(lo_y, F.greatest(lo_y, hi_y)))))


def _grids(level_col, levels: list[int], keep):
    """The ``levels`` for which ``keep(level of a grid, own level)`` holds."""
    return F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: keep(x, level_col))


def _listed(df: DataFrame, box, cell: float, prefix: str, is_left: bool, others: list[int]) -> DataFrame:
    """Rows of ``df`` in the grids in which they may meet the other side; adds _lvl, _small and the cells.

    ``_small`` tells which side may be the smaller one there: in one grid, left
    boxes of its class meet right boxes of the same or a smaller class, and right
    boxes of its class meet smaller left boxes.
    """
    placed = df.where(placeable(box)).withColumn("_own", level(box, cell))
    own = F.col("_own")
    entry = lambda x, small: F.struct(x.alias("level"), F.lit(small).alias("small"))
    if is_left:
        grids = F.concat(F.array(entry(own, "r")), F.transform(_grids(own, others, lambda x, o: x > o), lambda x: entry(x, "l")))
    else:
        grids = F.concat(F.when(own > 0, F.array(entry(own, "l"))).otherwise(F.array().cast("array<struct<level:int,small:string>>")),
                         F.transform(_grids(own, [0, *others], lambda x, o: x >= o), lambda x: entry(x, "r")))
    placed = placed.withColumn("_grid", F.explode(grids))
    return _cells(placed.withColumns({"_lvl": F.col("_grid.level"), "_small": F.col("_grid.small")}).drop("_grid", "_own"), box, cell, prefix)


def grid_cells(df: DataFrame, levels: list[int], box=BOX, cell: float = CELL, prefix: str = "") -> DataFrame:
    """Rows in the cells of their own class (``own``) and of every larger class of ``levels``; adds _lvl, own and cells."""
    own = level(box, cell)
    placed = df.where(placeable(box)).withColumn("_own", own)
    placed = placed.withColumn("_lvl", F.explode(_grids(F.col("_own"), [0, *levels], lambda x, o: x >= o)))
    return _cells(placed.withColumn("own", F.col("_lvl") == F.col("_own")).drop("_own"), box, cell, prefix)


def first_in_cells(df: DataFrame, on: list[str], rank: str, levels: list[int], box=BOX, cell: float = CELL) -> DataFrame:
    """(on, _lvl, cx, cy, own_first, small_first): least ``rank`` of a cell's boxes of its class, and of smaller ones."""
    listed = grid_cells(df.select(*on, rank, *box), levels, box, cell, "g")
    return listed.groupBy(*on, "_lvl", "cx", "cy").agg(
        F.min(F.when(F.col("own"), F.col(rank))).alias("own_first"), F.min(F.when(~F.col("own"), F.col(rank))).alias("small_first"))


def first_near(df: DataFrame, on: list[str], key: str, firsts: DataFrame, levels: list[int], box=BOX, cell: float = CELL) -> DataFrame:
    """(on, key, first): the least rank of ``firsts`` that may stand for a box which touches a box of ``df``: in
    the grid of its own class of any box, in larger grids of those of their class."""
    met = grid_cells(df.select(*on, key, *box), levels, box, cell, "g").join(firsts, [*on, "_lvl", "cx", "cy"])
    rank = F.when(F.col("own"), F.least("own_first", "small_first")).otherwise(F.col("own_first"))
    return met.groupBy(*on, key).agg(F.min(rank).alias("first"))


def _touch(a, b, closed: bool):
    ax0, ay0, ax1, ay1 = (F.col(c) for c in a)
    bx0, by0, bx1, by1 = (F.col(c) for c in b)
    if closed:
        return (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)
    return (ax0 < bx1) & (bx0 < ax1) & (ay0 < by1) & (by0 < ay1)


def _both_listed(left, right, left_box, right_box, cell, levels):
    """Both sides by cells, and the columns that name a cell."""
    left_levels, right_levels = levels or (levels_of(left, left_box, cell), levels_of(right, right_box, cell))
    if not left_levels and not right_levels:
        return (_cells(left.where(placeable(left_box)), left_box, cell, "l"),
                _cells(right.where(placeable(right_box)), right_box, cell, "r"), ["cx", "cy"])
    return (_listed(left, left_box, cell, "l", True, right_levels),
            _listed(right, right_box, cell, "r", False, left_levels), ["_lvl", "_small", "cx", "cy"])


def box_pairs(left: DataFrame, right: DataFrame, on: list[str], right_box,
              left_box=BOX, closed: bool = False, cell: float = CELL, levels=None) -> DataFrame:
    """Every intersecting (left, right) pair once.

    Apart from ``on``, column names of the two sides must differ. A pair that
    shares several cells is kept only in the cell of its intersection's top
    left corner, so no de-duplicating shuffle is needed. ``levels`` are the size
    classes of both sides, if the caller knows them.
    """
    a, b, grid = _both_listed(left, right, left_box, right_box, cell, levels)
    home = (F.col("cx") == F.greatest("lcx0", "rcx0")) & (F.col("cy") == F.greatest("lcy0", "rcy0"))
    return (a.join(b, [*on, *grid])
            .where(_touch(left_box, right_box, closed) & home)
            .drop(*grid, "lcx0", "lcy0", "rcx0", "rcy0"))


def boxes_hit(left: DataFrame, right: DataFrame, on: list[str], ids: list[str], right_box,
              left_box=BOX, closed: bool = False, cell: float = CELL, extra=None, levels=None, carry=()) -> DataFrame:
    """Distinct ``ids`` of the left boxes that intersect any right box. ``levels`` as in ``box_pairs``;
    ``carry``: further left columns that ``extra`` reads.

    A semi join, so a left box with very many partners costs one output row.
    """
    keep = [c for c in dict.fromkeys([*on, *ids, *left_box, *carry])]
    a, b, grid = _both_listed(left.select(*keep), right, left_box, right_box, cell, levels)
    a = a.alias("a").select(*[F.col(f"a.{c}").alias(c) for c in a.columns])
    renamed = b.alias("b")
    cond = _touch(left_box, right_box, closed)
    for c in [*on, *grid]:
        renamed = renamed.withColumnRenamed(c, "_r_" + c)
        cond = cond & (F.col(c) == F.col("_r_" + c))
    if extra is not None:
        cond = cond & extra
    return a.join(renamed, cond, "left_semi").select(*ids).distinct()


def points_join(points: DataFrame, boxes: DataFrame, on: list[str], how: str, box, point=("x", "y"),
                half_open: bool = False, cell: float = CELL) -> DataFrame:
    """Join points with the boxes that hold them (left_semi, left_anti or inner).

    A point lies in one cell of a grid, so it is neither copied nor de-duplicated; only
    the boxes are listed per cell. Boxes of several size classes are joined class by class. Box
    column names must differ from the point table's. ``half_open`` leaves out the right and bottom borders.
    """
    px, py = F.col(point[0]), F.col(point[1])
    x0, y0, x1, y1 = (F.col(c) for c in box)
    inside = (px >= x0) & (py >= y0) & ((px < x1) & (py < y1) if half_open else (px <= x1) & (py <= y1))
    cond = (F.col("_cx") == F.col("_r_cx")) & (F.col("_cy") == F.col("_r_cy")) & inside
    for c in on:
        cond = cond & (F.col(c) == F.col("_r_" + c))
    larger = levels_of(boxes, box, cell)

    def joined(some: DataFrame, n: int, kind: str) -> DataFrame:
        size = cell * 2.0 ** n
        placed = some.withColumns({"_cx": F.floor(px / size), "_cy": F.floor(py / size)})
        listed = boxes.where(placeable(box))
        listed = listed.where(level(box, cell) == n) if larger else listed
        b = _cells(listed, box, size, "b").drop("bcx0", "bcy0")
        for c in [*on, "cx", "cy"]:
            b = b.withColumnRenamed(c, "_r_" + c)
        return placed.join(b, cond, kind).drop("_cx", "_cy", "_r_cx", "_r_cy", *["_r_" + c for c in on])

    if how == "left_anti":
        for n in [0, *larger]:
            points = joined(points, n, how)
        return points
    out = joined(points, 0, how)
    for n in larger:
        if how == "left_semi":  # those that no smaller class holds
            points = joined(points, larger[larger.index(n) - 1] if n != larger[0] else 0, "left_anti")
        out = out.unionByName(joined(points, n, how))
    return out


def apart(tables: list[tuple[DataFrame, list[str]]], on: list[str], side: float, offset: float) -> list[tuple[DataFrame, DataFrame | None]]:
    """Each table (with its box columns) cut in two: rows of blocks that no box of any table reaches into or out of, with
    the columns BLOCK, and the rest (None, if there is none).

    Boxes of such blocks meet boxes of their own block only. A box that touches several blocks puts them all in
    the rest; one that is wider than a block, its whole sheet.
    """
    placed, beyond = [], []
    for df, box in tables:
        x0, y0, x1, y1 = (F.floor((F.col(c) + offset) / side) for c in box)
        here = F.coalesce(placeable(box) & (x0 == x1) & (y0 == y1), F.lit(False))
        marked = df.withColumns({"_bx": x0, "_by": y0, "_here": here})
        placed.append(marked)
        beyond.append(marked.where(~here).select(
            *on, placeable(box).alias("_finite"), (level(box, side) > 0).alias("_wide"), *BLOCK, x1.alias("_ex"), y1.alias("_ey")))
    reaching = beyond[0]
    for some in beyond[1:]:
        reaching = reaching.unionByName(some)
    if reaching.isEmpty():
        return [(df.drop("_here"), None) for df in placed]
    narrow = reaching.where("_finite AND NOT _wide")
    for low, high in (("_bx", "_ex"), ("_by", "_ey")):
        narrow = narrow.withColumn(low, F.explode(F.sequence(F.col(low), F.greatest(low, high))))
    reached = written(narrow.select(*on, *BLOCK).distinct().withColumn("_reached", F.lit(True)))
    wide = written(reaching.where("_finite AND _wide").select(*on).distinct().withColumn("_under", F.lit(True)))
    out = []
    for df in placed:
        known = join_small(join_small(df, reached, [*on, *BLOCK], "left"), wide, on, "left")
        alone = F.col("_here") & F.col("_reached").isNull() & F.col("_under").isNull()
        out.append((known.where(alone).drop("_here", "_reached", "_under"),
                    known.where(~alone).drop(*BLOCK, "_here", "_reached", "_under")))
    return out
