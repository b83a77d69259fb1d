"""Column expressions for boxes, points, angles and 2-D affine maps.

Screen coordinates: y grows down; angle 0 reads left to right and 90 reads
bottom to top, so the direction of an angle is (cos a, -sin a).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planloom import constants as K

EPS = 1e-6
BOX = ("x0", "y0", "x1", "y1")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def box_of(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + n) for n in BOX)


def flips(axis) -> tuple[Column, Column]:
    """(flip x?, flip y?) for a literal axis name or an axis column."""
    if isinstance(axis, str):
        if axis not in K.AXES:
            raise ValueError(f"axis must be one of {K.AXES}, not {axis!r}")
        return F.lit(axis != "h"), F.lit(axis != "v")
    return axis.isin("v", "both"), axis.isin("h", "both")


# --- boxes -----------------------------------------------------------------

def intersection(a, b) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def area(a) -> Column:
    return F.greatest(F.lit(0.0), a[2] - a[0]) * F.greatest(F.lit(0.0), a[3] - a[1])


def iou(a, b) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def containment(a, b) -> Column:
    """Intersection over the smaller of the two areas."""
    inter = intersection(a, b)
    smaller = F.least(area(a), area(b))
    return F.when((inter > 0) & (smaller > 0), inter / smaller).otherwise(F.lit(0.0))


def coverage(a, b) -> Column:
    """Share of ``a`` (area floor 1) that ``b`` covers."""
    return intersection(a, b) / F.greatest(F.lit(1.0), area(a))


def quad_box(quad) -> tuple[Column, Column, Column, Column]:
    q = col(quad)
    xs = F.transform(q, lambda p: p["x"])
    ys = F.transform(q, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def box_center(a) -> tuple[Column, Column]:
    return (a[0] + a[2]) / 2, (a[1] + a[3]) / 2


def mirror_x(x: Column, width, axis) -> Column:
    fx, _ = flips(axis)
    return F.when(fx, col(width) - x).otherwise(x)


def mirror_y(y: Column, height, axis) -> Column:
    _, fy = flips(axis)
    return F.when(fy, col(height) - y).otherwise(y)


def mirror_box(a, width, height, axis) -> tuple[Column, Column, Column, Column]:
    ax, bx = mirror_x(a[0], width, axis), mirror_x(a[2], width, axis)
    ay, by = mirror_y(a[1], height, axis), mirror_y(a[3], height, axis)
    return F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)


# --- angles ----------------------------------------------------------------

def direction(angle: Column) -> tuple[Column, Column]:
    r = F.radians(angle)
    return F.cos(r), -F.sin(r)


def direction_angle(dx: Column, dy: Column) -> Column:
    return -F.degrees(F.atan2(dy, dx))


def mirror_raw_direction(dx: Column, dy: Column, axis) -> tuple[Column, Column]:
    fx, fy = flips(axis)
    return F.when(fx, -dx).otherwise(dx), F.when(fy, -dy).otherwise(dy)


def mirror_direction(dx: Column, dy: Column, axis) -> tuple[Column, Column]:
    """Reflected direction, turned around when it would not read canonically."""
    rx, ry = mirror_raw_direction(dx, dy, axis)
    readable = F.when(rx > EPS, True).when(rx < -EPS, False).otherwise(ry < EPS)
    return F.when(readable, rx).otherwise(-rx), F.when(readable, ry).otherwise(-ry)


def snap_cardinal(angle: Column, within: float) -> Column:
    out = angle
    for c in reversed(K.CARDINALS):
        out = F.when(F.abs(angle - c) < within, F.lit(c)).otherwise(out)
    return out


def mirror_angle(angle: Column, axis) -> Column:
    dx, dy = mirror_direction(*direction(angle), axis)
    return snap_cardinal(direction_angle(dx, dy), 1e-6)


def wrap180(delta: Column) -> Column:
    """Angle difference wrapped into [-180, 180)."""
    return F.pmod(delta + 180.0, F.lit(360.0)) - 180.0


def cardinal_deviation(angle: Column) -> Column:
    """STRUCT<cardinal, dev>: nearest cardinal and the signed deviation.

    The starting answer is cardinal 0 with the unwrapped angle; a cardinal
    wins only when strictly closer, earlier ones first.
    """
    cardinals = F.array(*[F.lit(c) for c in (0.0, *K.CARDINALS)])
    devs = F.array(angle, *[wrap180(angle - c) for c in K.CARDINALS])
    gaps = F.array(F.abs(angle), *[F.abs(wrap180(angle - c)) for c in K.CARDINALS])
    first = F.array_position(gaps, F.array_min(gaps)).cast("int")
    return F.struct(F.element_at(cardinals, first).alias("cardinal"),
                    F.element_at(devs, first).alias("dev"))


def quad_angle(quad, fallback: Column) -> Column:
    """Reading angle from the longer of the top and left edges of a quad."""
    q = col(quad)
    top = (q[1]["x"] - q[0]["x"], q[1]["y"] - q[0]["y"])
    left = (q[3]["x"] - q[0]["x"], q[3]["y"] - q[0]["y"])
    top_len, left_len = F.hypot(*top), F.hypot(*left)
    wide = top_len >= left_len
    dx = F.when(wide, top[0]).otherwise(left[0])
    dy = F.when(wide, top[1]).otherwise(left[1])
    along = F.greatest(top_len, left_len)
    across = F.least(top_len, left_len)
    turn = F.when(F.abs(dx) >= F.abs(dy), dx < 0).otherwise(dy > 0)
    angle = direction_angle(F.when(turn, -dx).otherwise(dx), F.when(turn, -dy).otherwise(dy))
    usable = (F.size(q) == 4) & (
        along / F.greatest(F.lit(1.0), across) >= K.MIN_ASPECT_FOR_QUAD_ANGLE)
    return F.when(usable, snap_cardinal(angle, K.ALWAYS_SNAP_DEG)).otherwise(fallback)


def unrotate_quad(quad, pass_id: Column, width: Column, height: Column) -> Column:
    """Map a quad read on a turned frame back to the upright sheet."""
    return F.transform(col(quad), lambda p: F.struct(
        F.when(pass_id == 1, p["y"]).when(pass_id == 2, width - 1 - p["y"])
        .otherwise(p["x"]).alias("x"),
        F.when(pass_id == 1, height - 1 - p["x"]).when(pass_id == 2, p["x"])
        .otherwise(p["y"]).alias("y")))


def reads_vertically(angle: Column) -> Column:
    """True when the nearest cardinal (0 first on ties) is +-90."""
    upright = F.least(*[F.abs(wrap180(angle - c)) for c in (90.0, -90.0)])
    level0 = F.abs(wrap180(angle))
    level180 = F.least(*[F.abs(wrap180(angle - c)) for c in (180.0, -180.0)])
    return (upright < level0) & (upright <= level180)


def needs_rotation(angle: Column) -> Column:
    far = F.lit(True)
    for c in K.CARDINALS:
        far = far & (F.abs(angle - c) >= K.UNAMBIGUOUS_TILT_DEG)
    return far


def quarter_turn(dx: Column, dy: Column) -> Column:
    """STRUCT<turn, deviation>: nearest quarter turn (half-even), mod 360."""
    angle = direction_angle(dx, dy)
    n = F.bround(angle / 90.0)
    return F.struct(F.pmod(n * 90.0, F.lit(360.0)).cast("int").alias("turn"),
                    (angle - n * 90.0).alias("deviation"))


def redraw_turn(angle: Column) -> Column:
    """STRUCT<turn, error>: the turn for lettering drawn anew, which reads along
    0, 90 or -90 degrees exactly; any other angle is an error."""
    turn = F.when(angle == 0, 0).when(angle == 90, 90).when(angle == -90, 270)
    return F.struct(turn.alias("turn"), F.when(turn.isNull(), F.lit("no quarter turn to draw at")).alias("error"))


# --- affine maps: ARRAY<DOUBLE> of 6 (a, b, c, d, e, f) -----------------------

def affine(*six) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double")
                     for v in six])


def compose(left: Column, right: Column) -> Column:
    """``left`` applied after ``right``."""
    a, b, c, d, e, f = (left[i] for i in range(6))
    p, q, r, s, t, u = (right[i] for i in range(6))
    return affine(a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s,
                  a * t + c * u + e, b * t + d * u + f)


def page_reflection(x0: Column, y0: Column, x1: Column, y1: Column, axis) -> Column:
    """Reflection of a page in place, from its media box corners."""
    fx, fy = flips(axis)
    return affine(F.when(fx, -1.0).otherwise(1.0), 0.0, 0.0, F.when(fy, -1.0).otherwise(1.0),
                  F.when(fx, x0 + x1).otherwise(0.0), F.when(fy, y0 + y1).otherwise(0.0))


def reflect_text_matrix(m: Column, reverse: Column, advance: Column, y_shift: Column) -> Column:
    """Text matrix on a reflected page: run it backwards along its baseline,
    or keep its direction and turn it over about its glyph box."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    return F.when(reverse, affine(-a, -b, c, d, e + a * advance, f + b * advance)).otherwise(
        affine(a, b, -c, -d, e + c * y_shift, f + d * y_shift))
