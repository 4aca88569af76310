"""Planar geometry, coordinate spaces and schedules as Column expressions. y grows downwards."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def angle_delta(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.round(F.least(d, 360.0 - d), 6)


def bearing(ax: Column, ay: Column, tx: Column, ty: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(ty - ay, tx - ax)) + 360.0, F.lit(360.0))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def direction_angle(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in P.DIRECTIONS.items() for x in kv]), name)


def matches(ax: Column, ay: Column, tx: Column, ty: Column, name: Column, tolerance: float = 10.0) -> Column:
    return angle_delta(bearing(ax, ay, tx, ty), direction_angle(name)) <= tolerance


def nearest_direction(ax: Column, ay: Column, tx: Column, ty: Column) -> Column:
    """The compass name with the least difference; of equals the first listed."""
    deg = bearing(ax, ay, tx, ty)
    options = [F.struct(F.least(F.abs(deg - v), 360.0 - F.abs(deg - v)).alias("d"), F.lit(k).alias("i"), F.lit(n).alias("n")) for k, (n, v) in enumerate(P.DIRECTIONS.items())]
    return F.array_min(F.array(*options))["n"]


def clip_pixel(v: Column, size: Column) -> Column:
    """Into [0, size - 1]; 0 where there is no size."""
    return F.when(size <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least((size - 1).cast("double"), v.cast("double"))))


def clip_pixel_rounded(v: Column, size: Column) -> Column:
    """Rounded half to even first."""
    return F.greatest(F.lit(0), F.least(F.greatest(size - 1, F.lit(0)).cast("int"), F.rint(v).cast("int")))


def norm_to_pixel(v: Column, size: Column) -> Column:
    den = F.greatest(size - 1, F.lit(1)).cast("double")
    return F.greatest(F.lit(0.0), F.least(den, v * den))


def pixel_to_norm(v: Column, size: Column, digits: int = 3) -> Column:
    den = F.greatest(size - 1, F.lit(1)).cast("double")
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / den)), digits)


def _unit(x: Column, y: Column, top: float) -> Column:
    return x.between(0.0, top) & y.between(0.0, top)


def guess_to_pixel(x: Column, y: Column, w: Column, h: Column) -> Column:
    """[0, 1] times the size; up to 100 as per cent on images over 100 pixels; else pixels. Clipped."""
    large = (w > 100) | (h > 100)
    as_part, as_percent = _unit(x, y, 1.0), (x <= 100.0) & (y <= 100.0) & large
    one = lambda v, s: clip_pixel(F.when(as_part, v * s).when(as_percent, v / 100.0 * s).otherwise(v), s)
    return F.struct(one(x, w).alias("x"), one(y, h).alias("y"))


def guess_to_norm(x: Column, y: Column, w: Column, h: Column, digits: int = 3) -> Column:
    """[0, 1] as it is; up to 100 as per cent on large images; pixels over size - 1. Null without a size."""
    large = (w > 100) | (h > 100)
    as_part, as_percent = _unit(x, y, 1.0), _unit(x, y, 100.0) & large

    def one(v: Column, s: Column) -> Column:
        den = F.greatest(s - 1, F.lit(1)).cast("double")
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(as_part, v).when(as_percent, v / 100.0).otherwise(v / den))), digits)

    return F.when((w > 0) & (h > 0), F.struct(one(x, w).alias("x"), one(y, h).alias("y")))


def predicted_pixel(x: Column, y: Column, w: Column, h: Column, absolute: bool) -> Column:
    """A predicted pair: fractions of [0, 1], thousandths up to 1000, else pixels if ``absolute``."""
    whole = (F.abs(x - F.rint(x)) < 1e-6) & (F.abs(y - F.rint(y)) < 1e-6)
    den = lambda s: F.greatest(s - 1, F.lit(1)).cast("double")
    put = lambda a, b: F.struct(clip_pixel_rounded(a, w).alias("x"), clip_pixel_rounded(b, h).alias("y"))
    out = F.when(_unit(x, y, 1.0) & ~whole, put(x * den(w), y * den(h))).when(_unit(x, y, 1000.0), put(x / 1000.0 * den(w), y / 1000.0 * den(h)))
    return out.otherwise(put(x, y)) if absolute else out


def two_step_path(ax: Column, ay: Column, tx: Column, ty: Column, first_axis: Column) -> Column:
    across = first_axis.isin("right", "left")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(ax, ay), point(F.when(across, tx).otherwise(ax), F.when(across, ay).otherwise(ty)), point(tx, ty))


def anchor_at(tx: Column, ty: Column, angle: Column, radius: Column) -> Column:
    """The anchor from which the target lies at ``radius`` in the direction of ``angle``."""
    return F.struct((tx - F.cos(F.radians(angle)) * radius).alias("x"), (ty - F.sin(F.radians(angle)) * radius).alias("y"))


def radius_range(w: Column, h: Column) -> Column:
    side = F.least(w, h)
    return F.struct(F.greatest(F.lit(45.0), side * 0.08).alias("lo"), (side * 0.28).alias("hi"))


def inside_border(x: Column, y: Column, w: Column, h: Column, border: float = 8.0) -> Column:
    return (x >= border) & (y >= border) & (x <= w - border) & (y <= h - border)


def backoff(attempt: Column, status: Column) -> Column:
    """Seconds before the next attempt, without its jitter."""
    return F.when(status == 429, F.least(F.lit(300.0), 15.0 * F.pow(F.lit(1.7), attempt - 1))).otherwise(F.least(F.lit(8.0), F.pow(F.lit(1.6), attempt - 1)))


def colour(index: Column) -> Column:
    """The index-th colour along the golden ratio, as r, g, b."""
    hue = F.pmod(index * F.lit(0.618033988749895), F.lit(1.0))
    s, v = 0.72, 0.96
    i = F.floor(hue * 6.0).cast("int")
    f = hue * 6.0 - i
    p, q, t = F.lit(v * (1 - s)), v * (1 - f * s), v * (1 - (1 - f) * s)
    byte = lambda c: F.floor(c * 255).cast("int")
    rows = ((F.lit(v), t, p), (q, F.lit(v), p), (p, F.lit(v), t), (p, q, F.lit(v)), (t, p, F.lit(v)), (F.lit(v), p, q))
    return F.element_at(F.array(*[F.struct(byte(r).alias("r"), byte(g).alias("g"), byte(b).alias("b")) for r, g, b in rows]), i % 6 + 1)


def learning_rate(step: Column, warmup: int, total: int) -> Column:
    """Linear warm-up, then half a cosine to 0."""
    done = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup))))
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(0.5 * (1.0 + F.cos(done * math.pi)))


def gaussian_peak(points: Column, x: Column, y: Column, sigma: float) -> Column:
    """The largest bell of ``sigma`` around a point at (x, y); 0 without points."""
    bell = lambda p: F.exp(-(F.pow(x - p["x"], 2) + F.pow(y - p["y"], 2)) / (2 * sigma * sigma))
    return F.coalesce(F.array_max(F.transform(points, bell)), F.lit(0.0))
