"""Rotated boxes (cx, cy, w, h, degrees): column expressions, and the overlap by polygon clipping."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalised_angle(a: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def nonempty(w: Column, h: Column, threshold: float = 0.0) -> Column:
    return (w > threshold) & (h > threshold)


def outer_box(cx, cy, w, h, a) -> tuple[Column, ...]:
    """The upright xyxy box around a rotated one."""
    c, s = F.abs(F.cos(F.radians(a))), F.abs(F.sin(F.radians(a)))
    half_w, half_h = (c * w + s * h) / 2, (c * h + s * w) / 2
    return cx - half_w, cy - half_h, cx + half_w, cy + half_h


def inside(box: tuple, width, height, slack: float = 0.0) -> Column:
    x1, y1, x2, y2 = outer_box(*box)
    return (x1 >= -slack) & (y1 >= -slack) & (x2 < width + slack) & (y2 < height + slack)


def clipped(cx, cy, w, h, a, width, height, tolerance: float = 1.0) -> tuple[Column, ...]:
    """Boxes within ``tolerance`` degrees of upright are clipped to the image; others stay. Sides never grow."""
    a = normalised_angle(a)
    flat = F.abs(a) <= tolerance
    out = []
    for centre, side, most in ((cx, w, width), (cy, h, height)):
        low, high = (F.least(F.greatest(centre + k * side / 2, F.lit(0.0)), most) for k in (-1, 1))
        out.append((F.when(flat, (low + high) / 2).otherwise(centre), F.when(flat, F.least(side, high - low)).otherwise(side)))
    return out[0][0], out[1][0], out[0][1], out[1][1], a


def scaled(cx, cy, w, h, a, sx: float, sy: float) -> tuple[Column, ...]:
    """A box under different scales of the axes; its angle follows."""
    c, s = F.cos(F.radians(a)), F.sin(F.radians(a))
    new_w = w * F.sqrt((sx * c) * (sx * c) + (sy * s) * (sy * s))
    new_h = h * F.sqrt((sx * s) * (sx * s) + (sy * c) * (sy * c))
    return cx * sx, cy * sy, new_w, new_h, F.degrees(F.atan2(sx * s, sy * c))


def corners(cx: float, cy: float, w: float, h: float, a: float) -> list[tuple[float, float]]:
    c, s = math.cos(math.radians(a)), math.sin(math.radians(a))
    return [(cx + dx * w / 2 * c + dy * h / 2 * s, cy - dx * w / 2 * s + dy * h / 2 * c) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def overlap(a: tuple, b: tuple) -> float:
    """Area of the intersection: a's corners cut by each edge of b in turn, then the shoelace sum."""
    poly, cutter = corners(*a), corners(*b)
    for (px, py), (qx, qy) in zip(cutter, cutter[1:] + cutter[:1], strict=True):
        side = [(qx - px) * (y - py) - (qy - py) * (x - px) for x, y in poly]
        kept = []
        for i, (x, y) in enumerate(poly):
            before = i - 1
            if (side[i] >= 0) != (side[before] >= 0):
                t = side[before] / (side[before] - side[i])
                ox, oy = poly[before]
                kept.append((ox + t * (x - ox), oy + t * (y - oy)))
            if side[i] >= 0:
                kept.append((x, y))
        poly = kept
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(poly, poly[1:] + poly[:1], strict=True))) / 2 if poly else 0.0


@F.pandas_udf(T.DoubleType())
def rotated_iou(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    """IoU of two struct columns (cx, cy, w, h, a)."""
    out = []
    for p, q in zip(a.itertuples(index=False), b.itertuples(index=False), strict=True):
        both = overlap(p, q)
        whole = p[2] * p[3] + q[2] * q[3] - both
        out.append(both / whole if whole > 0 else 0.0)
    return pd.Series(out, dtype=float)
