"""Box arithmetic as column expressions; a box is (x, y, w, h) or (x1, y1, x2, y2) in scalar columns.

All of it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xywh_to_xyxy(x, y, w, h) -> tuple[Column, ...]:
    return x, y, x + w, y + h


def xyxy_to_xywh(x1, y1, x2, y2) -> tuple[Column, ...]:
    return x1, y1, x2 - x1, y2 - y1


def xywh_to_cxcywh(x, y, w, h) -> tuple[Column, ...]:
    return x + w / 2, y + h / 2, w, h


def cxcywh_to_xyxy(cx, cy, w, h) -> tuple[Column, ...]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def area(w, h) -> Column:
    return w * h


def intersection(a, b) -> Column:
    """Of two xyxy boxes; 0 if they don't meet."""
    across = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    down = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(across, F.lit(0)) * F.greatest(down, F.lit(0))


def _area4(a) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def union(a, b) -> Column:
    return _area4(a) + _area4(b) - intersection(a, b)


def iou(a, b) -> Column:
    """0 where the union is empty."""
    return F.when(union(a, b) > 0, intersection(a, b) / union(a, b)).otherwise(F.lit(0.0))


def ioa(a, b) -> Column:
    """Intersection over the area of b."""
    return F.when(_area4(b) > 0, intersection(a, b) / _area4(b)).otherwise(F.lit(0.0))


def iom(a, b) -> Column:
    """Intersection over the smaller area."""
    least = F.least(_area4(a), _area4(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def giou(a, b) -> Column:
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    return iou(a, b) - (hull - union(a, b)) / hull


def clip(a, width, height) -> tuple[Column, ...]:
    """An xyxy box clipped to an image."""
    side = lambda v, most: F.least(F.greatest(v, F.lit(0)), most)
    return side(a[0], width), side(a[1], height), side(a[2], width), side(a[3], height)


def padded_crop(a, width, height, percent: int = 5) -> tuple[Column, ...]:
    """Integer crop window: padded by a share of its size, truncated, clipped."""
    pad_x, pad_y = ((a[2] - a[0]) * percent / 100).cast("bigint"), ((a[3] - a[1]) * percent / 100).cast("bigint")
    return F.greatest(a[0] - pad_x, F.lit(0)), F.greatest(a[1] - pad_y, F.lit(0)), F.least(a[2] + pad_x, width), F.least(a[3] + pad_y, height)


def occlusion_ratio(mask_area, w, h) -> Column:
    return mask_area / F.greatest(w * h, F.lit(1))


def near_boundary(a, width, height, margin: float = 0.025) -> Column:
    """True if the centre lies strictly inside the margin."""
    cx, cy = (a[0] + a[2]) / 2 / width, (a[1] + a[3]) / 2 / height
    return (cx < margin) | (cx > 1 - margin) | (cy < margin) | (cy > 1 - margin)


def normalised(a, width, height) -> tuple[Column, ...]:
    one = lambda v, size: F.least(F.greatest(v / size, F.lit(0.0)), F.lit(1.0))
    return one(a[0], width), one(a[1], height), one(a[2], width), one(a[3], height)


def horizontal_flip(a, width) -> tuple[Column, ...]:
    return width - a[2], a[1], width - a[0], a[3]


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace formula on two arrays."""
    turned = lambda v: F.concat(F.slice(v, 2, F.size(v)), F.slice(v, 1, 1))
    cross = F.zip_with(F.zip_with(xs, turned(ys), lambda a, b: a * b), F.zip_with(turned(xs), ys, lambda a, b: a * b), lambda p, q: p - q)
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2
